"""Chat formatting: every dialogue from the view of each of its speakers.

A perspective makes one speaker the assistant; all others become users with a name. System turns belong
to no speaker and stay as they are. The result has a row per perspective and turn: the rendered piece,
its place in the rendered dialogue, and the span that is trained on. Pieces in order of `seq` are the
dialogue, so no dialogue has to fit into one value, and a dialogue of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The markers of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, ASSISTANT, USER = "system", "assistant", "user"

BLOCK = 1024


def _running(rows: DataFrame, group: list[str], turn: str, values: dict[str, str]) -> DataFrame:
    """Exclusive running sums of `values` (result name -> column) per group in order of turn and `_tie`.

    Sums are taken per block of turns first, so that one group's rows are not sorted in one task.
    """
    block = F.floor(F.coalesce(F.col(turn), F.lit(-1)) / BLOCK)
    rows = rows.withColumn("_block", block)
    sums = rows.groupBy(*group, "_block").agg(*[F.sum(v).alias(f"_s_{k}") for k, v in values.items()])
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_block").alias("_g_block"),
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values],
    )
    inside = Window.partitionBy(*group, "_block").orderBy(turn, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in values.items()})
    same = F.col("_block") == F.col("_g_block")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = rows.join(bases, same)
    return joined.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in values}).drop(
        "_block", "_g_block", *[f"_g_{g}" for g in group], *[f"_b_{k}" for k in values]
    )


def _plain(text: Column) -> Column:
    """Text without the format's own markers: a blank breaks them."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _name(speaker: Column) -> Column:
    """Speaker as a name of letters, digits, `_` and `-`. Where that changes it (`a b`, an empty one), the
    first 8 digits of its SHA-256 follow, so that it stays apart from `a_b`."""
    plain = F.regexp_replace(speaker, "[^A-Za-z0-9_-]", "_")
    marked = F.concat(plain, F.lit("_"), F.substring(F.sha2(speaker, 256), 1, 8))
    return F.when((plain == speaker) & (speaker != ""), plain).otherwise(marked)


def rotate_perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows (conv, perspective, seq, turn, speaker, role, name, piece, start, mask_start, mask_end).

    `start` is the piece's first character in the rendered dialogue, `mask_start`/`mask_end` the
    trained span there (content and end marker of the assistant's turns; null for all other turns).

    A null role is the speaker `unknown`; null text is empty; turns of a null conversation are one
    conversation. Turns are ordered by number (null first), then speaker, then text; a repeated row is a
    repeated turn. A dialogue of system turns alone has no speaker, hence no row; an empty table gives
    no rows. Other columns of `turns`, whatever their names, are not read.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"),
        _plain(F.col(text)).alias("content"),
    ).withColumn("name", _name(F.col("speaker")))
    said = rows.withColumns(
        {
            "as_self": F.concat(F.lit(f"{OPEN}{ASSISTANT}\n"), "content", F.lit(f"{CLOSE}\n")),
            "as_other": F.when(
                F.col("speaker") == SYSTEM, F.concat(F.lit(f"{OPEN}{SYSTEM}\n"), "content", F.lit(f"{CLOSE}\n"))
            ).otherwise(F.concat(F.lit(f"{OPEN}{USER} name="), "name", F.lit("\n"), "content", F.lit(f"{CLOSE}\n"))),
        }
    )
    speakers = (
        rows.filter(F.col("speaker") != SYSTEM)
        .groupBy(F.col("conv").alias("_conv"))
        .agg(F.collect_set("speaker").alias("_speakers"))
    )
    views = (
        said.join(speakers, F.col("conv").eqNullSafe(F.col("_conv")))
        .withColumn("perspective", F.explode("_speakers"))
        .withColumn("_own", F.col("perspective") == F.col("speaker"))
        .withColumn("piece", F.when(F.col("_own"), F.col("as_self")).otherwise(F.col("as_other")))
        .withColumns({"_tie": F.struct("speaker", "content"), "_chars": F.length("piece"), "_one": F.lit(1)})
        .drop("_conv", "_speakers", "as_self", "as_other")
    )
    placed = _running(views, ["conv", "perspective"], "turn", {"start": "_chars", "seq": "_one"})
    begin = F.col("start") + len(f"{OPEN}{ASSISTANT}\n")
    return placed.select(
        F.col("conv").alias(conv),
        "perspective",
        F.col("seq").cast("long").alias("seq"),
        F.col("turn").alias(turn),
        "speaker",
        F.when(F.col("_own"), ASSISTANT).when(F.col("speaker") == SYSTEM, SYSTEM).otherwise(USER).alias("role"),
        F.when(~F.col("_own") & (F.col("speaker") != SYSTEM), F.col("name")).alias("name"),
        "piece",
        F.col("start").cast("long").alias("start"),
        F.when(F.col("_own"), begin).cast("long").alias("mask_start"),
        F.when(F.col("_own"), F.col("start") + F.col("_chars") - 1).cast("long").alias("mask_end"),
    )
