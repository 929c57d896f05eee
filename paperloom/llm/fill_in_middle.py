"""Fill-in-the-middle transformation by one counted pattern per row.

`regexp_count` gives a text's n units. Two cut points a <= b, drawn from a hash of the row's key, make a
pattern of the row's own: `unit{a}` and `unit{b-a}` as possessive groups, which a regular expression
engine walks without backtracking and without recursion, then the rest. One match of that pattern captures
prefix, middle and suffix, and its replacement writes them out in the order of the row's form. A projection:
no shuffle, no Python, and no state beyond the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: A line with its line feed, or the last line without one. Both branches are possessive: same matches,
#: and a last line is not tried again character by character.
LINE = r"[^\n]*+\n|[^\n]++"
SEED = 7


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 per key: the first groups of eight digits of a SHA-256. A null key draws as
    an empty one."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def counted_pattern(unit: str, first: Column, second: Column) -> Column:
    """A pattern that matches a whole text: `first` units, `second` units, the rest."""
    units = lambda n: F.concat(F.lit(f"((?:{unit}){{"), n.cast("string"), F.lit("}+)"))
    return F.concat(F.lit(r"\A"), units(first), units(second), F.lit(r"((?s:.*))\z"))


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    unit: str = LINE,
    percent: int = 100,
    spm_percent: int = 50,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of `docs`: key, n (units), form, prefix_chars, middle_chars, output.

    `unit` is a pattern without capturing groups whose matches tile a text. `percent` of the keys are
    rearranged, `spm_percent` of these as suffix-prefix-middle (`spm`), the others as
    prefix-suffix-middle (`psm`). A text that is null (an empty one), empty or already contains a marker
    stays as it is: form `plain`, null lengths. A null key draws like an empty string. Repeated rows give
    repeated rows; only the named columns are read, so others may have any name.
    """
    h1, h2, h3, h4 = draws(F.col("key"), seed)
    marked = F.lit(False)
    for marker in MARKERS:
        marked = marked | F.col("text").contains(marker)
    form = (
        F.when((F.col("text") == "") | marked | (h3 % 100 >= percent), "plain")
        .when(h4 % 100 < spm_percent, "spm")
        .otherwise("psm")
    )
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = rows.withColumn("n", F.regexp_count("text", F.lit(unit)).cast("long")).withColumn("form", form)
    cut = counted.withColumn("a", F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))).withColumn(
        "b", F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))
    )
    pattern = counted_pattern(unit, F.col("a"), F.col("b") - F.col("a"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    plain = F.col("form") == "plain"
    made = cut.withColumn("output", F.when(plain, F.col("text")).otherwise(F.regexp_replace("text", pattern, order)))
    after = lambda marker: F.instr("output", marker) + len(marker)
    ends = F.when(F.col("form") == "spm", F.instr("output", MIDDLE)).otherwise(F.instr("output", SUFFIX))
    return made.select(
        F.col("key").alias(key),
        "n",
        "form",
        F.when(~plain, ends - after(PREFIX)).cast("long").alias("prefix_chars"),
        F.when(~plain, F.length("output") + 1 - after(MIDDLE)).cast("long").alias("middle_chars"),
        "output",
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone. A rearranged text holds no
    marker of its own, so each marker occurs once in the output."""
    spm, part = form == "spm", "((?s:.*))"
    pattern = F.when(spm, rf"\A{SUFFIX}{part}{PREFIX}{part}{MIDDLE}{part}\z").otherwise(
        rf"\A{PREFIX}{part}{SUFFIX}{part}{MIDDLE}{part}\z"
    )
    order = F.when(spm, "$2$3$1").otherwise("$1$3$2")
    return F.when(form == "plain", output).otherwise(F.regexp_replace(output, pattern, order))
