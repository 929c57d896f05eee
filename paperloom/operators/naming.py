"""Numbers of repeated names whose made names can meet names that arrive by themselves.

A repeat of `a.txt` takes the next number whose name is free. The only names it can meet are `a_<k>.txt`, and such a
name is taken before the repeat only if it arrived by itself earlier: numbers grow, so no other repeat made it. With
the numbers in ascending order, number k is left out if no more repeats came before the first `a_<k>.txt` than were
given smaller numbers; else the next repeat takes it. That needs, per number, the count of repeats before it, and one
running count of the numbers left out. Counts are taken per block of ordinals or numbers, so that no
task holds a whole name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperloom.session import cut, drop_cut

BLOCK = 65_536
TASK_ROWS = 250_000  # rows dealt to a task; Spark itself joins small partitions to some 64 MB, many times that when sorted
FLUSH_VALUES = 1 << 17
NO_ORDINAL = -(1 << 63)

GROUP = ["_name", "_made", "_kb"]


def ordinal_block(ordinal: Column, size: int) -> Column:
    """Block of consecutive ordinals; rows without an ordinal have the first."""
    return F.coalesce(F.floor(ordinal / size).cast("bigint"), F.lit(NO_ORDINAL))


def tasks_for(written: DataFrame) -> int:
    return max(written.sparkSession.sparkContext.defaultParallelism, -(-written.count() // TASK_ROWS))


def name_key(parent: Column, stem: Column, ext: Column) -> Column:
    return F.to_json(F.struct(parent.alias("p"), stem.alias("s"), ext.alias("e")))


def _earlier(blocks: DataFrame, keys: list[str], block: str, of: Column) -> DataFrame:
    """`_before`: an aggregate over the earlier blocks of the same keys; one row per block."""
    window = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    return blocks.select(*keys, block, F.coalesce(of.over(window), F.lit(0)).cast("bigint").alias("_before"))


def number_members(rows: DataFrame, parent: str, ord_col: str) -> DataFrame:
    """Adds `unique_name` to rows with `_clean`, `_stem`, `_ext` (which follows the stem) and `_size`, the number of rows
    of the family. Of rows with the same ordinal, the shorter name of a family arrives first."""
    size, given, n_tasks = BLOCK, rows.columns, tasks_for(rows)
    names = cut(_names(rows, parent, ord_col))
    kids = _numbered_names(names, size)
    events = (
        rows.withColumn("_name", name_key(F.col(parent), F.col("_stem"), F.col("_ext")))
        .withColumn("_at", _arrival(F.col(ord_col).isNotNull(), F.col(ord_col)))
        .withColumn("_b", ordinal_block(F.col(ord_col), size))
        .withColumn("_row", F.lit(1))
        .unionByName(kids.withColumn("_b", ordinal_block(F.col("_at.o"), size)).withColumn("_row", F.lit(0)), allowMissingColumns=True)
    )
    events = events.repartition(n_tasks, "_name", "_b")
    # rows of a name so far, for its own rows and where a name that its repeats could take arrives
    running = W.partitionBy("_name", "_b").orderBy("_at", F.desc("_row")).rowsBetween(W.unboundedPreceding, 0)
    counted = cut(events.withColumn("_rows", F.sum("_row").over(running)).drop("_at"), "_row")
    drop_cut(names)
    offsets = counted.groupBy("_name", "_b").agg(F.max("_rows").alias("_n"))
    offsets = _earlier(offsets, ["_name"], "_b", F.sum("_n"))

    walked = cut(_walk(_limits(counted.filter("_row = 0").join(offsets, ["_name", "_b"])), n_tasks))
    made = _made_names(walked)
    # the numbers left out, by how many numbers were given before each of them
    marks = walked.filter("_skipped").groupBy("_name", "_made", (F.col("_k") - 1 - F.col("_s")).alias("_i")).agg(
        (F.max("_s") + 1).alias("_upto")
    )
    marked = marks.select("_name", "_made").distinct().withColumn("_marked", F.lit(True))
    offsets = offsets.join(made, "_name", "left").withColumn("_made", F.coalesce("_made", F.lit(0)))
    offsets = offsets.join(marked, ["_name", "_made"], "left")
    repeats = counted.filter("_row = 1").repartition(n_tasks, "_name", "_b").join(offsets, ["_name", "_b"]).withColumn(
        "_i", F.col("_before") + F.col("_rows") - 2 + F.col("_made")
    ).select(*given, "_name", "_made", "_i", "_marked")

    plain = repeats.filter("_marked IS NULL OR _i < 0").withColumn("_left_out", F.lit(0).cast("bigint"))
    found = plain.select(*given, "_i", "_left_out").unionByName(
        _left_out_before(repeats.filter("_marked AND _i >= 0"), marks, size).select(*given, "_i", "_left_out")
    )
    number = (F.col("_i") + 1 + F.col("_left_out")).cast("string")
    made_name = F.concat("_stem", F.lit("_"), number, "_ext")
    return found.select(*given, F.when(F.col("_i") < 0, F.col("_clean")).otherwise(made_name).alias("unique_name"))


def _left_out_before(repeats: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """`_left_out`: the last mark at or before a repeat, in its block or an earlier one."""
    in_block = ["_name", "_made", "_ib"]
    events = repeats.withColumn("_row", F.lit(1)).unionByName(marks.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    events = events.withColumn("_ib", F.floor(F.col("_i") / size))
    blocks = events.groupBy(*in_block).agg(F.max("_upto").alias("_upto"))
    running = W.partitionBy(*in_block).orderBy("_i", "_row").rowsBetween(W.unboundedPreceding, 0)
    return (
        events.withColumn("_here", F.max("_upto").over(running))
        .filter("_row = 1")
        .join(_earlier(blocks, ["_name", "_made"], "_ib", F.max("_upto")), in_block)
        .withColumn("_left_out", F.coalesce("_here", "_before"))
    )


def _names(rows: DataFrame, parent: str, ord_col: str) -> DataFrame:
    """Distinct names: rows, first arrival, and of a name in `_<k>` the number and the name `_above` whose repeats make it."""
    given = ~F.col("_no_ordinal")
    tail = F.regexp_extract("_stem", r"(?s)^.*_([1-9][0-9]{0,17})\z", 1)
    above = F.expr("substr(_stem, 1, length(_stem) - length(_tail) - 1)")
    return (
        rows.groupBy(F.col(parent).alias("_p"), "_stem", "_ext", "_size")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(ord_col).alias("_first"), F.max(F.col(ord_col).isNull()).alias("_no_ordinal"))
        .withColumn("_tail", tail)
        .select(
            name_key(F.col("_p"), F.col("_stem"), F.col("_ext")).alias("_name"), "_n", "_size",
            _arrival(given, F.when(given, F.col("_first"))).alias("_at"),
            F.when(F.col("_tail") != "", F.col("_tail").cast("bigint")).alias("_k"),
            F.when(F.col("_tail") != "", name_key(F.col("_p"), above, F.col("_ext"))).alias("_above"),
        )
    )


def _arrival(given: Column, ordinal: Column) -> Column:
    return F.struct(given.alias("given"), ordinal.alias("o"))


def _numbered_names(names: DataFrame, size: int) -> DataFrame:
    """One row per number `_k` of a name that arrives by itself (as `_child`, first `_at`), if the name has repeats or may
    have: `_may` if it may itself be made. `_earlier_kids` and `_blocks` tell of the other blocks of its numbers."""
    # a number above the rows of the family is never reached
    kids = names.filter("_k <= _size").select(
        F.col("_above").alias("_name"), "_k", F.floor(F.col("_k") / size).alias("_kb"), "_at", F.col("_name").alias("_child")
    )
    heads = kids.groupBy("_name", "_kb").agg(F.count(F.lit(1)).alias("_n_kids")).join(
        names.filter("_n > 1 OR _k IS NOT NULL").select("_name", F.col("_k").isNotNull().alias("_may")), "_name"
    )
    earlier = W.partitionBy("_name").orderBy("_kb").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(
        "_name", "_kb", "_may", F.coalesce(F.sum("_n_kids").over(earlier), F.lit(0)).alias("_earlier_kids"),
        F.count(F.lit(1)).over(W.partitionBy("_name")).alias("_blocks"),
    )
    return kids.join(heads, ["_name", "_kb"])


def _limits(kids: DataFrame) -> DataFrame:
    """`_d`: number k is left out if not more than `_d` smaller ones were. A name that may itself be made has two sets:
    `_made` is 1 if it was, as then its first arrival is a repeat too."""
    variants = F.when(F.col("_may"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    repeats = F.greatest(F.col("_before") + F.col("_rows") - 1 + F.col("_made"), F.lit(0))
    return kids.withColumn("_made", F.explode(variants)).select(
        *GROUP, "_k", (F.col("_k") - 1 - repeats).alias("_d"), "_child", "_earlier_kids", "_blocks"
    )


def _walk(kids: DataFrame, n_tasks: int) -> DataFrame:
    """`_skipped` and `_s`, the numbers left out before it, of every row of `_limits`.

    Where the numbers of a name fill several blocks, the count at the start of each comes first: a block keeps how many
    of its numbers are left out for certain and, of those that depend on that count, one integer each. Only these
    integers are passed over one block after another.
    """
    order = [*GROUP, "_k"]
    several = kids.filter("_blocks > 1").select(*order, "_d", "_earlier_kids")
    summed = several.repartition(n_tasks, *GROUP).sortWithinPartitions(*order).mapInArrow(
        _block_sums(), "_name STRING, _made INT, _kb BIGINT, _certain BIGINT, _open ARRAY<BIGINT>"
    )
    starts = summed.repartition("_name", "_made").sortWithinPartitions(*GROUP).mapInArrow(
        _block_starts(), "_name STRING, _made INT, _kb BIGINT, _start BIGINT"
    )
    walked = kids.join(starts, GROUP, "left").select(*order, "_d", "_child", F.coalesce("_start", F.lit(0)).alias("_start"))
    return walked.repartition(n_tasks, *GROUP).sortWithinPartitions(*order).mapInArrow(
        _left_out(), "_name STRING, _made INT, _k BIGINT, _child STRING, _skipped BOOLEAN, _s BIGINT"
    )


def _block_sums() -> Callable:
    group, flush = list(GROUP), FLUSH_VALUES

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema(
            [("_name", pa.string()), ("_made", pa.int32()), ("_kb", pa.int64()), ("_certain", pa.int64()), ("_open", pa.list_(pa.int64()))]
        )
        current, place, certain, doubtful, waiting, held = None, 0, 0, [], [], 0
        for batch in batches:
            given = [batch.column(c).to_pylist() for c in (*group, "_d", "_earlier_kids")]
            for name, made, kb, d, earlier in zip(*given):
                if (name, made, kb) != current:
                    if current:
                        waiting.append((*current, certain, doubtful))
                        held += 1 + len(doubtful)
                    if held >= flush:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)
                        waiting, held = [], 0
                    current, place, certain, doubtful = (name, made, kb), earlier, 0, []
                if d >= place:  # no more than `place` numbers can be left out before
                    certain += 1
                elif d >= certain:
                    doubtful.append(d - certain)
                place += 1
        if current:
            waiting.append((*current, certain, doubtful))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)

    return run


def _block_starts() -> Callable:
    group = list(GROUP)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current, count = None, 0
        for batch in batches:
            starts = []
            names, mades, certains = (batch.column(c).to_pylist() for c in ("_name", "_made", "_certain"))
            for i, key in enumerate(zip(names, mades)):
                if key != current:
                    current, count = key, 0
                starts.append(count)
                for d in batch.column("_open")[i].values.to_pylist():
                    if count <= d:
                        count += 1
                count += certains[i]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in group], pa.array(starts, pa.int64())], [*group, "_start"])

    return run


def _left_out() -> Callable:
    group = list(GROUP)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current, count = None, 0
        for batch in batches:
            skipped, counts = [], []
            given = [batch.column(c).to_pylist() for c in (*group, "_d", "_start")]
            for name, made, kb, d, start in zip(*given):
                if (name, made, kb) != current:
                    current, count = (name, made, kb), start
                skipped.append(count <= d)
                counts.append(count)
                count += count <= d
            kept = ["_name", "_made", "_k", "_child"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(skipped, pa.bool_()), pa.array(counts, pa.int64())],
                [*kept, "_skipped", "_s"],
            )

    return run


def _made_names(walked: DataFrame) -> DataFrame:
    """Names that a repeat of the name above them takes before they arrive, `_made` 1.

    Whether `a_1_2` is made may depend on whether `a_1` was, as its first arrival is a repeat then. Names for which it
    does look at the name above the name above, twice as far in each round, until none is open.
    """
    state = walked.groupBy("_child").agg(
        F.max("_name").alias("_above"),
        F.max(F.when(F.col("_made") == 0, ~F.col("_skipped"))).alias("_m0"),
        F.max(F.when(F.col("_made") == 1, ~F.col("_skipped"))).alias("_m1"),
    ).withColumn("_m1", F.coalesce("_m1", "_m0"))
    while not state.filter("_m0 != _m1").isEmpty():
        state = cut(state)
        above = state.select(F.col("_child").alias("_above"), F.col("_above").alias("_next"), F.col("_m0").alias("_p0"), F.col("_m1").alias("_p1"))
        of = lambda p: F.when(F.coalesce(p, F.lit(False)), F.col("_m1")).otherwise(F.col("_m0"))
        followed = state.filter("_m0 != _m1").join(above, "_above", "left").select(
            "_child", F.col("_next").alias("_above"), of(F.col("_p0")).alias("_m0"), of(F.col("_p1")).alias("_m1")
        )
        state = state.filter("_m0 = _m1").unionByName(followed)
    return state.filter("_m0").select(F.col("_child").alias("_name"), F.lit(1).alias("_made"))
