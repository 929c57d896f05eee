"""Grouping helpers that hold up when one key owns a large share of the rows.

Everything here pre-aggregates before it shuffles. No function sorts, lists or ranks one key's rows
inside one task, and none drops rows. Spark splits a skewed partition of a sort-merge join at run time, but
only where both inputs are plain shuffles. An aggregate by the same key is none, so a join of rows with the
statistics of their group writes these out first and salts hot groups from the counts that they hold anyway
(`join_groups`); where the other side is an aggregate without such counts, its caller writes it out (`cut`).
All other joins are left to Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.session import cut

HOT_ROWS: int | None = 100_000  # rows of a group from which it is dealt to several tasks; None never
HOT_KEYS = 4_096  # length of the list of salted keys: a key beyond it has at most 1/4096 of all rows

NULL_SALTS = 1_024
BROADCAST_ROWS = 10_000  # a written table above this is not broadcast, however small its compressed files are


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key in `order`.

    One shuffle, and the map side already reduces every key to one row, so a hot key costs one row
    per map task instead of a sort of all its rows (which `row_number` would need). Null keys group
    together. Meant for narrow rows; see `keep_first_ids` for rows with large payloads.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*[F.col(k) for k in keys], "_row.*").select(df.columns)


def keep_first_ids(df: DataFrame, keys: Sequence[str], order: Sequence[Column], id_col: str) -> DataFrame:
    """Like `first_per_key` for wide rows: only keys, order and id travel through the aggregation,
    then the winners are kept by a semi join on the unique id (no hot key there)."""
    winners = df.groupBy(*keys).agg(
        F.min(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.col(id_col).alias("_id"))).alias("_w")
    )
    return df.join(winners.select(F.col("_w._id").alias(id_col)), id_col, "left_semi").select(df.columns)


def hot_keys(groups: DataFrame, keys: Sequence[str], hot_rows: int, n: str = "n") -> DataFrame:
    """The largest groups with their number of salts, one per `hot_rows` rows; at most HOT_KEYS of them,
    a list small enough to broadcast by definition."""
    salts = F.ceil(F.col(n) / hot_rows).cast("int").alias("_salts")
    return groups.filter(F.col(n) >= hot_rows).orderBy(F.col(n).desc(), *keys).limit(HOT_KEYS).select(*keys, salts)


def _salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, how: str, hot: DataFrame
) -> DataFrame:
    """Rows of a hot key are dealt to its salts by the hash of `spread`; the right rows of that key are
    repeated once per salt; all other keys have salt 0. Rows with a null key match nothing and are dealt
    to NULL_SALTS. The result is that of the plain join."""
    hot = F.broadcast(hot)
    of = F.coalesce("_salts", F.lit(1))
    dealt = F.when(reduce(or_, [F.col(k).isNull() for k in keys]), NULL_SALTS).otherwise(of)
    salted = left.join(hot, list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), dealt).cast("int"))
    repeated = right.join(hot, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), of - 1)))
    return salted.drop("_salts").join(repeated.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def merged_if_many(written: DataFrame, n_rows: int | None = None) -> DataFrame:
    """A written table of more than BROADCAST_ROWS rows is joined by sorting and merging: Spark takes the size of its
    compressed files for that of its rows, and would send many times its limit through the driver."""
    n_rows = written.count() if n_rows is None else n_rows
    return written.hint("merge") if n_rows > BROADCAST_ROWS else written


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    spread: Column,
    n: str = "n",
    how: str = "inner",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Give every row its group's statistics; `groups` has one row per key and the number `n` of the rows
    of `rows` with that key. The groups are written out, so that they are computed once. Those of `hot_rows`
    rows and more are dealt to one salt per `hot_rows` rows; the list of them, which is broadcast, has
    HOT_KEYS entries at most. Without such groups it is a plain join."""
    if hot_rows is None:
        return rows.join(groups, list(keys), how)
    groups = cut(groups)
    found = groups.agg(F.count(F.lit(1)), F.max(n)).first()
    hot = hot_keys(groups, keys, hot_rows, n)
    groups = merged_if_many(groups, found[0])
    if (found[1] or 0) < hot_rows and how == "inner":
        return rows.join(groups, list(keys), how)
    return _salted_join(rows, groups, keys, spread, how, hot)


def join_skewed(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Column,
    how: str = "inner",
    hot_rows: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join in which keys of the left side may be hot. Null keys match nothing. `right` must not be an
    aggregate by the same keys, or Spark cannot split a hot one (write it out first, or use `join_groups`).

    With `hot_rows`, keys of that many rows are salted. They are counted on `counted`, a DataFrame with
    the same keys that is cheap to read, or on `left` itself, which is then evaluated twice.
    """
    if hot_rows is None:
        return left.join(right, list(keys), how)
    groups = (left if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return _salted_join(left, right, keys, spread, how, hot_keys(groups, keys, hot_rows, "_n"))
