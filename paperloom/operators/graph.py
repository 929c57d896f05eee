"""Document graph and clusters of linked documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperloom.operators.keys import HOT_ROWS, join_groups
from paperloom.session import cut, drop_cut


def document_graph(docs: DataFrame, degrees: DataFrame, node: str = "path") -> DataFrame:
    """Graph nodes: every document with its number of related documents (0 when unlinked)."""
    return docs.join(degrees.select(node, "degree"), node, "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0).cast("bigint"))
    )


def _minima(directed: DataFrame) -> DataFrame:
    """Per node u the least id `m` among u and its neighbours, and its number of rows."""
    return directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))


def _with_minima(directed: DataFrame, minima: DataFrame, hot_rows: int | None) -> DataFrame:
    return join_groups(directed, minima, ["u"], F.col("v"), hot_rows=hot_rows)


def _large_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    pointed = _with_minima(both, _minima(both), hot_rows).filter(F.col("v") > F.col("u"))
    return pointed.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hot_rows: int | None) -> DataFrame:
    minima = _minima(edges)
    pointed = _with_minima(edges, minima, hot_rows).filter(F.col("v") != F.col("m"))
    own = minima.select("u", F.col("m").alias("v"))
    return pointed.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """Whether every u has one v and no v is a u itself, so that each v is the least node of its component;
    and the largest number of edges of a node, which no star step exceeds."""
    roles = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    per_node = roles.groupBy("u").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    bad = (F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))
    found = per_node.agg(F.max(bad), F.max(F.col("down") + F.col("up"))).first()
    return not found[0], found[1] or 0


def connected(edges: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Connected components of edges (source, target): one row (node, cluster) per linked node, the
    cluster named by its least node.

    Alternating large-star / small-star rounds turn every component into a star around its least node
    in a number of rounds that grows with the logarithm of the longest chain. Each round reads a table
    in the shared checkpoint folder and writes the next; the loop ends when that table is a forest of
    stars, which is checked, not guessed. The check also counts the edges of the largest hub: while one
    has `hot_rows` and more, hubs are dealt to several tasks.
    """
    current = cut(
        edges.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )
    while True:
        done, largest = _shape(current)
        if done:
            break
        hot = hot_rows if hot_rows is not None and largest >= hot_rows else None
        after = cut(_small_star(_large_star(current, hot), hot))
        drop_cut(current)
        current = after
    members = current.select(F.col("u").alias("node"), F.col("v").alias("cluster"))
    roots = members.select(F.col("cluster").alias("node"), "cluster").distinct()
    return members.unionByName(roots)


def clusters(edges: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """(node, cluster) with the cluster's size."""
    members = connected(edges, hot_rows)
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return join_groups(members, sizes, ["cluster"], F.col("node"), hot_rows=hot_rows).withColumnRenamed(
        "n", "cluster_size"
    )
