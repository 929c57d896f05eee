"""Vector similarity of documents.

The reference meaning (a model reads two documents) is not data work. What is kept is the data side:
a score for documents from stored embeddings: here with the mean vector of a group they are already linked
in, or along edges that another detector found, both linear; `neighbours` finds all near vectors.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.operators.keys import HOT_ROWS, join_groups, join_skewed

TYPE = "semantic_similarity"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of the same length; null for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def group_similarity(df: DataFrame, group: str, doc: str, vector: str = "embedding", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Cosine of every document to the mean vector of its group. Means are summed map-side in the JVM."""
    as_vector = array_to_vector(F.col(vector).cast("array<double>"))
    means = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(as_vector).alias("_mean"))
    means = means.withColumn("_mean", vector_to_array("_mean"))
    joined = join_groups(df.select(doc, group, vector), means, [group], F.col(doc), hot_rows=hot_rows)
    return joined.select(doc, group, cosine(F.col(vector), F.col("_mean")).alias("similarity"), "n")


def link_semantic(
    df: DataFrame, group: str, doc: str, minimum: float, vector: str = "embedding", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Documents at least `minimum` similar to their group's mean."""
    scored = group_similarity(df, group, doc, vector, hot_rows)
    return scored.filter(F.col("similarity") >= minimum).withColumn("type", F.lit(TYPE))


def score_edges(
    edges: DataFrame, vectors: DataFrame, doc: str = "path", vector: str = "embedding", hot_rows: int | None = None
) -> DataFrame:
    """Cosine along the edges another detector found (source, target); a source with very many edges,
    as the first document of a big group has, is split over tasks."""
    side = lambda name: vectors.select(F.col(doc).alias(name), F.col(vector).alias(f"_{name}"))
    with_source = join_skewed(edges, side("source"), ["source"], F.col("target"), hot_rows=hot_rows)
    joined = join_skewed(with_source, side("target"), ["target"], F.col("source"), hot_rows=hot_rows, counted=edges)
    return joined.withColumn("similarity", cosine(F.col("_source"), F.col("_target"))).drop("_source", "_target")
