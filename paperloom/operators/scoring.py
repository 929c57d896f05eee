"""Quality scores and accuracy against labelled truth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Weights of the quality score and the alert limit.
QUALITY_WEIGHTS = {"completeness": 0.3, "consistency": 0.3, "confidence": 0.4}
ALERT_BELOW = 0.5


def kyc_expiry(df: DataFrame, as_of: Column, into: str = "expiry_status") -> DataFrame:
    """`expired` before the as-of date, `valid` from it on, `unknown` without an expiry date (V7)."""
    expiry = F.col("metadata.expiry_date")
    return df.withColumn(
        into, F.when(expiry < as_of, "expired").when(expiry >= as_of, "valid").otherwise("unknown")
    )


def completeness(required: Sequence[Column]) -> Column:
    """Share of required fields that hold a value; empty text does not count (V8)."""
    filled = [(c.isNotNull() & (c.cast("string") != "")).cast("int") for c in required]
    return sum(filled[1:], filled[0]) / F.lit(len(filled))


def consistency(checks: Sequence[Column]) -> Column:
    """Share of passing checks among those that can be evaluated; 1.0 when none can (V9)."""
    known = [c.isNotNull().cast("int") for c in checks]
    passed = [F.coalesce(c.cast("int"), F.lit(0)) for c in checks]
    total = sum(known[1:], known[0])
    return F.when(total > 0, sum(passed[1:], passed[0]) / total).otherwise(F.lit(1.0))


def confidence(fields: Column, weights: Mapping[str, float] | None = None) -> Column:
    """(Weighted) mean of a map field -> confidence; unlisted fields weigh 1."""
    table = F.create_map(*[x for k, v in (weights or {}).items() for x in (F.lit(k), F.lit(float(v)))]) if weights else None
    weight = lambda k: F.coalesce(table[k], F.lit(1.0)) if weights else F.lit(1.0)
    entries = F.map_entries(fields)
    top = F.aggregate(entries, F.lit(0.0), lambda a, e: a + weight(e["key"]) * e["value"].cast("double"))
    bottom = F.aggregate(entries, F.lit(0.0), lambda a, e: a + weight(e["key"]))
    return F.when(bottom > 0, top / bottom)


def quality(df: DataFrame, limit: float = ALERT_BELOW) -> DataFrame:
    """Weighted score of columns completeness, consistency, confidence; low scores alert and go to review."""
    parts = [F.col(name) * weight for name, weight in QUALITY_WEIGHTS.items()]
    score = F.round(parts[0] + parts[1] + parts[2], 6)
    return (
        df.withColumn("quality", score)
        .withColumn("alert", F.col("quality") < limit)
        .withColumn("needs_review", F.col("quality") < limit)
    )


def evaluate(predicted: DataFrame, truth: DataFrame, fields: Sequence[str], doc: str = "doc_id") -> DataFrame:
    """Accuracy per field and overall (null field) against labelled documents.

    Every labelled document counts, also one without a prediction; null equals null.
    """
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])
        return df.select(doc, F.explode(pairs).alias("p")).select(doc, "p.*")

    both = long(truth, "expected").join(long(predicted, "got"), [doc, "field"], "left")
    hit = F.col("expected").eqNullSafe(F.col("got")).cast("int")
    return both.rollup("field").agg(
        F.grouping("field").cast("boolean").alias("is_total"),
        F.count(F.lit(1)).alias("n"),
        F.sum(hit).alias("n_correct"),
        F.avg(hit).alias("accuracy"),
    )


def schema_compliance(checked: DataFrame, by: str | None = None, valid: str = "validation.is_valid") -> DataFrame:
    """Share of documents that comply with their schema, over all (null group) and per value of `by`."""
    group = F.lit(None).cast("string") if by is None else F.col(by)
    rows = checked.select(group.alias("group"), F.col(valid).alias("ok"))
    return (
        rows.rollup("group")
        .agg(
            F.grouping("group").cast("boolean").alias("is_total"),
            F.count(F.lit(1)).alias("documents"),
            F.count_if("ok").alias("compliant"),
            F.avg(F.coalesce("ok", F.lit(False)).cast("int")).alias("schema_compliance"),
        )
        .filter(F.lit(by is not None) | F.col("is_total"))
    )
