"""Batch summaries, totals, edge-free aggregates and attempt merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.operators.classify import UNKNOWN_TYPE
from paperloom.operators.keys import first_per_key

# Fixed values
SUCCESS_ABOVE = 0.7
EXPIRY_WINDOW_DAYS = 90
PARTIAL_MIN_CONFIDENCE = 0.3


def _successful(confidence: str) -> Column:
    return F.count_if(F.coalesce(F.col(confidence), F.lit(0.0)) > SUCCESS_ABOVE)


def summarize(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Grand total and one row per type in a single pass (G1). The total has a null type."""
    typed = df.withColumn("document_type", F.coalesce("document_type", F.lit(UNKNOWN_TYPE)))
    return (
        typed.rollup("document_type")
        .agg(
            F.grouping("document_type").cast("boolean").alias("is_total"),
            F.count(F.lit(1)).alias("total_documents"),
            _successful(confidence).alias("successful_extractions"),
        )
        .select("document_type", "is_total", "total_documents", "successful_extractions")
    )


def batch_status(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """processed, successful, failed = processed - successful."""
    return df.agg(F.count(F.lit(1)).alias("processed"), _successful(confidence).alias("successful")).withColumn(
        "failed", F.col("processed") - F.col("successful")
    )


def total_by_vendor(invoices: DataFrame) -> DataFrame:
    """Invoice total and number of source documents per vendor, plus the grand total (null vendor,
    `is_total`) from the same pass (G3)."""
    named = invoices.select(F.col("vendor.name").alias("vendor"), F.col("financial.total_amount").alias("amount"))
    return named.rollup("vendor").agg(
        F.grouping("vendor").cast("boolean").alias("is_total"),
        F.sum("amount").alias("total_amount"),
        F.count(F.lit(1)).alias("n_invoices"),
    )


def top_vendors(invoices: DataFrame, k: int = 1) -> DataFrame:
    """The k vendors with the highest invoice total."""
    named = invoices.select(F.col("vendor.name").alias("vendor"), F.col("financial.total_amount").alias("amount"))
    totals = named.groupBy("vendor").agg(F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("n_invoices"))
    return totals.orderBy(F.col("total_amount").desc(), "vendor").limit(k)


def expiring(agreements: DataFrame, as_of: Column, days: int = EXPIRY_WINDOW_DAYS) -> DataFrame:
    """Contracts that expire from `as_of` to `days` days later, both included."""
    return agreements.filter(F.col("metadata.expiry_date").between(as_of, F.date_add(as_of, days)))


def best_attempt(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The attempt with the highest confidence per document, earliest on ties."""
    return first_per_key(df, [doc], [-F.coalesce(F.col("confidence"), F.lit(-1.0)), F.col("attempt")])


def best_fields(df: DataFrame, minimum: float = PARTIAL_MIN_CONFIDENCE, doc: str = "doc_id") -> DataFrame:
    """Per document and field: the value with the highest confidence, earliest attempt on ties; values
    below `minimum` do not take part (G12). Input: doc, field, value, confidence, attempt."""
    usable = df.filter((F.col("confidence") >= minimum) & F.col("value").isNotNull())
    return first_per_key(usable, [doc, "field"], [-F.col("confidence"), F.col("attempt")])


def merge_partial(
    df: DataFrame, fields: list[str], minimum: float = PARTIAL_MIN_CONFIDENCE, doc: str = "doc_id"
) -> DataFrame:
    """One map of merged fields per document; `partial` when one of `fields` found no usable value.

    One aggregation: per named field the value of the best (confidence, then earliest attempt).
    """
    usable = (F.col("confidence") >= minimum) & F.col("value").isNotNull()
    rank = F.struct("confidence", -F.col("attempt"))
    best = [F.max_by("value", F.when((F.col("field") == f) & usable, rank)).alias(f"_{i}") for i, f in enumerate(sorted(fields))]
    merged = df.groupBy(doc).agg(*best)
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("value")) for i, f in enumerate(sorted(fields))])
    found = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return merged.select(doc, found.alias("fields")).withColumn("partial", F.size("fields") < len(fields))


def confidence_histogram(df: DataFrame, confidence: str = "confidence", buckets: int = 10) -> DataFrame:
    """Documents per confidence bucket; bucket i covers [i/buckets, (i+1)/buckets), 1.0 in the last."""
    bucket = F.least(F.floor(F.round(F.col(confidence) * buckets, 9)), F.lit(buckets - 1))
    return (
        df.filter(F.col(confidence).isNotNull())
        .groupBy(bucket.cast("int").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("documents"))
    )


#: Size of a KLL sketch: exact to that many values or so, then a rank is off by less than 0.1 % of the values.
SKETCH_K = 4096


def merged_quantiles(sketches: DataFrame, *keys: Column | str, quantile: float = 0.95, k: int = SKETCH_K) -> DataFrame:
    """Documents and a quantile per group of stored sketches (n, sketch), merged without the values behind them.
    The quantile is the least value with that share of values at or below it, null where there is none."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("n").alias("documents"), F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch")), k).alias("_sketch")
    )
    value = F.when(F.col("documents") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(float(quantile))))
    return merged.withColumn("value", value).drop("_sketch")


def ops_metrics(df: DataFrame) -> DataFrame:
    """Documents, mean and p95 duration, mean confidence, error rate, cache-hit rate.
    Input: duration_ms, confidence, failed, cache_hit."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    return df.agg(
        F.count(F.lit(1)).alias("documents"),
        F.avg("duration_ms").alias("mean_duration_ms"),
        F.percentile_approx("duration_ms", 0.95, 10000).alias("p95_duration_ms"),
        F.avg("confidence").alias("mean_confidence"),
        share("failed").alias("error_rate"),
        share("cache_hit").alias("cache_hit_rate"),
    )
