"""Streaming queries (R), whole pipelines (T), insights (G14) and similarity.

Streams read the events table as files and process all of it; the result is what the job has written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import classify as kl
from paperloom.operators import aggregate, extract, link, neighbours, semantic
from paperloom.plans import insights as ins
from paperloom.plans import pipeline
from paperloom.session import cut, new_folder
from paperloom.streaming import incremental, jobs
from workload import inputs
from workload.oracle_inputs import oracle
from workload.q_links import letters
from workload.registry import ORACLES, query

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _events(spark, sf_dir):
    raw = jobs.read_event_stream(spark, sf_dir, "events", EVENT_SCHEMA)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, stream):
    base = new_folder(spark, "stream")
    return jobs.run_available(stream, f"{base}/out", f"{base}/state")


@query(
    "stream_metrics",
    oracle(
        """
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, count(*) AS documents,
       round(avg((event_type = 'error')::INT), 6) AS error_rate, round(avg(event_id % 100 / 100.0::DOUBLE), 6) AS mean_confidence
FROM (SELECT *, time_bucket(INTERVAL 60 SECONDS, ts) AS w FROM events)
GROUP BY w HAVING w + INTERVAL 60 SECONDS <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 5 MINUTES FROM events)"""
    ),
)
def stream_metrics(spark, sf_dir):
    """Closed minutes only: a window is written once the watermark has passed it."""
    confidence = F.col("event_id") % 100 / F.lit(100.0)
    out = _run(spark, jobs.minute_metrics(_events(spark, sf_dir), F.col("event_type") == "error", confidence))
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
        "documents",
        F.round("error_rate", 6).alias("error_rate"),
        F.round("mean_confidence", 6).alias("mean_confidence"),
    )


@query(
    "daily_quantiles",
    oracle(
        """
SELECT strftime(w, '%Y-%m-%d') AS day, count(value) AS documents, quantile_disc(value, 0.95) AS p95
FROM (SELECT *, time_bucket(INTERVAL 60 SECONDS, ts) AS w FROM events)
WHERE w + INTERVAL 60 SECONDS <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 5 MINUTES FROM events) GROUP BY day"""
    ),
)
def daily_quantiles(spark, sf_dir):
    """95th percentile per day, from the sketches of its closed minutes; exact while a day has a few thousand values."""
    minutes = _run(spark, jobs.minute_sketches(_events(spark, sf_dir), F.col("value")))
    out = aggregate.merged_quantiles(minutes, F.date_format("window_start", "yyyy-MM-dd").alias("day"))
    return out.select("day", "documents", F.col("value").alias("p95"))


@query(
    "incremental_links",
    oracle(
        """
WITH docs AS (SELECT event_id, 'a/' || event_id || '/INV-' || (event_id // 3) || '.pdf' AS path FROM events),
keyed AS (SELECT event_id, path, 'invoice_for_po' AS type, 'Filename pattern match: ' || (event_id // 3) AS evidence FROM docs
          UNION ALL SELECT event_id, path, 'matching_amount', 'Matching amount: ' || (event_id // 40) || '.00 USD' FROM docs),
firsts AS (SELECT type, evidence, min(event_id) AS first, arg_min(path, event_id) AS source FROM keyed GROUP BY ALL)
SELECT source, path AS target, type, evidence FROM keyed JOIN firsts USING (type, evidence) WHERE event_id <> first"""
    ),
)
def incremental_links(spark, sf_dir):
    """Documents arrive in five micro-batches in no order; each is linked with everything stored before,
    by two detectors, and the relationships at the end are those of all documents at once."""
    key = F.col("event_id")
    path = F.concat(F.lit("a/"), key.cast("string"), F.lit("/INV-"), F.floor(key / 3).cast("string"), F.lit(".pdf"))
    docs = inputs.table(spark, sf_dir, "events").select(
        key.alias("ord"), path.alias("path"), F.floor(key / 40).alias("amount"), F.pmod(F.xxhash64(key), F.lit(5)).alias("part")
    )
    base = new_folder(spark, "links")
    docs.repartition(5, "part").write.partitionBy("part").parquet(f"{base}/in")
    arriving = spark.readStream.schema("ord BIGINT, path STRING, amount BIGINT").option("maxFilesPerTrigger", 1)
    arriving = arriving.option("recursiveFileLookup", "true").parquet(f"{base}/in")
    detectors = [link.link_filename, lambda d: link.link_amount(d, F.col("amount"), F.lit("USD"))]
    job = arriving.writeStream.foreachBatch(jobs.link_batches(f"{base}/store", f"{base}/edges", detectors))
    ended = job.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    ended.awaitTermination()
    return jobs.current_links(spark, f"{base}/store", f"{base}/edges").select("source", "target", "type", "evidence")


def _linked_in_batches(spark, docs, job):
    """Write documents as five files in no order, read them as a stream of five micro-batches, run `job`
    (store, edges) on each; returns the two folders."""
    base = new_folder(spark, "links")
    docs.repartition(5, F.xxhash64("ord")).write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    ended = arriving.writeStream.foreachBatch(job(f"{base}/store", f"{base}/edges"))
    ended.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{base}/store", f"{base}/edges"


@query("incremental_references", ORACLES["reference_links"])
def incremental_references(spark, sf_dir):
    """Letters and the agreements they name arrive in micro-batches in no order; mentions wait for what they
    name, and the references at the end are those of all letters at once."""
    folders = _linked_in_batches(spark, letters(spark, sf_dir), incremental.reference_batches)
    edges = incremental.current_references(spark, *folders)
    return edges.select("source", "target", "confidence", "evidence", "n_targets")


@query("incremental_temporal", ORACLES["temporal_links"])
def incremental_temporal(spark, sf_dir):
    """Invoices arrive in micro-batches in no order; the temporal links at the end are those of all at once."""
    docs = inputs.invoices(spark, sf_dir).select(
        "ord", "path", F.col("vendor.name").alias("vendor"), F.col("metadata.invoice_date").alias("date")
    )
    store, _ = _linked_in_batches(spark, docs, lambda s, e: incremental.temporal_batches(s, e, "vendor", "date"))
    return incremental.current_temporal(spark, store).select(
        "block",
        F.col("day_a").cast("string").alias("day_a"),
        F.col("day_b").cast("string").alias("day_b"),
        "days_apart",
        F.round("confidence", 6).alias("confidence"),
        F.col("n_pairs").cast("bigint").alias("n_pairs"),
    )


@query("stream_dedup", oracle("SELECT event_id, user_id, event_type FROM events"))
def stream_dedup(spark, sf_dir):
    """Every event arrives again an hour later for two thirds of them; each is written once."""
    events = _events(spark, sf_dir)
    again = events.filter("event_id % 3 <> 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    key = F.sha2(F.to_json(F.struct("event_id", "user_id", "event_type", "value")), 256)
    out = _run(spark, jobs.drop_redelivered(events.unionByName(again).withColumn("sha256", key)))
    return out.select("event_id", "user_id", "event_type")


@query(
    "failure_windows",
    oracle(
        """
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, source, count(*) AS failures
FROM (SELECT user_id % 10 AS source, unnest([time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(i AS INTEGER)) FOR i IN range(0, 6)]) AS w
      FROM events WHERE event_type = 'error')
GROUP BY w, source
HAVING count(*) >= 5 AND w + INTERVAL 6 HOURS <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 5 MINUTES FROM events)"""
    ),
)
def failure_windows(spark, sf_dir):
    """Six-hour windows every hour, as the test events are far apart."""
    stream = _events(spark, sf_dir).withColumn("source", F.col("user_id") % 10)
    out = _run(spark, jobs.failure_windows(stream, F.col("event_type") == "error", window="6 hours", slide="1 hour"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "source", "failures")


@query(
    "failure_bursts",
    oracle(
        """
WITH f AS (SELECT user_id % 10 AS source, ts FROM events WHERE event_type = 'error'
           UNION ALL SELECT 100 + i, date_trunc('day', (SELECT min(ts) FROM events)) + to_days(CAST(i AS INTEGER)) + to_minutes(m)
           FROM range(0, 3) AS x(i), (VALUES (54), (120), (180), (240), (390)) AS v(m)),
s AS (SELECT source, ts, lag(ts, 4) OVER (PARTITION BY source ORDER BY ts) AS start FROM f),
h AS (SELECT source, start, ts AS stop, max(ts) OVER (PARTITION BY source ORDER BY start, ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM s WHERE ts - start < INTERVAL 6 HOUR),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY start, stop) AS island FROM h),
b AS (SELECT source, min(start) AS burst_start, max(stop) AS burst_end FROM i GROUP BY source, island)
SELECT b.source, strftime(b.burst_start, '%Y-%m-%d %H:%M:%S') AS burst_start, strftime(b.burst_end, '%Y-%m-%d %H:%M:%S') AS burst_end,
       count(*) AS failures
FROM b JOIN f ON f.source = b.source AND f.ts BETWEEN b.burst_start AND b.burst_end
WHERE b.burst_end + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 5 MINUTES FROM events)
GROUP BY ALL"""
    ),
)
def failure_bursts(spark, sf_dir):
    """Five errors within six hours, as the test events are far apart; with three sources of five errors each
    that lie across any grid of an hour (the offsets 9, 20, 30, 40, 65 of a minute's window, six minutes each)."""
    events = inputs.table(spark, sf_dir, "events")
    start = events.agg(F.date_trunc("day", F.min("ts")).alias("t0"))
    minutes = F.explode(F.array(*[F.lit(m) for m in (54, 120, 180, 240, 390)])).alias("m")
    planted = start.select("t0", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"), minutes)
    at = F.expr("t0 + make_dt_interval(i, 0, m, 0)").cast("timestamp").alias("ts")
    planted = planted.select((100 + F.col("i")).cast("bigint").alias("source"), at, F.lit("error").alias("event_type"))
    own = events.select((F.col("user_id") % 10).alias("source"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    arriving = cut(own.unionByName(planted))
    stream = spark.readStream.schema(arriving.schema).parquet(arriving.inputFiles()[0].rsplit("/", 1)[0])
    out = _run(spark, jobs.failure_bursts(stream, F.col("event_type") == "error", seconds=6 * 3600))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("source", shown("burst_start"), shown("burst_end"), "failures")


@query(
    "quality_alerts",
    oracle(
        """
SELECT event_id, round(0.3 * (event_id % 5 / 4.0::DOUBLE) + 0.3 * (event_id % 7 / 6.0::DOUBLE) + 0.4 * (event_id % 11 / 10.0::DOUBLE), 6) AS quality
FROM events
WHERE round(0.3 * (event_id % 5 / 4.0::DOUBLE) + 0.3 * (event_id % 7 / 6.0::DOUBLE) + 0.4 * (event_id % 11 / 10.0::DOUBLE), 6) < 0.5"""
    ),
)
def quality_alerts(spark, sf_dir):
    key = F.col("event_id")
    scored = _events(spark, sf_dir).select(
        "event_id",
        (key % 5 / F.lit(4.0)).alias("completeness"),
        (key % 7 / F.lit(6.0)).alias("consistency"),
        (key % 11 / F.lit(10.0)).alias("confidence"),
    )
    return _run(spark, jobs.quality_alerts(scored)).select("event_id", "quality")


@query(
    "stream_classified",
    oracle(
        """
SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'invoice' ELSE 'document' END AS document_type,
       CASE WHEN event_type = 'purchase' THEN 'invoice' ELSE 'custom' END AS handler FROM events"""
    ),
)
def stream_classified(spark, sf_dir):
    """Classify arriving documents by name: purchases arrive as orders, the rest has no telling name."""
    key = F.col("event_id").cast("string")
    name = F.when(F.col("event_type") == "purchase", F.lit("/purchase_order_")).otherwise(F.lit("/doc_"))
    files = _events(spark, sf_dir).select("event_id", F.concat(F.lit("in"), name, key, F.lit(".pdf")).alias("path"))
    return _run(spark, jobs.classify_stream(files).select("event_id", "document_type", "handler"))


@query(
    "semantic_neighbors",
    oracle(
        """
SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), center), 5) AS similarity
FROM embeddings JOIN (
  SELECT label, list(m ORDER BY i) AS center FROM (
    SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (
      SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label) USING (label)
WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), center) >= 0.1"""
    ),
)
def semantic_neighbors(spark, sf_dir):
    out = semantic.link_semantic(inputs.table(spark, sf_dir, "embeddings"), "label", "vec_id", 0.1)
    return out.select("vec_id", "label", F.round("similarity", 5).alias("similarity"))


@query(
    "semantic_pairs",
    oracle(
        """
SELECT a.vec_id AS source, b.vec_id AS target,
       round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4"""
    ),
)
def semantic_pairs(spark, sf_dir):
    """All pairs of different vectors with a cosine of 0.4 or more (the table's vectors are all different)."""
    out = neighbours.neighbour_pairs(inputs.table(spark, sf_dir, "embeddings"), "vec_id", minimum=0.4)
    return out.select("source", "target", F.round("similarity", 5).alias("similarity"))


@query(
    "semantic_clusters",
    oracle(
        """
WITH RECURSIVE e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT vec_id, b FROM reach JOIN e ON r = a)
SELECT vec_id, (SELECT count(*) FROM e WHERE a = vec_id) AS n_neighbours, min(r) AS cluster FROM reach GROUP BY vec_id"""
    ),
)
def semantic_clusters(spark, sf_dir):
    """Number of vectors near each one, and the least one reached over near vectors."""
    return neighbours.neighbours(inputs.table(spark, sf_dir, "embeddings"), "vec_id", minimum=0.4)


def as_of():
    return F.lit("1998-01-01").cast("date")


@query(
    "insights",
    oracle(
        """
SELECT 'total_by_vendor' AS query, vendor AS key, CAST(sum(total_amount) AS VARCHAR) AS value, count(*) AS n_sources FROM inv GROUP BY vendor
UNION ALL
(SELECT 'top_vendor', vendor, CAST(sum(total_amount) AS VARCHAR), count(*) FROM inv GROUP BY vendor ORDER BY sum(total_amount) DESC, vendor LIMIT 1)
UNION ALL
SELECT 'expiring_contracts', agreement_id, CAST(expiry_date AS VARCHAR), 1 FROM agr
WHERE expiry_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-01' + 90
UNION ALL
SELECT 'invoices_without_po', path, po_number, 1 FROM inv WHERE po_number IS NULL OR po_number NOT IN (SELECT po_number FROM po)
UNION ALL
SELECT 'over_limit', agreement_id, CAST(sum(total_amount) AS VARCHAR), count(*)
FROM inv i JOIN agr a ON a.vendor = i.vendor AND i.invoice_date BETWEEN a.effective_date AND a.expiry_date
GROUP BY agreement_id, cap HAVING sum(total_amount) > cap""",
        "inv",
        "agr",
        "po",
    ),
)
def insights(spark, sf_dir):
    names = ["total_by_vendor", "top_vendor", "expiring_contracts", "invoices_without_po", "over_limit"]
    args = inputs.invoices(spark, sf_dir), inputs.agreements(spark, sf_dir), inputs.purchase_orders(spark, sf_dir)
    return ins.insights(names, *args, as_of())


def _mixed(spark, sf_dir):
    """Agreements, passports and receipts as one corpus of texts with telling file names."""
    a = inputs.agreement_texts(spark, sf_dir).select(F.concat(F.lit("in/contract_"), F.col("ord").cast("string"), F.lit(".pdf")).alias("path"), "text")
    b = inputs.identity_texts(spark, sf_dir).select(F.concat(F.lit("in/passport_"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("path"), "text")
    c = inputs.receipt_texts(spark, sf_dir).select(F.concat(F.lit("in/scan_"), F.col("k").cast("string"), F.lit(".jpg")).alias("path"), "text")
    return a.unionByName(b).unionByName(c)


@query(
    "mixed_batch",
    oracle(
        """
SELECT handler, count(*) AS documents, count(agreement_id) AS agreements, count(zone) AS passports FROM (
  SELECT 'agreement' AS handler, agreement_id, NULL AS zone FROM agr
  UNION ALL SELECT 'kyc', NULL, c_custkey FROM customer UNION ALL SELECT 'custom', NULL, NULL FROM orders)
GROUP BY handler""",
        "agr",
    ),
)
def mixed_batch(spark, sf_dir):
    """Classify, gate, extract per type and unite, then count what was found."""
    results = pipeline.results_of(_mixed(spark, sf_dir))
    return results.groupBy("handler").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count("agreement.metadata.agreement_id").alias("agreements"),
        F.count("kyc.verification.mrz_data.document_number").alias("passports"),
    )


@query(
    "receipt_rules",
    oracle(
        """
SELECT 'R-' || o_orderkey AS receipt_number, o_orderkey % 7 <> 0 AS is_valid FROM orders"""
    ),
)
def receipt_rules(spark, sf_dir):
    """Sequential stages: extract receipts from text, then run their rules; every seventh has a wrong subtotal."""
    from paperloom.operators import validate

    run = pipeline.sequential(
        lambda df: extract.extract_receipt(df), lambda df: df.select("receipt.*"), lambda df: validate.check_rules(df)
    )
    texts = inputs.receipt_texts(spark, sf_dir)
    wrong = F.regexp_replace("text", r"(?m)^Subtotal: .*$", "Subtotal: 0.01")
    out = run(texts.withColumn("text", F.when(F.col("k") % 7 == 0, wrong).otherwise(F.col("text"))))
    return out.select("transaction.receipt_number", "validation.is_valid")


@query(
    "listed_routes",
    oracle("SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'nda' ELSE 'visa' END AS document_type FROM orders ORDER BY 1"),
)
def listed_routes(spark, sf_dir):
    """Registered types that occur in the corpus, sorted."""
    key = F.col("o_orderkey")
    kind = F.when(key % 3 == 0, "invoice").when(key % 3 == 1, "nda").otherwise("visa")
    seen = inputs.table(spark, sf_dir, "orders").select(kind.alias("document_type"))
    return seen.filter(F.col("document_type").isin(kl.route_types())).distinct().orderBy("document_type")


# --- whole batches (T1-T3) -------------------------------------------------------------------------

ROUTING = kl.Routing().register("receipt", keywords=["receipt"])


BATCH = {
    "batch": """
SELECT 'invoice' AS document_type, 'invoice' AS handler, 0.8::DOUBLE AS confidence, 'INV-' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS ref,
       (CAST(round(l_extendedprice * 100) AS BIGINT) + 1250 + CAST(round(l_extendedprice * 100) AS BIGINT) * 7 // 100 + l_orderkey % 90 * 100) / 100.0::DOUBLE AS amount FROM lineitem
UNION ALL SELECT 'receipt', 'receipt', 0.8, 'R-' || o_orderkey,
       (CAST(round(o_totalprice * 100) AS BIGINT) + CAST(round(o_totalprice * 100) AS BIGINT) // 10) / 100.0 FROM orders
UNION ALL SELECT 'agreement', 'agreement', 0.8, agreement_id, NULL FROM agr
UNION ALL SELECT 'kyc', 'kyc', 0.8, 'P' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'), NULL FROM customer
UNION ALL SELECT 'unknown', NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'document', 'custom', 0.5, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0"""
}


@query(
    "batch_results",
    oracle(
        "SELECT document_type, handler, confidence, ref, amount FROM batch",
        "agr",
        extra=BATCH,
    ),
)
def batch_results(spark, sf_dir):
    """All four types, one of them registered by the caller, beside documents that nothing takes."""
    docs = pipeline.process_batch(inputs.batch_documents(spark, sf_dir), routing=ROUTING)["documents"]
    ref = F.coalesce(
        "invoice.metadata.invoice_number", "receipt.transaction.receipt_number", "agreement.metadata.agreement_id", "kyc.metadata.document_id"
    )
    amount = F.coalesce("invoice.financial.total_amount", "receipt.totals.total").cast("double")
    return docs.select("document_type", "handler", "confidence", ref.alias("ref"), amount.alias("amount"))


@query(
    "batch_run_status",
    oracle(
        """
SELECT count(*) AS processed, count(*) FILTER (coalesce(confidence, 0) > 0.7) AS successful,
       count(*) FILTER (coalesce(confidence, 0) <= 0.7) AS failed FROM batch""",
        "agr",
        extra=BATCH,
    ),
)
def batch_run_status(spark, sf_dir):
    return pipeline.process_batch(inputs.batch_documents(spark, sf_dir), routing=ROUTING)["status"]


@query(
    "batch_run_summary",
    oracle(
        """
SELECT document_type, grouping(document_type) = 1 AS is_total, count(*) AS total_documents,
       count(*) FILTER (coalesce(confidence, 0) > 0.7) AS successful_extractions FROM batch GROUP BY ROLLUP (document_type)""",
        "agr",
        extra=BATCH,
    ),
)
def batch_run_summary(spark, sf_dir):
    return pipeline.process_batch(inputs.batch_documents(spark, sf_dir), routing=ROUTING)["summary"]


@query(
    "parallel_branches",
    oracle(
        "SELECT handler, ref FROM batch",
        "agr",
        extra=BATCH,
    ),
)
def parallel_branches(spark, sf_dir):
    """A branch per handler, each with an extractor of its own; rows of no branch pass through."""
    branch = lambda extractor, ref: lambda df: extractor(df, into="r").select("handler", F.col(f"r.{ref}").alias("ref"))
    run = pipeline.parallel(
        {
            "invoice": branch(extract.extract_invoice, "metadata.invoice_number"),
            "receipt": branch(extract.extract_receipt, "transaction.receipt_number"),
            "agreement": branch(extract.extract_agreement, "metadata.agreement_id"),
            "kyc": branch(extract.extract_kyc, "metadata.document_id"),
        },
        before=lambda df: kl.classify_and_route(df, routing=ROUTING),
    )
    return run(inputs.batch_documents(spark, sf_dir)).select("handler", "ref")


@query(
    "stream_processed",
    oracle(
        """
SELECT 'R-' || o_orderkey AS ref, 'invoice' AS handler, round(0.3 * (3 / 6.0) + 0.3 * 0 + 0.4 * 0.8, 6) AS quality FROM orders"""
    ),
)
def stream_processed(spark, sf_dir):
    """Receipts read as invoices by the built-in routes, in a stream: extracted, validated (they lack an
    invoice number) and scored as in a batch."""
    base = new_folder(spark, "texts")
    texts = inputs.receipt_texts(spark, sf_dir).select(F.concat(F.lit("in/receipt_"), F.col("k").cast("string"), F.lit(".pdf")).alias("path"), "text")
    texts.write.parquet(f"{base}/in")
    arriving = spark.readStream.schema("path STRING, text STRING").parquet(f"{base}/in")
    out = _run(spark, jobs.process_stream(arriving).select("path", "handler", "quality"))
    return out.select(F.concat(F.lit("R-"), F.regexp_extract("path", "([0-9]+)", 1)).alias("ref"), "handler", "quality")
