"""Structured Streaming jobs (R1-R6). Every transformation also runs on a batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from paperloom.operators import classify as kl
from paperloom.operators import link, scoring, validate
from paperloom.operators.aggregate import SKETCH_K
from paperloom.plans import pipeline
from paperloom.session import cut, drop_cut
from paperloom.streaming.store import RunStore

# Fixed values
TTL_HOURS = 168
EXPORT_SECONDS = 60
FAILURE_THRESHOLD = 5
FAILURE_WINDOW = "60 seconds"
FAILURE_SECONDS = 60
FAILURE_SLIDE = "10 seconds"

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def classify_stream(files: DataFrame, routing: kl.Routing | None = None) -> DataFrame:
    """Classify and route every arriving file (R1), as a batch does; stateless, so it needs no watermark."""
    return kl.classify_and_route(files, routing=routing)


def process_stream(docs: DataFrame, routing: kl.Routing | None = None) -> DataFrame:
    """Classify, route, extract, validate and score every arriving text (R1): path, text to results with
    the invoice's report, completeness and quality. Projections only, the same as in a batch."""
    results = validate.validate_invoice(pipeline.results_of(docs, routing=routing), inside="invoice")
    found = F.coalesce(*[F.col(f"{name}.metadata.confidence") for name in pipeline.EXTRACTORS])
    consistent = F.when(F.col("validation.is_valid"), 1.0).when(F.col("validation").isNull(), 1.0).otherwise(0.0)
    return scoring.quality(results.withColumns({"completeness": found, "consistency": consistent}))


REDELIVERY_SALTS = 16


def drop_redelivered(
    stream: DataFrame, ts: str = "ts", key: str = "sha256", ttl_hours: int = TTL_HOURS, salts: int = REDELIVERY_SALTS
) -> DataFrame:
    """Each content once within the TTL (R2). State is bounded: a key is forgotten after the TTL.

    Copies are first dropped per (key, salt), the salt drawn from the arrival time, so that a content that
    arrives very often is spread over tasks; what is left, at most `salts` rows per key, then meets in one.
    """
    marked = stream.withWatermark(ts, f"{ttl_hours} hours").withColumn(
        "_salt", F.pmod(F.xxhash64(F.col(ts)), F.lit(salts))
    )
    thinned = marked.dropDuplicatesWithinWatermark([key, "_salt"])
    return thinned.dropDuplicatesWithinWatermark([key]).drop("_salt")


def minute_sketches(
    stream: DataFrame, value: Column, ts: str = "ts", seconds: int = EXPORT_SECONDS, late: str = "5 minutes", k: int = SKETCH_K
) -> DataFrame:
    """The distribution of a value per export interval (R3), as a KLL sketch of bounded size that can be added up:
    `aggregate.merged_quantiles` gives the quantiles of any longer time. Nulls are left out."""
    window = F.window(ts, f"{seconds} seconds")
    return (
        stream.select(F.col(ts), value.cast("double").alias("_value"))
        .withWatermark(ts, late)
        .groupBy(window.alias("w"))
        .agg(F.count("_value").alias("n"), F.kll_sketch_agg_double("_value", k).alias("sketch"))
        .select(F.col("w.start").alias("window_start"), "n", "sketch")
    )


def minute_metrics(
    stream: DataFrame, failed: Column, confidence: Column, ts: str = "ts", seconds: int = EXPORT_SECONDS, late: str = "5 minutes"
) -> DataFrame:
    """Documents, error rate and mean confidence per export interval."""
    window = F.window(ts, f"{seconds} seconds")
    return (
        stream.withWatermark(ts, late)
        .groupBy(window.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.avg(failed.cast("int")).alias("error_rate"),
            F.avg(confidence).alias("mean_confidence"),
        )
        .select(F.col("w.start").alias("window_start"), "documents", "error_rate", "mean_confidence")
    )


def quality_alerts(stream: DataFrame, limit: float = scoring.ALERT_BELOW) -> DataFrame:
    """Documents whose quality score is below the limit, as they arrive."""
    return scoring.quality(stream, limit).filter("alert")


def failure_windows(
    stream: DataFrame,
    failed: Column,
    source: str = "source",
    ts: str = "ts",
    window: str = FAILURE_WINDOW,
    slide: str = FAILURE_SLIDE,
    minimum: int = FAILURE_THRESHOLD,
    late: str = "5 minutes",
) -> DataFrame:
    """Sliding windows of a fixed grid with at least `minimum` failures of a source: a running view. A burst
    across the grid is seen by no window; `failure_bursts` finds every one."""
    return (
        stream.withWatermark(ts, late)
        .filter(failed)
        .groupBy(F.window(ts, window, slide).alias("w"), F.col(source).alias("source"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .filter(F.col("failures") >= minimum)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source", "failures")
    )


def failure_bursts(
    events: DataFrame,
    failed: Column,
    source: str = "source",
    ts: str = "ts",
    seconds: int = FAILURE_SECONDS,
    minimum: int = FAILURE_THRESHOLD,
    late: str = "5 minutes",
) -> DataFrame:
    """Bursts of failures (R5): source, burst_start, burst_end, failures; of a stream or of a batch.

    `minimum` failures of a source in a row of which the last comes less than `seconds` after the first are a
    span, wherever it begins. Spans that overlap or touch are one burst, which is reported once, with all
    failures from its start to its end. Events without a source or a time are left out.
    """
    seen = events.withWatermark(ts, late) if events.isStreaming else events
    wanted = seen.filter(failed & F.col(source).isNotNull() & F.col(ts).isNotNull())
    rows = wanted.select(F.col(source).alias("source"), F.col(ts).alias("ts"))
    return (_bursts_of_stream if events.isStreaming else _bursts_of_batch)(rows, seconds, minimum)


BLOCK_WINDOWS = 64


def _islands(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overlapping or touching spans (start, end) of one key as one."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    numbered = spans.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order))
    return numbered.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _bursts_of_batch(rows: DataFrame, seconds: int, minimum: int) -> DataFrame:
    """In blocks of BLOCK_WINDOWS windows: a block also sees the last window of the block before it, so that
    no task sorts more than a block of one source; only the blocks' few bursts then meet per source."""
    width = seconds * 1_000_000
    size = width * BLOCK_WINDOWS
    us = F.unix_micros("ts")
    timed = rows.groupBy("source", us.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    block = F.floor(F.col("t") / size)
    seen = F.when(F.pmod("t", F.lit(size)) >= size - width, F.array(block, block + 1)).otherwise(F.array(block))
    # equal times are one row; of n equal ones as many count as a span can need
    each = F.explode(F.sequence(F.lit(1), F.least("n", F.lit(minimum).cast("long")).cast("int")))
    shown = timed.select("source", "t", "n", block.alias("own"), F.explode(seen).alias("block"))
    ordered = shown.select("source", "block", "t", "own", each.alias("i"))
    before = F.lag("t", minimum - 1).over(Window.partitionBy("source", "block").orderBy("t", "i"))
    spans = ordered.withColumn("start", before).filter((F.col("own") == F.col("block")) & (F.col("t") - F.col("start") < width))
    per_block = _islands(spans.select("source", "block", "start", F.col("t").alias("end")), ["source", "block"])
    bursts = _islands(per_block.select("source", "start", "end"), ["source"])
    blocks = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))).alias("own")
    found = bursts.select("source", "start", "end", blocks).join(timed.select("source", "t", "n", block.alias("own")), ["source", "own"])
    counted = found.filter(F.col("t").between(F.col("start"), F.col("end"))).groupBy("source", "start", "end").agg(F.sum("n").alias("failures"))
    return counted.select("source", F.timestamp_micros("start").alias("burst_start"), F.timestamp_micros("end").alias("burst_end"), "failures")


class _Bursts(StatefulProcessor):
    """Per source: failures that wait for the watermark, the last few before it, and the open burst. Times are
    microseconds; equal ones are one entry with their number. A burst is reported when the watermark is so
    far that nothing can join it."""

    def __init__(self, width: int, minimum: int):
        self.width, self.minimum = width, minimum

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        entries = "array<struct<t:long,n:long>>"
        self.state = handle.getValueState("bursts", f"waiting {entries}, recent {entries}, start long, end long, failures long")

    def _load(self) -> tuple:
        if not self.state.exists():
            return {}, [], None
        waiting, recent, start, end, failures = self.state.get()
        return dict(map(tuple, waiting)), list(map(tuple, recent)), None if start is None else (start, end, failures)

    def _store(self, waiting: dict, recent: list, burst: tuple | None) -> None:
        self.state.update((sorted(waiting.items()), recent, *(burst or (None, None, None))))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        waiting, recent, burst = self._load()
        for frame in rows:
            times = frame["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            for t, n in zip(*np.unique(times, return_counts=True), strict=True):
                waiting[int(t)] = waiting.get(int(t), 0) + int(n)
        self._store(waiting, recent, burst)
        self.handle.registerTimer(min(waiting) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, recent, burst = self._load()
        out = []
        for t in sorted(x for x in waiting if x < now):
            recent.append((t, waiting.pop(t)))
            start = self._span(recent)
            if start is not None:
                if burst and start <= burst[1]:
                    burst = (burst[0], t, burst[2] + sum(n for x, n in recent if x > burst[1]))
                else:
                    out += [burst] if burst else []
                    burst = (start, t, sum(n for x, n in recent if x >= start))
            while len(recent) > 1 and sum(n for _, n in recent[1:]) >= self.minimum - 1:
                recent.pop(0)
        if burst and burst[1] + self.width <= now:
            out.append(burst)
            burst = None
        next_due = [min(waiting) // 1000 + 1] if waiting else []
        next_due += [-(-(burst[1] + self.width) // 1000)] if burst else []
        for due in next_due:
            self.handle.registerTimer(due)
        self._store(waiting, recent, burst)
        if out:
            times = [np.array([b[i] for b in out], "datetime64[us]") for i in (0, 1)]
            columns = {"source": [key[0]] * len(out), "burst_start": times[0], "burst_end": times[1]}
            yield pd.DataFrame({**columns, "failures": [b[2] for b in out]})

    def _span(self, recent: list) -> int | None:
        """Where the widest span begins that ends with a failure of the last entry."""
        t, n = recent[-1]
        for j in range(1, min(n, self.minimum) + 1):
            need, start = self.minimum - j, t
            for x, m in reversed(recent[:-1]):
                if need <= 0:
                    break
                need, start = need - m, x
            if need <= 0 and t - start < self.width:
                return start
        return None

    def close(self) -> None:
        pass


def _bursts_of_stream(rows: DataFrame, seconds: int, minimum: int) -> DataFrame:
    """State per source with timers in event time; needs the RocksDB state store, which is set here."""
    rows.sparkSession.conf.set(STATE_STORE, ROCKS_DB)
    kind = rows.schema["source"].dataType.simpleString()
    return rows.groupBy("source").transformWithStateInPandas(
        statefulProcessor=_Bursts(seconds * 1_000_000, minimum),
        outputStructType=f"source {kind}, burst_start timestamp, burst_end timestamp, failures long",
        outputMode="append",
        timeMode="eventTime",
    )


Members = Callable[[DataFrame], DataFrame]


def _groups(spark: SparkSession, store: str) -> RunStore:
    return RunStore(spark, store, link.GROUP, [F.min("first").alias("first"), F.sum("n").alias("n")])


def link_batches(
    store: str, edges: str, detectors: Sequence[Members] = (link.link_filename,)
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that links each micro-batch with all documents seen so far.

    Each detector turns documents into group members. The store (`RunStore`) holds one row per key and run of
    batches: its first document so far and the number of members; a batch reads only the buckets of its
    own keys, and only their narrow rows. Members of a batch are linked with the key's first document. When
    a batch brings a document that comes before it, that one becomes the first, and an edge joins the two,
    so documents may arrive in any order. A replayed batch overwrites its own output. `incremental` has the
    same for references and temporal links.
    `current_links` reads the relationships as they stand.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        groups = _groups(spark, store)
        groups.begin(batch_id)
        found = [detector(batch) for detector in detectors]
        members = cut(reduce(DataFrame.unionByName, found))
        doc = F.struct("ord", "path")
        fresh = members.groupBy(*link.GROUP).agg(F.min(doc).alias("first"), F.count(F.lit(1)).alias("n"))
        firsts = groups.known(fresh, groups.touched(members)).select(*link.GROUP, F.col("first").alias("old_first"))
        state = cut(
            fresh.join(firsts, link.GROUP, "left").withColumn("first", F.least("first", "old_first"))
        )
        groups.add(state.select(fresh.columns), batch_id)
        joined = members.join(state.select(*link.GROUP, "first", "old_first"), link.GROUP)
        arrived = joined.filter(F.col("ord") != F.col("first.ord")).select(
            "first", doc.alias("other"), *link.GROUP, "confidence", "evidence"
        )
        # the old first document is not among the batch's members; it gets their common evidence
        common = members.groupBy(*link.GROUP).agg(F.min("confidence").alias("confidence"), F.min("evidence").alias("evidence"))
        replaced = (
            state.filter(F.col("old_first.ord") != F.col("first.ord"))
            .join(common, link.GROUP)
            .select("first", F.col("old_first").alias("other"), *link.GROUP, "confidence", "evidence")
        )
        out = arrived.unionByName(replaced).select(
            F.col("first.path").alias("source"), F.col("other.path").alias("target"), "type", "confidence", "evidence", "group_key",
            F.col("first.ord").alias("source_ord"), F.col("other.ord").alias("target_ord"),
        )
        out.write.mode("overwrite").parquet(f"{edges}/batch={batch_id}")
        drop_cut(members)
        drop_cut(state)

    return run


def current_links(spark: SparkSession, store: str, edges: str) -> DataFrame:
    """All relationships of `link_batches` so far, from each key's first document to every other one: what
    `link.spanning_edges` finds in all documents at once, whatever order they came in."""
    firsts = _groups(spark, store).current().drop("n")
    found = spark.read.parquet(edges)
    end = lambda side: F.struct(F.col(f"{side}_ord").alias("ord"), F.col(side).alias("path")).alias("doc")
    ends = found.select(*link.GROUP, "confidence", "evidence", F.explode(F.array(end("source"), end("target"))).alias("doc"))
    once = ends.groupBy(*link.GROUP, "doc").agg(F.min("confidence").alias("confidence"), F.min("evidence").alias("evidence"))
    return (
        once.join(firsts, link.GROUP)
        .filter(F.col("doc.ord") != F.col("first.ord"))
        .select(F.col("first.path").alias("source"), F.col("doc.path").alias("target"), "type", "confidence", "evidence", "group_key")
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything that is there now into Parquet files and return them as a table."""
    query: StreamingQuery = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def read_event_stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """Parquet files named `name` in `folder` as a stream; the glob keeps other files out."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)
