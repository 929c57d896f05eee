import bisect
import datetime
import random
import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import containers, link
from paperloom.sources import corpus, results
from paperloom.streaming import incremental, jobs, store


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "b.txt", "sub/c.png"):
        (tmp_path / name).write_bytes(b"12345")
    names = lambda df: sorted(r[0].split("/")[-1] for r in df.select("path").collect())
    assert names(corpus.read_corpus(spark, str(tmp_path))) == ["a.pdf", "c.png"]
    assert names(corpus.read_corpus(spark, str(tmp_path), recursive=False)) == ["a.pdf"]
    assert names(corpus.read_corpus(spark, str(tmp_path), ["*.txt"])) == ["b.txt"]


def test_bytes_are_not_read_for_paths(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    plan = corpus.read_corpus(spark, str(tmp_path)).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_text_and_json_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("grüße\n2", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xfa")
    got = {r["path"].split("/")[-1]: (r["text"], r["error"]) for r in corpus.read_text_docs(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("grüße\n2", None), "b.txt": ("", "invalid UTF-8")}
    (tmp_path / "c.json").write_text('{"a": 1}')
    (tmp_path / "d.json").write_text("{")
    got = {r["path"].split("/")[-1]: (r["data"], r["error"]) for r in corpus.read_json_docs(spark, str(tmp_path), "a INT").collect()}
    assert got["c.json"][0]["a"] == 1 and got["d.json"] == (None, "not valid JSON")
    assert corpus.read_json_docs(spark, str(tmp_path)).filter("try_variant_get(data, '$.a', 'int') = 1").count() == 1


def test_csv_and_xml(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,two\n")
    row = corpus.read_csv_docs(spark, str(tmp_path), "x INT, y STRING").first()
    assert (row["x"], row["y"]) == (1, "two") and row["path"].endswith("a.csv")
    (tmp_path / "b.xml").write_text("<r><item><n>1</n></item><item><n>2</n></item></r>")
    assert sorted(r["n"] for r in corpus.read_xml_docs(spark, str(tmp_path), "item", "n INT").collect()) == [1, 2]


def test_html(spark):
    page = '<html lang="en"><head><title>A &amp; B</title></head><body><!-- x --><script>var a="</p>";</script><p>Hi&nbsp;<a class="c" href="/x?a=1">there</a></p></body></html>'
    row = corpus.html_extract(spark.createDataFrame([(page,)], "html STRING")).first()
    assert (row["text"], row["links"], row["title"], row["lang"]) == ("Hi there", ["/x?a=1"], "A & B", "en")


def test_write_and_read_results(spark, tmp_path):
    invoice = {"document_type": "invoice", "metadata": {"invoice_number": "1", "confidence": 0.5}, "vendor": {"name": "V"}}
    kyc = {"document_type": "kyc", "personal_info": {"full_name": "N"}}
    df = spark.createDataFrame([(json.dumps(invoice),), (json.dumps(kyc),)], "json STRING")
    typed = results.parse_results(df)
    results.write_results(typed.select("invoice.*").filter("metadata IS NOT NULL"), str(tmp_path / "j"), "json")
    back = results.read_results(spark, str(tmp_path / "j")).first()
    assert back["document_type"] == "invoice" and back["invoice"]["vendor"]["name"] == "V" and back["kyc"] is None
    results.write_results(typed.select("invoice.*"), str(tmp_path / "c"), "csv")
    header = spark.read.option("header", "true").csv(str(tmp_path / "c")).columns
    assert "metadata.invoice_number" in header and "line_items" in header
    results.write_results(typed, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError, match="Unsupported format"):
        results.write_results(typed, str(tmp_path / "y"), "yaml")


def test_output_selection(spark):
    df = spark.sql("SELECT 'p' path, named_struct('confidence', 0.5, 'n', 1) a, 0.5 confidence, named_struct('m', 1) metadata")
    out = results.select_output(df, confidence=False, metadata=False, source_references=False)
    assert out.columns == ["a"] and out.schema["a"].dataType.names == ["n"]
    tables = results.outputs(df, df, df, with_aggregated=False, confidence=False)
    assert sorted(tables) == ["documents", "relationships"] and "confidence" not in tables["documents"].columns


def test_watching_a_folder(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    stream = lambda: jobs.classify_stream(corpus.stream_corpus(spark, inbox)).select("path", "document_type", "handler")
    (tmp_path / "in" / "invoice_1.pdf").write_bytes(b"1")
    assert [r["handler"] for r in jobs.run_available(stream(), out, state).collect()] == ["invoice"]
    (tmp_path / "in" / "nda.pdf").write_bytes(b"2")
    assert sorted(r["handler"] for r in jobs.run_available(stream(), out, state).collect()) == ["agreement", "invoice"]


def parquet_stream(spark, tmp_path, batches, ddl):
    folder = tmp_path / "events"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(folder / f"b{i}"))
    return spark.readStream.schema(ddl).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_redelivery_is_dropped_across_batches(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    stream = parquet_stream(spark, tmp_path, [[(t(0), "a"), (t(1), "b"), (t(1), "a")], [(t(5), "a"), (t(6), "c")]], "ts TIMESTAMP, sha256 STRING")
    out = jobs.run_available(jobs.drop_redelivered(stream), str(tmp_path / "o"), str(tmp_path / "s"))
    assert sorted(r["sha256"] for r in out.collect()) == ["a", "b", "c"]


def test_metrics_equal_the_batch_result(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, 0, i % 30, i % 60), i % 7 == 0, (i % 10) / 10) for i in range(300)]
    stream = parquet_stream(spark, tmp_path, [rows, [(datetime.datetime(2024, 1, 2), False, 1.0)]], "ts TIMESTAMP, failed BOOLEAN, confidence DOUBLE")
    got = jobs.run_available(jobs.minute_metrics(stream, F.col("failed"), F.col("confidence")), str(tmp_path / "o"), str(tmp_path / "s"))
    batch = jobs.minute_metrics(spark.createDataFrame(rows, "ts TIMESTAMP, failed BOOLEAN, confidence DOUBLE"), F.col("failed"), F.col("confidence"))
    key = lambda df: sorted((r[0], r[1], round(r[2], 9), round(r[3], 9)) for r in df.collect())
    assert key(got) == key(batch)


def test_sketches_of_minutes_add_up(spark, tmp_path):
    """A day's quantiles from the stored sketches of its minutes: a rank is off by less than 0.1 %."""
    from paperloom.operators.aggregate import merged_quantiles

    n = 200_000
    df = spark.range(n).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 86_400).alias("ts"),
        F.when(F.col("id") % 1000 != 0, F.pmod(F.xxhash64("id"), F.lit(10**9)) / 10**6).alias("v"),
    )
    minutes = jobs.minute_sketches(df, F.col("v"))
    assert minutes.count() == 1440
    ordered = sorted(r["v"] for r in df.filter("v IS NOT NULL").collect())
    for q in (0.05, 0.5, 0.95):
        (got,) = merged_quantiles(minutes, F.to_date("window_start").alias("day"), quantile=q).collect()
        assert got["documents"] == len(ordered)
        assert abs(bisect.bisect_right(ordered, got["value"]) / len(ordered) - q) < 0.001
    none = minutes.limit(1).select("window_start", F.lit(0).alias("n"), F.lit(None).cast("binary").alias("sketch"))
    assert [(r["documents"], r["value"]) for r in merged_quantiles(none, "window_start").collect()] == [(0, None)]
    assert merged_quantiles(none.filter("n > 0"), "window_start").collect() == []
    nulls = jobs.minute_sketches(df.withColumn("v", F.lit(None).cast("double")).limit(5), F.col("v"))
    assert {(r["documents"], r["value"]) for r in merged_quantiles(nulls, F.lit(1).alias("all")).collect()} == {(0, None)}


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_failure_windows_need_five_in_a_minute(spark):
    rows = [(at(s), "a", True) for s in (1, 2, 3, 4, 5)] + [(at(s), "b", True) for s in (1, 2, 3, 4)] + [(at(5), "b", False)]
    df = spark.createDataFrame(rows, "ts TIMESTAMP, source STRING, failed BOOLEAN")
    assert {r["source"] for r in jobs.failure_windows(df, F.col("failed")).collect()} == {"a"}


def bursts_by_hand(rows, seconds=60, minimum=5):
    by_source = {}
    for t, source, failed in rows:
        if failed and source is not None and t is not None:
            by_source.setdefault(source, []).append(t)
    out = []
    for source, times in by_source.items():
        times.sort()
        spans = [(times[i - minimum + 1], times[i]) for i in range(minimum - 1, len(times))]
        merged = []
        for a, b in sorted(s for s in spans if (s[1] - s[0]).total_seconds() < seconds):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out += [(source, a, b, sum(a <= t <= b for t in times)) for a, b in merged]
    return sorted(out)


def burst_rows():
    random.seed(4)
    rows = [(at(s), "edge", True) for s in (9, 20, 30, 40, 65)] + [(at(s), "wide", True) for s in (0, 20, 30, 40, 60)]
    rows += [(at(s), "ties", True) for s in (9, 9, 9, 200, 200, 200, 200, 200, 259.9, 500)]
    for source, step in (("slow", 40), ("fast", 9), ("mixed", 14)):
        t = 0.0
        for _ in range(400):
            t += random.expovariate(1 / step)
            rows.append((at(round(t, random.choice([0, 3, 6]))), source, random.random() < 0.9))
    rows += [(at(s / 10), "hot", True) for s in range(1500)] + [(None, "edge", True), (at(10), None, True)]
    return rows


def test_failure_bursts_wherever_they_begin(spark):
    rows = burst_rows()
    df = spark.createDataFrame(rows, "ts TIMESTAMP, source STRING, failed BOOLEAN")
    want = bursts_by_hand(rows)
    assert ("edge", at(9), at(65), 5) in want and not [w for w in want if w[0] == "wide"]
    assert sorted(map(tuple, jobs.failure_bursts(df, F.col("failed")).collect())) == want
    assert jobs.failure_bursts(df.limit(0), F.col("failed")).collect() == []


def test_failure_bursts_of_a_stream(spark, tmp_path):
    """Events in several batches, out of order within the allowed lateness."""
    rows = sorted((r for r in burst_rows() if None not in r), key=lambda r: r[0])
    random.seed(6)
    rows = sorted(rows, key=lambda r: r[0] + datetime.timedelta(seconds=random.uniform(0, 200)))
    size = len(rows) // 6
    batches = [rows[i * size : (i + 1) * size] for i in range(5)] + [rows[5 * size :], [(at(40_000), "end", True)]]
    stream = parquet_stream(spark, tmp_path, batches, "ts TIMESTAMP, source STRING, failed BOOLEAN")
    found = jobs.failure_bursts(stream, F.col("failed"), late="10 minutes")
    out = jobs.run_available(found, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, out.collect())) == bursts_by_hand(rows)


def test_linking_batches_is_complete_and_repeatable(spark, tmp_path):
    store, edges = str(tmp_path / "store"), str(tmp_path / "edges")
    run = jobs.link_batches(store, edges)
    docs = [(5, "a/INV-1.pdf"), (1, "b/INV-1.pdf"), (2, "c/INV-1.pdf"), (3, "INV-2.pdf"), (0, "d/INV-1.pdf"), (9, "INV-2.pdf")]
    frame = lambda rows: spark.createDataFrame(rows, "ord BIGINT, path STRING")
    run(frame(docs[:1]), 0)
    run(frame(docs[1:4]), 1)  # an earlier document than the stored one arrives late
    run(frame(docs[1:4]), 1)  # replay
    run(frame(docs[4:]), 2)
    found = {(r["source_ord"], r["target_ord"]) for r in spark.read.parquet(edges).collect()}
    assert found == {(1, 2), (1, 5), (0, 1), (3, 9)}
    got = sorted((r["source"], r["target"]) for r in jobs.current_links(spark, store, edges).collect())
    whole = sorted((r["source"], r["target"]) for r in link.spanning_edges(link.link_filename(frame(docs))).collect())
    assert got == whole


def test_runs_of_a_store_double_and_survive_replays(spark, tmp_path):
    path = str(tmp_path / "store")
    new = lambda: store.RunStore(spark, path, ["k"], [F.sum("n").alias("n")])
    rows = lambda b: spark.createDataFrame([(f"k{b % 3}", b), ("all", 1)] if b != 4 else [], "k STRING, n BIGINT")
    for batch in [0, 1, 1, 2, 3, 3, 4, 5, 6]:
        runs = new()
        runs.begin(batch)
        assert len(runs.runs) == bin(batch).count("1")
        seen = {r["k"]: r["n"] for r in runs.known(rows(0), list(range(store.BUCKETS))).collect()}
        assert seen.get("all", 0) == batch - (batch > 4)
        runs.add(rows(batch), batch)
    assert {r["k"]: r["n"] for r in new().current().collect()} == {"k0": 0 + 3 + 6, "k1": 1, "k2": 2 + 5, "all": 6}
    (tmp_path / "store" / "run=7-7").mkdir()  # a batch that failed while it was written
    assert {r["k"]: r["n"] for r in new().current().collect()}["all"] == 6
    runs = new()
    runs.begin(7)
    assert runs.runs == [(0, 3), (4, 5), (6, 6)] and not (tmp_path / "store" / "run=7-7").exists()


def _some_letters():
    """Documents that hold and name ids: none, their own, others', some held by several and some by none."""
    random.seed(11)
    ids = [f"INV-{i}" for i in range(12)] + [f"AGR-{i}" for i in range(3)]
    rows = [(100, "own", "see INV-1 and INV-1", "INV-1"), (101, "none", "INV-999", None), (102, "empty", None, None)]
    for i in range(80):
        text = " ".join(random.sample(ids, random.randint(0, 4)))
        rows.append((i, f"d{i}", text, random.choice([*ids, None, None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_references_of_batches_are_those_of_all_documents(spark, tmp_path, seed):
    rows = _some_letters()
    schema = "ord BIGINT, path STRING, text STRING, own_id STRING"
    random.seed(seed)
    random.shuffle(rows)
    base, edges = str(tmp_path / "store"), str(tmp_path / "edges")
    run = incremental.reference_batches(base, edges)
    parts = [rows[:7], rows[7:9], [], rows[9:40], rows[40:]]
    for number, part in enumerate(parts):
        run(spark.createDataFrame(part, schema), number)
        if number % 2:
            run(spark.createDataFrame(part, schema), number)  # replay
        seen = [r for p in parts[: number + 1] for r in p]
        want = sorted(map(tuple, link.link_reference(spark.createDataFrame(seen, schema)).collect()))
        assert sorted(map(tuple, incremental.current_references(spark, base, edges).collect())) == want
    assert len(want) > 40
    once = spark.read.parquet(edges).groupBy("ord", "group_key").count().filter("count > 1")
    assert once.isEmpty()


def test_waiting_mentions_are_stored_without_a_shuffle_by_mention(spark, tmp_path, monkeypatch):
    """A document that comes twice in a batch waits as two equal rows, which merge when they are read."""
    schema = "ord BIGINT, path STRING, text STRING, own_id STRING"
    plans, add = [], store.RunStore.add

    def seen(self, rows, batch):
        plans.append((self.path, rows._jdf.queryExecution().optimizedPlan().toString()))
        add(self, rows, batch)

    monkeypatch.setattr(store.RunStore, "add", seen)
    base, edges = str(tmp_path / "store"), str(tmp_path / "edges")
    run = incremental.reference_batches(base, edges)
    run(spark.createDataFrame([(1, "a", "see AGR-1", None)] * 2, schema), 0)
    run(spark.createDataFrame([(2, "b", "", "AGR-1")], schema), 1)
    assert [tuple(r)[:2] for r in incremental.current_references(spark, base, edges).collect()] == [("a", "b")]
    waiting = [plan for path, plan in plans if path.endswith("/waiting")]
    assert len(waiting) == 2 and not any("Aggregate" in plan or "Deduplicate" in plan for plan in waiting)


def test_temporal_links_of_batches_are_those_of_all_documents(spark, tmp_path):
    random.seed(5)
    day = lambda: datetime.date(2023, 12, 1) + datetime.timedelta(days=random.randint(0, 200))
    rows = [(i, f"d{i}", random.choice(["a", "b", "b", None]), day()) for i in range(90)] + [(500, "x", "a", None)]
    random.shuffle(rows)
    schema = "ord BIGINT, path STRING, vendor STRING, date DATE"
    base, edges = str(tmp_path / "store"), str(tmp_path / "edges")
    run = incremental.in_turn(incremental.temporal_batches(base, edges, "vendor", "date", 10))
    for number, part in enumerate([rows[:30], rows[30:31], [], rows[31:70], rows[70:]]):
        run(spark.createDataFrame(part, schema), number)
        run(spark.createDataFrame(part, schema), number)  # replay
    whole = link.link_temporal(spark.createDataFrame(rows, schema), "vendor", "date", 10)
    want = sorted(map(tuple, whole.collect()))
    got = incremental.current_temporal(spark, base, 10).select(whole.columns)
    assert sorted(map(tuple, got.collect())) == want
    # the links written batch by batch, the latest of each two days, are the same
    latest = spark.read.parquet(edges).groupBy("block", "day_a", "day_b").agg(F.max_by(F.struct(*whole.columns[3:]), "batch").alias("l"))
    assert sorted(map(tuple, latest.select("block", "day_a", "day_b", "l.*").select(whole.columns).collect())) == want


def test_links_of_changed_days_are_not_shuffled_again(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [(b, day(n), 1 + n % 2, (n, f"{b}{n}"), (n + 1, f"{b}{n}x"), n in (3, 20, 21)) for b in "ab" for n in (0, 3, 4, 9, 13, 20, 21, 40)]
    pair = "STRUCT<ord: BIGINT, path: STRING>"
    cells = spark.createDataFrame(rows, f"block STRING, day DATE, n BIGINT, first {pair}, last {pair}, changed BOOLEAN")
    links = link.link_cells(cells, 10, F.col("changed"))
    new = [day(n) for n in (3, 20, 21)]
    whole = link.link_cells(cells.drop("changed"), 10).collect()
    want = [tuple(r) for r in whole if r["day_a"] in new or r["day_b"] in new]
    assert sorted(map(tuple, links.collect())) == sorted(want) and 0 < len(want) < len(whole)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1, plan  # the flag comes with the cells


def test_a_hot_content_is_thinned_before_it_meets(spark, tmp_path):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, s // 60, s % 60)
    stream = parquet_stream(spark, tmp_path, [[(t(i), "hot") for i in range(200)], [(t(i), "hot") for i in range(200, 300)]], "ts TIMESTAMP, sha256 STRING")
    out = jobs.run_available(jobs.drop_redelivered(stream), str(tmp_path / "o"), str(tmp_path / "s"))
    assert out.columns == ["ts", "sha256"] and [r["sha256"] for r in out.collect()] == ["hot"]


def test_decompose_feeds_from_a_corpus_scan(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as zf:
        zf.writestr("a.txt", "1")
    got = containers.decompose(corpus.read_corpus(spark, str(tmp_path), ["*.zip"]))
    assert [r["path"].split("/")[-1] for r in got["documents"].collect()] == ["a.txt"]


def test_written_tables_can_be_removed(spark):
    import os

    from paperloom.session import clean_up, cut, drop_cut

    df = cut(spark.range(3))
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder) and df.count() == 3
    drop_cut(df)
    assert not os.path.exists(folder)
    cut(spark.range(3))
    assert clean_up(spark) >= 2 and clean_up(spark) == 0
    with pytest.raises(ValueError, match="not a table written by cut"):
        drop_cut(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))


def test_results_are_written_with_the_options_of_the_writers(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "named_struct('name', concat('same text ', id)) AS vendor")
    for fmt, count in (("json", lambda p: spark.read.json(p)), ("csv", lambda p: spark.read.option("header", "true").csv(p))):
        results.write_results(df, f"{tmp_path}/{fmt}", fmt, compression="gzip")
        assert list((tmp_path / fmt).glob("part-*.gz")) and not list((tmp_path / fmt).glob(f"part-*.{fmt}"))
        assert count(f"{tmp_path}/{fmt}").count() == 50
