"""The pipeline stage by stage against brute force, on a fixture with every kind of copy."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline as P
from paperloom.llm.common import settle
from tests.llm.test_lsh_forest import brute_force as components
from tests.llm.test_packing import reference  # noqa: F401
from tests.llm.test_suffix_dedup import brute_force as repeats
from tests.llm.test_thresholds import brute_force as statistics

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    prose = lambda n: [f"wörd{rng.randrange(4000)}" for _ in range(n)]
    passage = " ".join(prose(60))
    texts = [None, "", "too short", "again and again " * 60]
    for _ in range(12):
        base = prose(rng.randint(60, 300))
        texts += [" ".join(base)] * rng.randint(1, 3)
        texts.append(" ".join(w if rng.random() > 0.004 else "edit" for w in base))
        texts.append(" ".join(prose(50)) + "\n" + passage + "\n" + " ".join(prose(50)))
    rng.shuffle(texts)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, " ".join(prose(70)), None, None, None), (3, rows[3][1], "en", "s0", 1)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark, folder, reference):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality rules", "near-dedup", "suffix-array dedup", "packing"]
    (_, quality), (_, near), (_, cut), (_, pack) = P.STAGES

    def good(text):
        n, _, _, _, repeat, _ = statistics(text)
        return n >= 50 and 100 * repeat <= 50 * n

    first = settle(quality(spark, docs, folder))
    assert first.columns == docs.columns
    assert rows_of(first) == [r for r in rows_of(docs) if good(r[1])]

    second = settle(near(spark, first, folder))
    want = components([(r[0], r[1]) for r in first.collect()], P.NEAR_PERCENT)
    kept = sorted({r for r in rows_of(first) if r[0] is None or want[r[0]] == r[0]}, key=str)
    assert second.columns == docs.columns and len({r[0] for r in kept}) == second.count()
    assert {r[:4] for r in rows_of(second)} <= {r[:4] for r in kept}

    third = settle(cut(spark, second, folder))
    spans = {key: kept for key, _, _, kept in repeats([(r[0], r[1]) for r in second.collect()], P.REPEATED_BYTES)}
    removed = 0
    for r in third.collect():
        exact, own = spans[r["doc_id"]], r["text"].encode()
        # characters that a span cuts in two stay whole; all else is what brute force leaves
        assert 0 <= len(own) - len(exact) < 80 and r["n_chars"] == len(r["text"])
        if len(own) == len(exact):
            assert own == exact
        removed += r["text"] != next(s[1] for s in kept if s[0] == r["doc_id"])
    assert third.columns == docs.columns and third.count() == second.count() and removed >= 8

    pieces = pack(spark, third, folder).collect()
    lengths = defaultdict(int)
    for p in pieces:
        lengths[p["doc_id"]] += p["length"]
    assert lengths == {r["doc_id"]: len(reference(r["text"])) for r in third.collect()}

    whole = defaultdict(int)  # which piece goes to which sequence depends on how the input is split
    for p in P.run(spark, folder).collect():
        whole[p["doc_id"]] += p["length"]
    assert whole == lengths


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'a' AS kept", "1 AS _text", "doc_id AS key", "2 AS carried")
    for _, stage in P.STAGES[:3]:
        docs = settle(stage(spark, docs, folder))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "_text", "key", "carried"]
    assert {(r["kept"], r["_text"], r["carried"]) for r in docs.collect()} == {("a", 1, 2)}
    assert P.STAGES[3][1](spark, docs, folder).count() > 0
