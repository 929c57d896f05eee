"""The registered queries on the smallest tables, against brute force where SQL has no twin."""

import base64
import hashlib
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from paperloom.llm.queries import ORACLES, QUERIES
from workload.check import TABLES, rows
from tests.llm import test_fingerprints, test_lsh_forest, test_multi_index, test_suffix_dedup, test_thresholds


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def sha(data):
    return hashlib.sha256(data).hexdigest()


def run(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def packed(numbers):
    return b"".join(i.to_bytes(4, "little") for i in numbers)


def test_all_thirteen_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


def test_op2(spark, sf, docs):
    got = {r["doc_id"]: r for r in run(spark, sf, "op2_bucket_pointers")}
    for key, n, spans, kept in test_suffix_dedup.brute_force(docs):
        r = got[key]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, sum(b - a for a, b in spans), len(spans), sha(kept))


def test_op3(spark, sf, docs, ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in run(spark, sf, "op3_packed_mixture"):
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    total = 0
    for key, text in docs:
        own, at = [*ids(text), 0], 0
        total += len(own)
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(packed(own[r["start"] : at]))
        assert at == len(own)
    assert sorted(by_sequence) == list(range(-(-total // 1024)))
    for s, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 1024 or s == max(by_sequence)


def test_op4(spark, sf, docs):
    got = {r["doc_id"]: r for r in run(spark, sf, "op4_quality_thresholds")}
    assert len(got) == len(docs)
    for key, text in docs:
        words, chars, symbols, dup, repeat, _ = test_thresholds.brute_force(text)
        r = got[key]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (words, chars, symbols, dup, repeat)
        assert r["base_failed"] == (words < 50 or 100 * repeat > 50 * words)
        assert not (r["base_failed"] and r["kept"])


def test_op5(spark, sf, docs):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in run(spark, sf, "op5_bpe_matrices")}
    for key, text in docs:
        own = library.encode_ordinary(text or "")
        assert tuple(got[key])[1:] == (len(own), sha(packed(own)), sha((text or "").encode()))


def test_op6(spark, sf):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    largest = defaultdict(int)
    for key, html in pages:
        largest[html] = max(largest[html], key)
    got = {r["page_id"]: tuple(r)[1:] for r in run(spark, sf, "op6_warc_salvage")}
    for key, html in pages:
        digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
        last = largest[html]
        assert got[key] == (len(html), digest, "response" if key == last else "revisit", None if key == last else last)
    assert len(got) == len(pages)


def test_op7(spark, sf, docs):
    got = {r["doc_id"]: r for r in run(spark, sf, "op7_one_permutation")}
    assert len(got) == len(docs)
    ordered = sorted(docs)
    for i, (key, text) in enumerate(ordered):
        following, half = ordered[(i + 1) % len(ordered)][1] or "", len(text or "") // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited.encode()))
        true = test_fingerprints.jaccard(test_fingerprints.shingles(text), test_fingerprints.shingles(edited))
        assert abs(r["near_edited"] - true) < 0.25


def test_op8(spark, sf, docs, ids):
    got = {r["doc_id"]: r["n_tokens"] for r in run(spark, sf, "op8_separator_scan")}
    assert got == {key: len(ids(text)) for key, text in docs}


def test_op9(spark, sf, docs):
    got = {r["doc_id"]: r for r in run(spark, sf, "op9_lsh_forest")}
    want = test_lsh_forest.brute_force(docs, 85)
    for key, text in docs:
        r = got[key]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(test_lsh_forest.shingles(text)), want[key], want[key] == key)


def test_op12(spark, sf, docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in run(spark, sf, "op12_multi_index")}
    assert got == test_multi_index.brute_force(docs)
