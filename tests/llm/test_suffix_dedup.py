import hashlib
import random

import numpy as np
import pytest

from paperloom.llm import suffix_dedup
from paperloom.llm.suffix_dedup import Q, filed, refine, remove_repeats, without_repeats

SCHEMA = "doc_id long, text string, n_bytes string, spans string, chunk string"


def brute_force(rows, length=50):
    """Spans per row: strings of `length` bytes that also start in a document of smaller key."""
    rank = lambda k: float("inf") if k is None else k
    first = {}
    for key, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, float("inf")), rank(key))
    out = []
    for key, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < rank(key):
                gone[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        out.append((key, len(b), spans, bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]]) if b else b""))
    return out


def check(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(k, t, "x", "x", "x") for k, t in rows], SCHEMA).repartition(parts)
    got = [
        (r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"]), r["n_removed"])
        for r in remove_repeats(df, **more).collect()
    ]
    want = [(*w, sum(b - a for a, b in w[2])) for w in brute_force(rows, more.get("length", 50))]
    order = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    return want


def corpus(seed, n, alphabet="abcdefgh  \né"):
    rng = random.Random(seed)
    prose = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [prose(rng.randint(40, 300)) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [prose(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randint(30, 300)], prose(rng.randint(0, 60))]
        texts.append("".join(parts))
        if rng.random() < 0.2:
            texts.append(texts[rng.randrange(len(texts))])
    keys = list(range(len(texts)))
    rng.shuffle(keys)
    return list(zip(keys, texts, strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_passages(spark, seed):
    want = check(spark, corpus(seed, 60))
    assert sum(w[4] for w in want) > 1000


def test_hot_buckets(spark):
    """With a limit of 2, nearly every shared bucket is dealt out string by string."""
    check(spark, corpus(11, 60), hot=2)


def test_low_entropy(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab") * rng.randint(1, 60) for _ in range(12))) for i in range(25)]
    rows += [(100, "a" * 500), (101, "a" * 49), (102, "a" * 50), (103, "ab" * 200), (104, "ba" * 120 + "a" * 70)]
    check(spark, rows)


def test_edges(spark):
    s = "0123456789" * 5
    rows = [(5, s), (3, s), (9, s[:49]), (8, "x" + s), (7, s + "y"), (6, s[25:] + s[:25]), (1, None), (2, ""), (10, "é" * 30)]
    rows += [(11, "éa" + "é" * 28), (None, s + "tail of a row without key"), (None, s), (4, s * 3), (4, s * 3)]
    check(spark, rows)


def test_matches_do_not_cross_documents(spark):
    a, b = "q" * 10 + "wertyuiopasdfghjklzxc", "vbnm" * 10
    check(spark, [(1, a + b), (2, a), (3, b)], parts=1)


def test_segments_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 128)
    flat = np.frombuffer(corpus(5, 1)[0][1].encode() * 40, np.uint8)
    offsets = np.array([0, 300, 300, 700, len(flat)])
    strings = []
    for _, _, _, first, last in filed(flat, offsets, 50):
        strings += [s for a, b in zip(first, last, strict=True) for s in range(a, b + 1)]
    want = [s for a, b in zip(offsets, offsets[1:]) for s in range(a, b - 49)]
    assert sorted(strings) == want


def test_other_length(spark):
    check(spark, corpus(6, 40), length=33)


def test_whole_characters(spark):
    shared = "é" * 40
    rows = [(1, shared, "", "", ""), (2, "a" + shared[:-1] + "ê", "", "", "")]
    got = {r["doc_id"]: r["kept"] for r in remove_repeats(spark.createDataFrame(rows, SCHEMA), chars=True).collect()}
    assert got[1] == shared and got[2] == "aê"


def test_documents_keep_their_columns(spark):
    rows = [(1, "t" * 60, "n", "s", "c"), (2, "u" + "t" * 60, None, "s2", "c2"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = without_repeats(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "t" * 60, "n", "s", "c"), (2, "u", None, "s2", "c2"), (None, "", None, None, None)], key=str
    )


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("length", [30, 40, 50, 81])
def test_refine_against_sets(length):
    """Widths that are doubled once or more, whole or in part; every place looks up refined pointers."""
    rng = random.Random(9)
    text = np.frombuffer("".join(rng.choice("ab") for _ in range(4000)).encode() * 2, np.uint8)
    start = np.flatnonzero([rng.random() < 0.8 for _ in range(len(text) - length + 1)])
    rank = np.array([rng.randrange(5) for _ in start])
    first = {}
    for s, r in zip(start, rank, strict=True):
        key = text[s : s + length].tobytes()
        first[key] = min(first.get(key, 9), r)
    want = [first[text[s : s + length].tobytes()] < r for s, r in zip(start, rank, strict=True)]
    assert refine(text, start, rank, length).tolist() == want
    assert refine(text, start[:0], rank[:0], length).tolist() == []


def test_query_digest(spark, sf):
    from paperloom.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {w[0]: w for w in brute_force(rows)}
    for r in QUERIES["op2_bucket_pointers"](spark, sf).collect():
        key, n, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, sum(b - a for a, b in spans), len(spans))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
