import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm.fingerprints import BINS, LOW_BITS, fingerprint, fingerprint_edits, likeness

SCHEMA = "doc_id long, text string, h string, half string, fingerprint string, n_chars string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / max(1, len(a | b))


def check(spark, rows):
    df = spark.createDataFrame([(k, t, "x", "x", "x", "x") for k, t in rows], SCHEMA).repartition(5)
    got = fingerprint_edits(df).collect()
    signed = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64
    docs = sorted({(k, t or "") for k, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    assert len(got) == len(docs)
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    prints = {}
    for i, (key, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = by[key, len(text)]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for t, p in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(t, p) == p and len(p) in (0, BINS * LOW_BITS // 4)
        for near, other in ((r["near_edited"], edited), (r["near_next"], following)):
            assert 0 <= near <= 1 and abs(near - jaccard(shingles(text), shingles(other))) < 0.25
            if text == other:
                assert near == 1
    return by


def test_corpus(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 5, 9, 60, 400, 900])))) for i in range(60)]
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, "é\n" * 301)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(None, "no key at all here"), (1, None), (2, ""), (3, " \n "), (4, "a"), (5, "x y z " * 20_000), (5, "same key"), (6, "r r"), (6, "r r")]
    got = check(spark, rows)
    assert got[2, 0]["fingerprint"] == "" and got[1, 0]["near_next"] == 1.0


def test_alone_and_empty(spark):
    check(spark, [(7, "one two three four five six")])
    assert fingerprint_edits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimates_are_unbiased(spark):
    """Mean error over pairs of known similarity: densification and the correction for chance leave no bias."""
    rng = random.Random(6)
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 300]))]
        cut = rng.randrange(5, len(words))
        rows.append((i, " ".join(words), " ".join(words[:cut] + [f"v{rng.randrange(10**6)}" for _ in words[cut:]])))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    prints = df.select("a", "b", fingerprint(F.col("a")).alias("fa"), fingerprint(F.col("b")).alias("fb"))
    got = prints.select("a", "b", likeness(F.col("fa"), F.col("fb")).alias("near")).collect()
    errors = [r["near"] - jaccard(shingles(r["a"]), shingles(r["b"])) for r in got]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.2


def test_no_python_on_the_path(spark, sf):
    from paperloom.llm.queries import QUERIES

    plan = QUERIES["op7_one_permutation"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("text", ["", "a b", "a b c d e f g"])
def test_fingerprint_of_equal_texts(spark, text):
    df = spark.createDataFrame([(text,), (text,)], "t string").select(fingerprint(F.col("t")).alias("f"))
    assert len({r["f"] for r in df.collect()}) == 1
