import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.llm import thresholds as T
from paperloom.llm.thresholds import certified, judge_quality, keep_good, log_binomial_tail, text_statistics

SCHEMA = "doc_id long, text string, lang string, n_words string, stratum string, kept string"
LABELS = "doc_id long, quality int, toxic int"
SPACES = " \t\n\x0b\x0c\r"


def brute_force(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            words += [word] if word else []
            word = ""
        else:
            word += c
    seen, dup, lines = set(), 0, 0
    for line in (text or "").split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit), lines


def test_statistics():
    rng = random.Random(3)
    texts = ["", " ", "\n", "a", "a a a", "a a a a", "é # é", "a\x85b c d", "x\nx\n x\n\nx"]
    texts += [rng.choice(["", " "]).join(rng.choice(["a", "b", "ab", " ", "\n", "#", "\t", "é"]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for t in texts:
        assert text_statistics(t) == brute_force(t), t


def test_exact_tail():
    for n in (1, 5, 40, 300):
        for p in (0.01, 0.1, 0.5):
            total = 0.0
            for k in range(n + 1):
                total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
                if k <= n * p:
                    assert math.isclose(math.exp(log_binomial_tail(k, n, p)), total, rel_tol=1e-9)
    assert log_binomial_tail(-1, 5, 0.1) == -math.inf and log_binomial_tail(5, 5, 0.1) == 0


def test_certificates_hold_at_their_level():
    """A rule that in truth rejects a share of `risk` is certified no more often than `level` allows."""
    rng = random.Random(7)
    n, risk, level = 400, 0.05, 0.1
    wrong = sum(certified(sum(rng.random() < risk for _ in range(n)), n, risk, level) for _ in range(2000))
    assert wrong / 2000 < level + 0.02
    assert certified(0, 400, risk, level) and not certified(0, 30, risk, level) and not certified(30, 400, risk, level)
    assert not certified(0, 0, risk, level)


def corpus(n=3000):
    """Clean prose, and bad texts full of symbols; labels for all."""
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            words = [w + "#$%" for w in words]
        docs.append((i, " ".join(words), "en" if i % 2 else "de", "", "", ""))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def test_cutoffs_spare_clean_documents(spark):
    docs, labels = corpus()
    frames = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    got = judge_quality(*frames, risk=0.05).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    assert all(not by[i]["kept"] and "symbols_per_word" in by[i]["rejected_by"] for i in range(0, 3000, 5))
    lost = sum(not by[i]["kept"] for i in range(3000) if i % 5)
    assert lost <= 0.05 * 2400
    kept = keep_good(*frames, risk=0.05)
    assert kept.schema.simpleString() == frames[0].schema.simpleString()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in by.items() if r["kept"])


def test_odd_rows_and_missing_labels(spark, monkeypatch):
    monkeypatch.setattr(T, "STRATA", 1)
    long = "word and another one more " * 20_000
    fine = " ".join(f"w{i}" for i in range(80))
    docs = [
        (1, None, "en", "", "", ""), (2, "", None, "", "", ""), (3, long, "en", "", "", ""), (4, fine, None, "", "", ""),
        (4, fine, None, "", "", ""), (None, fine, "xx", "", "", ""), (5, "a b " * 10, "en", "", "", ""),
    ]
    labels = [(None, 1, 0), (4, None, None), (4, 1, None), (99, 1, 0), (1, 0, 1)]
    for some in (labels, []):
        frames = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(some, LABELS)
        got = judge_quality(*frames).collect()
        assert sorted((str(r["doc_id"]), r["base_failed"], r["kept"]) for r in got) == [
            ("1", True, False), ("2", True, False), ("3", True, False), ("4", False, True), ("4", False, True),
            ("5", True, False), ("None", False, True),
        ]
        assert sorted(str(r["doc_id"]) for r in keep_good(*frames).collect()) == ["4", "4", "None"]


@pytest.mark.parametrize("most", [1, 64])
def test_each_stratum_stands_alone(spark, monkeypatch, most):
    """A small language full of symbols loses nothing to cutoffs of the others, labelled or not, and each
    labelled one has its own, at any number of strata."""
    monkeypatch.setattr(T, "STRATA", most)
    docs, labels = corpus()
    odd = " ".join(f"w{i}#$%" for i in range(60))
    docs += [(5000 + i, odd, ("xx", "yy")[i % 2], "", "", "") for i in range(10)]
    labels += [(5000 + i, 1, 0) for i in range(0, 10, 2)]
    frames = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r for r in judge_quality(*frames, risk=0.05).collect()}
    assert all(got[5000 + i]["kept"] for i in range(10))
    assert all("symbols_per_word" in got[i]["rejected_by"] for i in range(0, 3000, 5))
    kept = {r["doc_id"] for r in keep_good(*frames, risk=0.05).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}


def test_empty_tables(spark):
    frames = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert judge_quality(*frames).collect() == [] and keep_good(*frames).collect() == []


@pytest.mark.parametrize("conflict", [(7, 0, 0), (7, 1, 1)])
def test_conflicting_labels_are_not_clean(spark, conflict):
    docs = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(60)), "en", "", "", "")], SCHEMA)
    stats = T._statistics(docs, "doc_id", "text", "lang")
    labels = spark.createDataFrame([(7, 1, 0), conflict], LABELS)
    chosen, largest = T.certified_cutoffs(stats, labels, "doc_id", T.RULES, 0.01, 0.05)
    assert chosen == {} and largest == []


def test_no_stratum_loses_more_than_its_risk():
    """Simulated holdouts of rules that hardly tell clean from bad: the chosen cutoffs rarely cost more than
    the risk in truth, and cutoffs beyond the first failure are not taken."""
    rng = random.Random(10)
    grid, n, risk, level = [10, 20, 30, 40], 1500, 0.04, 0.1
    truth = {40: 0.001, 30: 0.005, 20: 0.011, 10: 0.0}  # 10 would pass, but lies behind 20
    wrong = 0
    for _ in range(300):
        seen = {c: sum(rng.random() < p for _ in range(n)) for c, p in truth.items()}
        chosen = None
        for cutoff in sorted(grid, reverse=True):
            if not certified(seen[cutoff], n, risk / 4, level / 4):
                break
            chosen = cutoff
        wrong += chosen in (10, 20)
    assert wrong / 300 < level / 4 + 0.03


def test_a_repeated_text_is_one_piece_of_evidence(spark):
    """Thousands of rows, or of keys, of one labelled text certify no more than the text does."""
    fine = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    odd = " ".join(f"w{j}#" for j in range(60))
    docs = [(1, fine(0), "en", "", "", "")] * 3000 + [(10 + i, fine(1), "en", "", "", "") for i in range(3000)]
    docs += [(9000, odd, "en", "", "", "")]
    labels = [(1, 1, 0), *[(10 + i, 1, 0) for i in range(3000)]]
    frames = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    stats = T._statistics(frames[0], "doc_id", "text", "lang")
    assert T.certified_cutoffs(stats, frames[1], "doc_id", T.RULES, 0.05, 0.05) == ({}, [])
    assert all(r["kept"] for r in judge_quality(*frames, risk=0.05).collect())


def test_strata_of_any_type(spark):
    docs, labels = corpus()
    frames = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    numbered = frames[0].withColumn("lang", F.when(F.col("lang") == "en", 1.5e10).otherwise(2.0))
    got = {r["doc_id"] for r in judge_quality(numbered, frames[1], risk=0.05).collect() if r["kept"]}
    assert got == {r["doc_id"] for r in keep_good(numbered, frames[1], risk=0.05).collect()}
    assert not got & set(range(0, 3000, 5))
