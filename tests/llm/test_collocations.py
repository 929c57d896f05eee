import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import collocations as module
from paperloom.llm.collocations import collocations, split_words
from paperloom.llm.transducer import build, compose, count_windows, grams_of, pack, union, unpack

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SCHEMA = "text string, lang string, n string, label string, gram int"


def pieces_of(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute_force(docs, least, top, longest=5, percent=100):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inner = lambda g: {g[i:j] for i in range(len(g)) for j in range(i + 2, len(g) + 1)} - {g}
        dropped = {s for g, a in found.items() for s in inner(g) if 100 * a >= percent * found[s]}
        rows = []
        for g, a in found.items():
            if g not in dropped:
                score, k = min((1000 * a * n[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def documents():
    random.seed(11)
    words = ["a", "B", "c\u00e9", "dd", "e", "x\U0001d4b3", "Fo"]
    ends = ["", "", "", ".", ",", "\t", "\n"]
    text = lambda: " ".join(random.choice(words) + random.choice(ends) for _ in range(random.randrange(40)))
    docs = [(text(), random.choice(["en", "en", None, "de"])) for _ in range(150)]
    docs += [(None, "en"), ("", "en"), ("  .", None), ("a b c d e f", None)] * 3
    docs += [("of the same kind as before. ", "en")] * 9 + [("a b " * 3000, "en"), ("x" * 5000 + " y", "fr")]
    return docs


CASES = [
    dict(least=5, top=20, shard_words=200, range_words=50),
    dict(least=3, top=2000),
    dict(least=2, top=50, percent=60, range_words=300),
    dict(least=4, top=30, longest=3, shard_words=50),
    dict(least=2, top=10, longest=2),
]


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, monkeypatch, case):
    """Few and many shards and ranges, hot first words dealt on, small steps."""
    docs = documents()
    df = spark.createDataFrame([(*d, "x", "y", 1) for d in docs], SCHEMA).repartition(5)
    got = collocations(df, **case)
    assert got.columns == COLUMNS
    wanted = {k: v for k, v in case.items() if not k.endswith("_words")}
    assert sorted(map(tuple, got.collect())) == brute_force(docs, **wanted)


def test_nothing_to_count(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations(empty).collect() == []
    assert collocations(spark.createDataFrame([(None, None, "", "", 0), ("one two", "en", "", "", 0)], SCHEMA)).collect() == []


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    docs = documents()
    monkeypatch.setattr(module, "bitmap", lambda marks: np.full(1 << (module.BITS - 6), np.uint64(2**64 - 1)))
    got = collocations(spark.createDataFrame(docs, "text string, lang string"), least=4, top=40)
    assert sorted(map(tuple, got.collect())) == brute_force(docs, 4, 40)


@pytest.mark.parametrize("step", [1, 7, 1 << 19])
def test_words_of_any_step(monkeypatch, step):
    monkeypatch.setattr(module, "STEP", step)
    texts = ["One two.Three", "", None, "longer-than-a-step \u00c4B\tx,,y", "tail"]
    found = split_words(pa.array(texts), ["a"] * len(texts))
    assert [found.word(i) for i in range(len(found.label))] == [w for t in texts for p in pieces_of(t) for w in p]
    assert len(set(found.piece.tolist())) == sum(bool(p) for t in texts for p in pieces_of(t))


def test_transducers_against_counting():
    random_ = np.random.default_rng(0)
    for _ in range(150):
        n, v = int(random_.integers(0, 60)), int(random_.integers(1, 6))
        labels = random_.integers(1, v + 1, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        least = int(random_.integers(1, 4))
        most = int(random_.integers(least, 6))
        lengths = np.minimum(random_.integers(0, 7, n), n - np.arange(n))
        grams = count_windows(labels, np.arange(n), lengths, least, most)
        want = Counter()
        for i in range(n):
            for k in range(least, min(most, lengths[i]) + 1):
                want[tuple(labels[i : i + k].tolist())] += 1
        as_dict = lambda g: {tuple(x for x in r if x): int(w) for r, w in zip(g.labels().tolist(), g.weights, strict=True)}
        machine = unpack(pack(build(grams)))
        assert as_dict(grams) == as_dict(grams_of(machine)) == want
        assert as_dict(union([grams_of(machine), grams, grams])) == {k: 3 * c for k, c in want.items()}
        asked = [list(k) for k in want] + [[1, 2, 3], [5]]
        width = max(map(len, asked))
        rows = np.array([x + [0] * (width - len(x)) for x in asked], np.uint64)
        assert compose(rows, machine).tolist() == [want.get(tuple(x), 0) for x in asked]


def test_common_ends_are_stored_once():
    labels = np.array([1, 7, 8, 9, 2, 7, 8, 9, 3, 7, 8, 9], np.uint64)
    machine = build(count_windows(labels, np.array([0, 4, 8]), np.full(3, 4), 4, 4))
    assert len(machine.label) == 3 + 3 and machine.start == 4
