import random
import re

import pytest
import xxhash

from paperloom.llm.multi_index import fingerprint, links, simhash_components
from paperloom.operators.graph import connected

SCHEMA = "doc_id long, text string, bits string, node string, n int"


def reference(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(numbers):
    """Per position the least position reachable over pairs that differ in two bits at most."""
    root = list(range(len(numbers)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(numbers):
        for j in range(i):
            if (x ^ numbers[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(numbers))]


def brute_force(docs):
    docs = sorted(docs)
    numbers = [reference(t) for _, t in docs]
    roots = components(numbers)
    return {k: (f"{x:016x}", docs[r][0]) for (k, _), x, r in zip(docs, numbers, roots, strict=True)}


TEXTS = ["", None, " \t\n", "a", "A b", "a b c", "A  b\tc d \u00c9 \u00c9 x", "w " * 40_000 + "x y z", "\u00a0 one\u2003two"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprints(text):
    assert fingerprint(text) == reference(text)


@pytest.mark.parametrize("centres, flips, n", [(1, 4, 500), (200, 2, 500), (3, 3, 700)])
@pytest.mark.parametrize("crowd", [64, 2])
def test_links_connect_what_all_pairs_connect(spark, centres, flips, n, crowd):
    """Dense clusters in which segments are crowded, sparse ones, and both ways of finding links."""
    random.seed(n + flips)
    middle = [random.getrandbits(64) for _ in range(centres)]
    numbers = set()
    for _ in range(n):
        x = random.choice(middle)
        for _ in range(random.randrange(flips + 1)):
            x ^= 1 << random.randrange(64)
        numbers.add(x)
    numbers = sorted(numbers)
    classes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(numbers)], "bits long, node long")
    got = {r["node"]: r["cluster"] for r in connected(links(classes, crowd)).collect()}
    assert [got.get(i, i) for i in range(len(numbers))] == components(numbers)


def test_links_are_real(spark):
    numbers = [0b111, 0b001, 0b1000, 0, (1 << 40) - 1]
    classes = spark.createDataFrame([(x, i) for i, x in enumerate(numbers)], "bits long, node long")
    pairs = {frozenset(r) for r in links(classes).collect()}
    assert pairs == {frozenset(p) for p in [(0, 1), (1, 2), (1, 3), (2, 3)]}


def test_documents(spark):
    """Nulls, empty texts, equal rows, keys with several texts, clashing columns."""
    rows = [
        (5, "one two three four five six", "x", "y", 1),
        (5, "one two three four five six", "x", "y", 1),
        (2, "One TWO three four five six", None, None, None),
        (9, None, "x", "y", 1),
        (3, "", "x", "y", 1),
        (None, "", "x", "y", 1),
        (7, "quite another text stands here now", "x", "y", 1),
        (7, "one two three four five six", "x", "y", 1),
        (8, "quite another text stands here now", "x", "y", 1),
    ]
    got = simhash_components(spark.createDataFrame(rows, SCHEMA), hot_rows=2)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    found = sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in got.collect())
    text = lambda t: f"{reference(t):016x}"
    one, other, zero = text(rows[0][1]), text(rows[6][1]), "0" * 16
    assert found == sorted(
        [(5, one, 2), (5, one, 2), (2, one, 2), (9, zero, 3), (3, zero, 3), (0, zero, None), (7, other, 2), (7, one, 2), (8, other, 2)],
        key=lambda r: (r[0], r[1]),
    )
    assert simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []
