import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import lsh_forest as L
from paperloom.llm.lsh_forest import depth_for, link_sets, near_duplicates
from paperloom.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, component_id string, cluster string, node string, bucket string"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows, percent):
    """component per key, over all pairs."""
    sets = defaultdict(list)
    for key, text in rows:
        if key is not None and shingles(text):
            sets[key].append(shingles(text))
    parent = {key: key for key, _ in rows if key is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {key: find(key) for key in parent}


def check(spark, rows, percent=85, **more):
    df = spark.createDataFrame([(k, t, "x", "x", "x", "x") for k, t in rows], SCHEMA).repartition(4)
    got = near_duplicates(df, percent=percent, **more).collect()
    assert len(got) == len(rows)
    want = brute_force(rows, percent)
    sizes = defaultdict(set)
    for key, text in rows:
        sizes[key].add(len(shingles(text)))
    for r in got:
        assert r["n_shingles"] in sizes[r["doc_id"]]
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is not None and want[r["doc_id"]] == r["doc_id"])


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed, groups, size, edits, words=120):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = prose(rng, words)
        rows += [" ".join(edited(rng, base, rng.randint(0, edits))) for _ in range(size)]
    rows += [" ".join(prose(rng, rng.randint(1, 200))) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [85, 80])
def test_small_groups(spark, percent):
    check(spark, corpus(1, 25, 3, 3), percent)


def test_stars_and_chains(spark):
    """Near copies of one text that are near each other only through it, and chains of edits."""
    rng = random.Random(2)
    base = prose(rng, 150)
    rows = [" ".join(base)] + [" ".join(edited(rng, base, 2)) for _ in range(120)]
    chain = prose(rng, 150)
    for _ in range(15):
        chain = edited(rng, chain, 1)
        rows.append(" ".join(chain))
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_dense_regions_and_large_clusters(spark):
    """Tiny limits: regions are cut by depth, clusters are dealt out in blocks."""
    check(spark, corpus(3, 2, 80, 1), region_rows=16, cluster_shingles=2000, block_rows=16)


def template(seed, texts, own, words=200):
    """Texts alike just below the threshold of 85 %: a common template with `own` words of each text behind it,
    and a few that share so many of another one's own words that the two are just above."""
    rng = random.Random(seed)
    base = prose(rng, words)
    rows = [base + [f"o{i}x{j}" for j in range(own)] for i in range(texts)]
    rows += [rows[i][:-16] + [f"p{i}x{j}" for j in range(16)] for i in range(0, texts, 10)]
    rng.shuffle(rows)
    return list(enumerate(" ".join(r) for r in rows))


def test_single_links_in_a_large_cluster(spark):
    """Many pairs share no run of neighbours: only a comparison of all blocks finds them all."""
    check(spark, template(5, 200, 20), cluster_shingles=2000, block_rows=4, region_rows=16)


def test_tree_blocks_alone_do_not_decide(spark, monkeypatch):
    """Links that no block along a tree holds are found by the pairs of blocks."""
    monkeypatch.setattr(L, "_tree_blocks", lambda members, *_: members.select(F.col("key").alias("node"), F.col("key").cast("string").alias("block")))
    check(spark, corpus(6, 2, 60, 2), cluster_shingles=2000, block_rows=16)


def test_dense_regions_are_joined_whole(spark):
    """All rows of one region, over several tasks and batches: one connected set, whatever their signatures."""
    rows = [(i, [7] * L.TREES, random.Random(i).randbytes(L.HASHES)) for i in range(300)]
    rows += [(1000 + i, [100 + i] * L.TREES, random.Random(i).randbytes(L.HASHES)) for i in range(40)]
    df = spark.createDataFrame(rows, "key long, regions array<long>, low binary")
    forest = L.in_tree_order(df)
    edges = L.candidate_edges(forest, 60, 16).collect()
    root = {i: i for i in range(2000)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges:
        root[max(find(r["source"]), find(r["target"]))] = min(find(r["source"]), find(r["target"]))
    assert {find(i) for i in range(300)} == {0}
    assert all(find(1000 + i) == 1000 + i for i in range(40))


def test_blocks_are_bounded_by_shingles(spark):
    """Long texts fill a block before its rows are many; one longer than a block has a block of its own."""
    sizes = {i: 900 if i == 5 else 100 + i for i in range(60)}
    rows = [(i, 1, n, [3] * L.TREES, bytes(L.HASHES)) for i, n in sizes.items()]
    members = spark.createDataFrame(rows, "key long, cluster long, n_shingles long, regions array<long>, low binary")
    joined = spark.createDataFrame([(i, 0) for i in range(0, 60, 2)], "node long, root long")
    pairs, shingles = L._pair_blocks(members, joined, 10, 4096, 500)
    held = defaultdict(list)
    for r in pairs.collect():
        held[r["block"]].append(sizes[r["node"]])
    assert sum(map(sum, held.values())) == shingles
    assert all(sum(x) <= 1000 or 900 in x and sum(x) <= 1400 for x in held.values())
    for r in L._tree_blocks(members, 4096, 500).groupBy("block").agg(F.collect_list("node").alias("nodes")).collect():
        assert sum(sizes[n] for n in r["nodes"]) <= 500 or r["nodes"] == [5]
    assert 900 in [n for x in held.values() for n in x]


def test_prefix_filter_is_exact():
    rng = np.random.default_rng(4)
    for percent in (50, 80, 85, 100):
        pool = np.arange(1, 40, dtype=np.uint64)
        sets = [np.sort(rng.choice(pool, rng.integers(1, 38), replace=False)) for _ in range(120)]
        sets += [np.delete(s, 0) for s in sets if len(s) > 1]
        known = [set(s.tolist()) for s in sets]
        want = link_sets(len(sets), lambda i, others: np.array([100 * len(known[i] & known[j]) >= percent * len(known[i] | known[j]) for j in others], bool))  # noqa: B023
        assert L._confirmed(sets, percent).tolist() == want.tolist()


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one\x0btwo", "É é", "é é", "a b c d e", "A b c d e f"]
    rows = list(enumerate(texts)) + [(None, "a b c d e"), (None, None), (3, "one"), (20, "x " * 30_000), (21, "x " * 29_000)]
    check(spark, rows)


def test_repeated_key_joins_links(spark):
    a, b = ("p q r s t u v", "k l m n o p q")
    check(spark, [(1, a), (2, a), (2, b), (3, b), (4, "z")])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).collect() == []


def test_shingles_hash_like_words():
    import pyarrow as pa

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab C\t\né") for _ in range(rng.randint(0, 60))) for _ in range(500)] + [None, "", "a"]
    seen, back = {}, {}
    for text, got in zip(texts, shingle_sets(pa.array(texts)), strict=True):
        assert len(got) == len(shingles(text))
        key = frozenset(shingles(text))
        assert seen.setdefault(key, got.tobytes()) == got.tobytes()
        assert back.setdefault(got.tobytes(), key) == key


def test_depth():
    assert (depth_for(85), depth_for(80)) == (4, 3)


def test_link_sets_asks_each_pair_once_at_most():
    links = {(0, 3), (3, 5), (1, 2)}
    root = link_sets(6, lambda i, others: np.array([(min(i, j), max(i, j)) in links for j in others.tolist()], bool))
    assert root.tolist() == [0, 1, 1, 0, 4, 0]
