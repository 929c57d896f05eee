"""Links against the quadratic definition, with and without salting of hot keys."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import graph, keys, link, matching, semantic

NAMES = ["a/INV-001.pdf", "b/INV_001.pdf", "c/PO-001.pdf", "d/inv-001.pdf", "e/INV001x.pdf", "x_part1.pdf", "x-part-2.pdf",
         "invoice-7.pdf", "f/invoice_7_part1.pdf", "g/INV-001_part3.pdf", "plain.pdf", "a/INV-002.pdf"]


def docs(spark, seed=1, n=60):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # one key and one entity hold more than a third of the rows
        name = "z/INV-9.pdf" if i % 3 == 0 else rnd.choice(NAMES)
        vendor = "Big" if i % 2 == 0 else f"V{rnd.randint(0, 4)}"
        customer = rnd.choice(["Big", "C1", "C2", None])
        rows.append((i, f"{i}/{name}", [e for e in (vendor, customer) if e]))
    return rows, spark.createDataFrame(rows, "ord BIGINT, path STRING, entities ARRAY<STRING>")


def name_hits(path):
    import re

    name = path.split("/")[-1]
    out = []
    for i, (pattern, kind) in enumerate(link.FILENAME_RULES, 1):
        m = re.search(pattern, name)
        if m:
            out.append((i, kind, m.group(1)))
    return out


def score(a, b):
    return len(set(a) & set(b)) / max(len(a), len(b)) if a and b else 0.0


def reference_pairs(rows):
    """{(s, t): [(type, confidence, evidence), ...]} over all i < j, in detector order."""
    found = {}
    for a, b in itertools.combinations(rows, 2):
        hits = []
        for h in name_hits(a[1]):
            if h in name_hits(b[1]):
                hits.append((h[1], 0.9, f"Filename pattern match: {h[2]}"))
        s = score(a[2], b[2])
        if s >= 0.6:
            common = sorted(set(a[2]) & set(b[2]))
            hits.append(("shared_entities", s, "Common entities: " + ", ".join(common[:5])))
        if hits:
            found[(a[0], b[0])] = hits
    return found


def test_pairs_of_everything_equal_the_definition(spark):
    rows, df = docs(spark)
    members = link.link_filename(df)
    got = sorted((r["source"], r["target"], r["type"], r["evidence"]) for r in link.pairs_of(members, df).collect())
    want = sorted(
        (rows[s][1], rows[t][1], h[0], h[2])
        for (s, t), hits in reference_pairs(rows).items()
        for h in hits
        if h[0] != "shared_entities"
    )
    assert got == want


def test_pairs_of_some_documents(spark):
    rows, df = docs(spark)
    wanted = df.filter("ord IN (0, 4, 5)")
    got = {(r["source"], r["target"]) for r in link.pairs_of(link.link_filename(df), wanted).collect()}
    want = {
        (rows[s][1], rows[t][1])
        for (s, t), hits in reference_pairs(rows).items()
        if {s, t} & {0, 4, 5} and any(h[0] != "shared_entities" for h in hits)
    }
    assert got == want


def test_salting_changes_nothing(spark):
    _, df = docs(spark)
    members = link.link_filename(df)
    plain = sorted(link.spanning_edges(members).collect())
    salted = sorted(link.spanning_edges(members, hot_rows=3).collect())
    assert plain == salted and plain
    assert sorted(map(str, link.map_relationships(df).collect())) == sorted(map(str, link.map_relationships(df, hot_rows=3).collect()))
    assert sorted(link.link_entities(df).collect()) == sorted(link.link_entities(df, hot_rows=3).collect())
    a, b = (link.relationship_degrees(df, hot_rows=h).orderBy("ord").collect() for h in (3, 10**6))
    assert a == b


def test_relationships_carry_all_evidence(spark):
    rows, df = docs(spark)
    by_path = {r[1]: r[0] for r in rows}
    want = reference_pairs(rows)
    edges = link.map_relationships(df).collect()
    assert edges
    for e in edges:
        hits = want[(by_path[e["source"]], by_path[e["target"]])]
        best = max(hits, key=lambda h: h[1])
        assert (e["type"], e["confidence"]) == (best[0], best[1])
        assert e["evidence"] == " | ".join(h[2] for h in hits)
        assert e["detection_methods"] == ([h[0] for h in hits] if len(hits) > 1 else None)
    # the same documents are connected, whichever pairs are written
    def components(pairs):
        parent = {r[0]: r[0] for r in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for s, t in pairs:
            parent[max(find(s), find(t))] = min(find(s), find(t))
        return [find(r[0]) for r in rows]

    assert components(want) == components((by_path[e["source"]], by_path[e["target"]]) for e in edges)


def test_counts_and_degrees_without_pairs(spark):
    rows, df = docs(spark)
    want = reference_pairs(rows)
    methods = {}
    degree = {}
    for (s, t), hits in want.items():
        key = " | ".join(h[0] for h in hits)
        methods[key] = methods.get(key, 0) + 1
        for x in (s, t):
            degree[x] = degree.get(x, 0) + 1
    assert {r[0]: r[1] for r in link.relationship_counts(df).collect()} == methods
    assert {r["ord"]: r["degree"] for r in link.relationship_degrees(df).collect()} == degree
    nodes = graph.document_graph(df.select("ord", "path"), link.relationship_degrees(df), "ord")
    assert {r["ord"]: r["degree"] for r in nodes.collect()} == {r[0]: degree.get(r[0], 0) for r in rows}


def test_entity_score_counts_repeats(spark):
    df = spark.createDataFrame([(["A", "A"], ["A", "A"]), (["A"], ["A"]), (["A", "B"], ["B", "A"]), (["A"], ["A", "B"]), ([], ["A"])], "l ARRAY<STRING>, r ARRAY<STRING>")
    assert [r[0] for r in df.select(link.overlap_score(F.col("l"), F.col("r"))).collect()] == [0.5, 1.0, 1.0, 0.5, 0.0]


def test_entity_pair_counts(spark):
    rows, df = docs(spark, seed=5)
    part, full = {}, {}
    for a, b in itertools.combinations(rows, 2):
        s = score(a[2], b[2])
        for e in set(a[2]) & set(b[2]):
            target = full if s == 1.0 else part
            target[e] = target.get(e, 0) + 1
    got = {r["entity"]: (r["n_pairs_part"], r["n_pairs_full"]) for r in link.entity_pair_counts(df).collect()}
    for e, (p, f) in got.items():
        assert (p, f) == (part.get(e, 0), full.get(e, 0)), e


def test_low_threshold_keeps_half_scores(spark):
    rows, df = docs(spark)
    edges = link.map_relationships(df, ["entity_matching"], minimum=0.4).collect()
    assert {0.5, 1.0} >= {e["confidence"] for e in edges} and any(e["confidence"] == 0.5 for e in edges)


def test_temporal_links(spark):
    import datetime

    rnd = random.Random(2)
    base = datetime.date(2024, 1, 1)
    rows = [(i, f"d{i}", rnd.choice("ab"), base + datetime.timedelta(days=rnd.randint(0, 120))) for i in range(50)]
    df = spark.createDataFrame(rows, "ord BIGINT, path STRING, vendor STRING, date DATE")
    want = {}
    for a, b in itertools.combinations(rows, 2):
        gap = abs((a[3] - b[3]).days)
        if a[2] == b[2] and gap <= 30:
            k = (a[2], min(a[3], b[3]), max(a[3], b[3]))
            want[k] = want.get(k, 0) + 1
    out = link.link_temporal(df, "vendor", "date").collect()
    assert {(r["block"], r["day_a"], r["day_b"]): r["n_pairs"] for r in out} == want
    for r in out:
        assert r["confidence"] == 1 - 0.5 * r["days_apart"] / 30


def test_consolidation_keeps_the_first_on_ties(spark):
    rows = [("a", "b", 1, "x", 0.9, "e1"), ("a", "b", 2, "y", 0.9, "e2"), ("b", "a", 1, "x", 0.8, "e3"), ("a", "c", 1, "x", 0.59, "e4")]
    df = spark.createDataFrame(rows, "source STRING, target STRING, detector INT, type STRING, confidence DOUBLE, evidence STRING")
    got = {(r["source"], r["target"]): tuple(r)[2:] for r in link.consolidate(link.threshold(df)).collect()}
    assert got == {("a", "b"): ("x", 0.9, "e1 | e2", ["x", "y"]), ("b", "a"): ("x", 0.8, "e3", None)}


def test_references(spark):
    rows = [
        (0, "i1", "see AGR-1 and PO-77, own INV-1", "INV-1"),
        (1, "a1", "nothing", "AGR-1"),
        (2, "a1copy", "AGR-1 again", "AGR-1"),
        (3, "i2", "PO-7 is not PO-77", None),
    ]
    df = spark.createDataFrame(rows, "ord BIGINT, path STRING, text STRING, own_id STRING")
    for hot in (1, 10**6):
        got = sorted((r["source"], r["target"], r["group_key"], r["n_targets"]) for r in link.link_reference(df, hot_rows=hot).collect())
        assert got == [("a1copy", "a1", "AGR-1", 1), ("i1", "a1", "AGR-1", 2)]


def test_components_of_random_graphs(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "source BIGINT, target BIGINT")
    got = {r["node"]: r["cluster"] for r in graph.clusters(df, hot_rows=4).collect()}
    assert got == {x: find(x) for x in linked}


def test_first_per_key_and_skewed_join(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), (None, 2, "b"), ("l", 5, "d")], "k STRING, o INT, v STRING")
    got = sorted((r["k"] or "", r["v"]) for r in keys.first_per_key(df, ["k"], [F.col("o")]).collect())
    assert got == [("", "b"), ("k", "a"), ("l", "d")]
    right = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "k STRING, w INT")
    for how in ("inner", "left", "left_anti"):
        want = sorted(map(str, df.join(right, "k", how).collect()))
        got = sorted(map(str, keys.join_skewed(df, right, ["k"], F.col("o"), how, hot_rows=2).select(df.join(right, "k", how).columns).collect()))
        assert got == want


def test_contract_choice(spark):
    inv = spark.sql(
        "SELECT * FROM VALUES ('p1', named_struct('name','V'), named_struct('invoice_date', DATE'2024-05-01','po_number','PO-1'), named_struct('total_amount', 10.00BD)),"
        "('p2', named_struct('name','V'), named_struct('invoice_date', DATE'2020-05-01','po_number', CAST(NULL AS STRING)), named_struct('total_amount', 5.00BD)) AS t(path, vendor, metadata, financial)"
    )
    agr = spark.sql(
        "SELECT named_struct('agreement_id', id, 'effective_date', CAST(e AS DATE), 'expiry_date', CAST(x AS DATE)) metadata, array(named_struct('name','V'), named_struct('name','V')) parties, cap "
        "FROM VALUES ('A','2024-01-01','2024-12-31', 9.00BD), ('B','2024-03-01','2024-05-01', 10.00BD), ('C','2024-03-01','2025-01-01', 11.00BD) AS t(id, e, x, cap)"
    )
    best = {r["path"]: r["agreement_id"] for r in matching.contract_asof(inv, agr).collect()}
    assert best == {"p1": "B", "p2": None}
    matched = matching.match_contracts(inv, agr).collect()
    assert sorted((r["agreement_id"], r["n_invoices"], float(r["total"])) for r in matched) == [("A", 1, 10.0), ("B", 1, 10.0), ("C", 1, 10.0)]
    assert {(r["path"], r["agreement_id"]) for r in matching.contracts_of(inv, agr).collect()} == {("p1", x) for x in "ABC"}
    assert {r["agreement_id"]: r["over_limit"] for r in matching.over_limit(inv, agr).collect()} == {"A": True, "B": False, "C": False}
    po = spark.createDataFrame([("PO-1",)], "po_number STRING")
    assert [r["path"] for r in matching.matched_invoices(inv, po).collect()] == ["p1"]
    assert [r["path"] for r in matching.unmatched_invoices(inv, po).collect()] == ["p2"]


def test_similarity_along_edges_and_to_the_group(spark):
    from paperloom.operators import semantic

    vectors = spark.createDataFrame([("a", "g", [1.0, 0.0]), ("b", "g", [1.0, 1.0]), ("c", "g", [0.0, 0.0])], "path STRING, label STRING, embedding ARRAY<FLOAT>")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a")], "source STRING, target STRING")
    for hot in (1, 10**6):
        got = {r["target"]: r["similarity"] for r in semantic.score_edges(edges, vectors, hot_rows=hot).collect()}
        assert round(got["b"], 6) == 0.707107 and got["c"] is None and got["a"] == 1.0
    near = {r["path"] for r in semantic.link_semantic(vectors, "label", "path", 0.9).collect()}
    assert near == {"b"} or near == {"a", "b"}
    mean = [2 / 3, 1 / 3]
    cos_a = mean[0] / (mean[0] ** 2 + mean[1] ** 2) ** 0.5
    assert ("a" in near) == (cos_a >= 0.9)


def test_entity_lists_of_any_length_equal_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, f"d{i}", [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 5))]) for i in range(120)]
    rows += [(200, "p", ["a", "x", "y", "z"]), (201, "q", ["a", "x", "y", "o"])]
    df = spark.createDataFrame(rows, "ord BIGINT, path STRING, entities ARRAY<STRING>")

    def score(a, b):
        return len(set(a) & set(b)) / max(len(a), len(b)) if a and b else 0.0

    def components(pairs):
        parent = {r[1]: r[1] for r in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for s, t in pairs:
            parent[max(find(s), find(t))] = min(find(s), find(t))
        return {r[1]: find(r[1]) for r in rows}

    lists = {r[1]: r[2] for r in rows}
    for minimum, edges in ((0.6, link.map_relationships(df, ["entity_matching"])), (0.3, link.link_entities(df))):
        got = edges.collect()
        ok = lambda a, b: score(a, b) >= 0.6 if minimum == 0.6 else score(a, b) > 0.3  # noqa: E731, B023
        want = [(a[1], b[1]) for i, a in enumerate(rows) for b in rows[:i] if ok(a[2], b[2])]
        for e in got:
            assert ok(lists[e["source"]], lists[e["target"]])
            assert abs(e["confidence"] - score(lists[e["source"]], lists[e["target"]])) < 1e-12
        assert components(want) == components((e["source"], e["target"]) for e in got)
    assert ("p", "q") in {(e["source"], e["target"]) for e in link.map_relationships(df, ["entity_matching"]).collect()}


def test_detectors_are_checked(spark):
    df = spark.createDataFrame([(0, "a", ["x"])], "ord BIGINT, path STRING, entities ARRAY<STRING>")
    with pytest.raises(ValueError, match="unknown detector"):
        link.map_relationships(df, ["filename"])
    with pytest.raises(ValueError, match="needs text, own_id"):
        link.map_relationships(df, ["explicit_reference"])
    with pytest.raises(ValueError, match="listed, not counted"):
        link.relationship_counts(df, ["temporal_correlation"])
    long = spark.createDataFrame([(0, "a", list("abc"))], df.schema)
    with pytest.raises(Exception, match="listed, not counted"):
        link.relationship_degrees(long).collect()


def tasks_of_hot_rows(joined, hot):
    """In how many partitions the rows of a hot key are after the join, and the executed plan."""
    where = joined.filter(hot).groupBy(F.spark_partition_id().alias("p")).count().collect()
    return len(where)


def hot_members(spark, n=4000):
    """80 % of the rows have one key."""
    key = F.when(F.col("id") % 5 < 4, F.lit("hot")).otherwise(F.col("id").cast("string"))
    return spark.range(n).select(
        F.lit("t").alias("type"), key.alias("group_key"), F.col("id").alias("ord"), F.concat(F.lit("p"), F.col("id")).alias("path"),
        F.lit(0.9).alias("confidence"), F.lit("e").alias("evidence"),
    )


@pytest.fixture
def shuffled(spark):
    """Joins as at scale: by shuffle, and partitions above some kilobytes count as skewed."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_group_is_split(spark, shuffled):
    """Joins of rows with their group's statistics deal a hot group to several tasks, and joins that are left
    to Spark show its split in the final plan."""
    members = hot_members(spark)
    edges = link.spanning_edges(members, hot_rows=200)
    assert edges.count() == 3199
    assert tasks_of_hot_rows(edges, F.col("group_key") == "hot") > 4

    hub = spark.range(1, 3000).select(F.lit(0).cast("long").alias("source"), F.col("id").alias("target"))
    stars = hub.select(F.col("target").alias("u"), F.col("source").alias("v"))
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    pointed = graph._with_minima(both, graph._minima(both), 200)
    assert tasks_of_hot_rows(pointed, F.col("u") == 0) > 4
    assert graph.connected(hub, hot_rows=50).filter("cluster = 0").count() == 3000

    vectors = members.select("group_key", "path", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    scored = semantic.group_similarity(vectors, "group_key", "path", hot_rows=200)
    assert tasks_of_hot_rows(scored, F.col("group_key") == "hot") > 4

    docs = members.select(F.concat("path", F.lit("-id")).alias("document_id"), F.col("group_key").alias("file_hash"))
    results = spark.range(2000).select(F.col("id").cast("string").alias("file_hash"), F.lit("2024-01-02").cast("timestamp").alias("processed_at"))
    new = matching.only_new(docs, results, F.lit("2024-01-03").cast("timestamp"))
    assert "skew=true" in final_plan(new)
    assert new.count() == 3200 + 400

    texts = members.select("ord", "path", F.lit("see INV-7").alias("text"), F.concat(F.lit("INV-"), F.col("ord")).alias("own_id"))
    assert "skew=true" in final_plan(link.link_reference(texts))


def test_invoices_of_one_vendor_and_day_are_split(spark, shuffled):
    vendor = F.when(F.col("id") % 5 == 0, F.lit(None).cast("string")).otherwise("v")
    invoices = spark.range(3000).select(
        F.concat(F.lit("i"), F.col("id")).alias("path"), F.struct(vendor.alias("name")).alias("vendor"),
        F.struct(F.lit("2024-03-01").cast("date").alias("invoice_date")).alias("metadata"),
    )
    agreements = spark.sql(
        "SELECT named_struct('agreement_id', 'a', 'effective_date', date'2024-01-01', 'expiry_date', date'2024-12-31') AS metadata,"
        " array(named_struct('name', 'v')) AS parties"
    )
    found = matching.contract_asof(invoices, agreements, hot_rows=100)
    assert found.filter("agreement_id = 'a'").count() == 2400 and found.count() == 3000
    assert tasks_of_hot_rows(found, F.col("vendor") == "v") > 4
    assert tasks_of_hot_rows(found, F.col("vendor").isNull()) > 4


def score(a, b):
    return len(set(a) & set(b)) / max(len(a), len(b), 1)


@pytest.mark.parametrize("minimum", [0.3, 0.6])
def test_long_entity_lists_equal_brute_force(spark, minimum):
    """Lists of 1 to 200 entities: popular ones in all, copies, repeats inside a list, short next to long."""
    random.seed(int(minimum * 10))
    lists = [[], ["x"], ["x"] * 30, ["x", "y"] * 7]
    for family in range(14):
        n = random.choice([3, 7, 8, 9, 10, 12, 20, 60, 200])
        base = ["x", "y"][: family % 3] + [f"f{family // 2}-{i}" for i in range(n)]
        for _ in range(9):
            own = [e for e in base if random.random() < random.choice([0.3, 0.6, 0.9, 1])]
            own += [f"r{random.random()}" for _ in range(random.choice([0, 0, 2, n // 2]))] + own[: random.choice([0, 0, 3])]
            random.shuffle(own)
            lists += [own] * random.choice([1, 1, 2])
    rows = [(i, f"p{i}", entities) for i, entities in enumerate(lists)]
    df = spark.createDataFrame(rows, "ord BIGINT, path STRING, entities ARRAY<STRING>").repartition(5)
    enough = (lambda s: s > 0.3 + 1e-9) if minimum == 0.3 else (lambda s: s >= minimum - 1e-9)
    edges = link.link_entities(df) if minimum == 0.3 else link.map_relationships(df, ["entity_matching"], minimum=minimum)
    got = {}
    for e in edges.collect():
        s, t = int(e["source"][1:]), int(e["target"][1:])
        assert s < t and e["confidence"] == pytest.approx(score(lists[s], lists[t])) and enough(e["confidence"])
        assert (s, t) not in got
        got[s, t] = e["confidence"]
    first = {}
    for i, x in enumerate(lists):
        first.setdefault((tuple(sorted(set(x))), len(x)), i)
    of = [first[tuple(sorted(set(x))), len(x)] for x in lists]
    linked = [(s, t) for s, t in itertools.combinations(range(len(lists)), 2) if enough(score(lists[s], lists[t]))]
    long = lambda i: len(lists[i]) > link.SUBSET_ENTITIES
    wanted = {(min(of[s], of[t]), max(of[s], of[t])) for s, t in linked if (long(s) or long(t)) and of[s] != of[t]}
    wanted |= {(of[i], i) for i in range(len(lists)) if of[i] != i and long(i) and enough(score(lists[i], lists[i]))}
    assert wanted <= set(got)
    assert all(not long(s) and not long(t) for s, t in set(got) - wanted)
    components = lambda pairs: sorted(map(tuple, graph.connected(spark.createDataFrame(list(pairs), "source long, target long")).collect()))
    assert components(linked) == components(got)


def test_an_interval_is_a_few_blocks(spark):
    """Every day of an interval lies in exactly one of its blocks, no other day in any; open-ended contracts
    cost no more than others."""
    random.seed(2)
    spans = [(a, a + random.choice([0, 1, 3, 15, 16, 63, 64, 700])) for a in random.sample(range(-900, 900), 60)]
    df = spark.createDataFrame(spans, "a int, b int")
    made = df.select("a", "b", matching.cover(F.col("a"), F.col("b"), 4, 6).alias("blocks"))
    for a, b, blocks in made.collect():
        days = [d for x in blocks for d in range(x // 32 * 4 ** (x % 32), (x // 32 + 1) * 4 ** (x % 32))]
        assert sorted(days) == list(range(a, b + 1))
    at = spark.range(-50, 50).select("id", matching.blocks_at(F.col("id"), 4, 3).alias("at")).collect()
    assert all(r["at"] == [r["id"] // 4**k * 32 + k for k in range(3)] for r in at)
    starts = spark.sql("SELECT explode(sequence(date'1990-01-01', date'2040-01-01', interval 5 days)) AS d")
    end = F.unix_date(F.lit("9999-12-31").cast("date"))
    rows = starts.select(
        F.size(matching.cover(matching._bin(F.col("d")), F.floor(end / 64), *matching.BINS)).alias("bins"),
        F.size(matching.cover(F.unix_date("d"), end, *matching.DAYS)).alias("days"),
    ).agg(F.max("bins"), F.max("days")).first()
    assert max(rows) < 50


def test_written_groups_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("ord"), F.floor(F.col("id") / 2).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    joined = lambda: keys.join_groups(rows, groups, ["k"], F.col("ord"))
    assert "strategy=merge" not in plan(joined())
    monkeypatch.setattr(keys, "BROADCAST_ROWS", 100)
    assert "strategy=merge" in plan(joined()) and joined().count() == 400
    salted = keys.join_groups(rows, groups, ["k"], F.col("ord"), hot_rows=2)
    assert "strategy=merge" in plan(salted) and salted.count() == 400


def test_blocks_of_contracts_are_not_broadcast(spark):
    """A contract is many rows of blocks, whatever the size of the table it is read from."""
    day = lambda d: F.lit(d).cast("date")
    inv = spark.range(20).select(
        F.concat(F.lit("i/"), F.col("id").cast("string")).alias("path"),
        F.struct(F.lit("V").alias("name")).alias("vendor"),
        F.struct(F.date_add(day("2020-01-01"), F.col("id").cast("int")).alias("invoice_date")).alias("metadata"),
        F.struct(F.lit(1).cast("decimal(18,2)").alias("total_amount")).alias("financial"),
    )
    agr = spark.range(1).select(
        F.struct(F.lit("A").alias("agreement_id"), day("2020-01-05").alias("effective_date"), day("2020-01-14").alias("expiry_date")).alias("metadata"),
        F.array(F.struct(F.lit("vendor").alias("role"), F.lit("V").alias("name"))).alias("parties"),
        F.lit(5).cast("decimal(18,2)").alias("cap"),
    )
    found = {"limit": matching.over_limit(inv, agr), "contracts": matching.contracts_of(inv, agr)}
    for df in found.values():
        assert "strategy=merge" in df._jdf.queryExecution().optimizedPlan().toString()
    assert found["limit"].first()["n_invoices"] == 10 and found["contracts"].count() == 10


def test_entity_links_of_unique_documents_are_not_made_distinct_in_a_shuffle(spark):
    """A pair's row is the one of all its common entities; repeated `ord`s still give each pair once."""
    rng = random.Random(17)
    names = [f"E{i}" for i in range(9)]
    rows = [(i, f"d{i}", [rng.choice(names) for _ in range(rng.randint(0, 3))]) for i in range(60)] + [(None, "x", ["E1"])]
    shape = "ord BIGINT, path STRING, entities ARRAY<STRING>"

    def wanted(docs):
        got = {}
        for size in (1, 2, 3):
            for key in itertools.combinations(sorted(names), size):
                group = sorted(d for d in docs if d[0] is not None and set(key) <= set(d[2]))
                for d in group[1:]:
                    common = sorted(set(group[0][2]) & set(d[2]))
                    score = len(common) / max(len(group[0][2]), len(d[2]))
                    got[group[0][1], d[1]] = (round(score, 9), "Common entities: " + ", ".join(common))
        return got

    def found(docs):
        out = link.link_entities(spark.createDataFrame(docs, shape))
        listed = [(r["source"], r["target"], round(r["confidence"], 9), r["evidence"]) for r in out.collect()]
        assert len({r[:2] for r in listed}) == len(listed)
        return {r[:2]: r[2:] for r in listed}, out._jdf.queryExecution().optimizedPlan().toString()

    got, plan = found(rows)
    assert got == wanted(rows) and "Aggregate [source_ord" not in plan
    got, plan = found(rows + rows[:20])
    assert got == wanted(rows) and "Aggregate [source_ord" in plan
    mixed = rows + [(100 + i, f"m{i}", [rng.choice(names) for _ in range(5)]) for i in range(20)]
    got, plan = found(mixed)
    assert "Aggregate [source_ord" in plan
    docs = {d[1]: d[2] for d in mixed}
    for (a, b), (score, _) in got.items():
        assert score == round(len(set(docs[a]) & set(docs[b])) / max(len(docs[a]), len(docs[b])), 9) and score > 0.3


def test_consolidated_pairs_aggregate_only_their_list(spark):
    rows = [
        ("a", "b", "t2", 0.9, "e1", 2), ("a", "b", "t1", 0.9, "e2", 1), ("a", "b", "t0", 0.95, "e3", 3), ("a", "c", "u", 0.7, "f", 5),
        (None, "c", "v", 0.7, "g", 1), ("d", "c", "w", None, "h", 2), ("d", "c", "x", 0.8, "i", 1), ("a", "c", "u", 0.7, "f", 5),
    ]
    edges = spark.createDataFrame(rows, "source STRING, target STRING, type STRING, confidence DOUBLE, evidence STRING, detector INT")
    out = link.consolidate(edges)
    got = {(r["source"], r["target"]): tuple(r)[2:] for r in out.collect()}
    assert got == {
        ("a", "b"): ("t0", 0.95, "e2 | e1 | e3", ["t1", "t2", "t0"]), ("a", "c"): ("u", 0.7, "f | f", ["u", "u"]),
        (None, "c"): ("v", 0.7, "g", None), ("d", "c"): ("w", 0.8, "i | h", ["x", "w"]),
    }
    assert "min_by" not in out._jdf.queryExecution().optimizedPlan().toString()
