"""Relationship, graph and matching queries (J, G6-G10).

Oracles form every pair the quadratic way; the Spark side never does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import graph, link, matching
from paperloom.session import cut
from workload import inputs
from workload.oracle_inputs import oracle
from workload.registry import query

# All (rule, key) hits of the three file-name patterns, and their groups.
NAME_HITS = {
    "named": "SELECT ord, path, regexp_extract(path, '[^/]*$') AS name FROM files",
    "hits": r"""
SELECT ord, path, 1 AS rule, 'invoice_for_po' AS type, regexp_extract(name, 'INV[-_]?(\d+)', 1) AS k FROM named
WHERE regexp_matches(name, 'INV[-_]?(\d+)')
UNION ALL
SELECT ord, path, 2, 'invoice_for_po', regexp_extract(name, 'invoice[-_]?(\d+)', 1) FROM named
WHERE regexp_matches(name, 'invoice[-_]?(\d+)')
UNION ALL
SELECT ord, path, 3, 'multi_part_document', regexp_extract(name, '(.+)[-_]part[-_]?(\d+)', 1) FROM named
WHERE regexp_matches(name, '(.+)[-_]part[-_]?(\d+)')""",
}

# Every pair any detector reports at 0.6 or more, one row per hit.
ALL_HITS = NAME_HITS | {
    "name_pairs": """
SELECT a.ord AS s, b.ord AS t, a.path AS source, b.path AS target, a.rule AS det, a.type, 0.9::DOUBLE AS confidence,
       'Filename pattern match: ' || a.k AS evidence
FROM hits a JOIN hits b ON a.rule = b.rule AND a.k = b.k AND a.ord < b.ord""",
    "entity_pairs": """
SELECT a.ord AS s, b.ord AS t, a.path AS source, b.path AS target, 4 AS det, 'shared_entities' AS type,
       1.0::DOUBLE AS confidence,
       'Common entities: ' || least(a.vendor, a.customer) || ', ' || greatest(a.vendor, a.customer) AS evidence
FROM files a JOIN files b ON a.vendor = b.vendor AND a.customer = b.customer AND a.ord < b.ord""",
    "pair_hits": "SELECT * FROM name_pairs UNION ALL SELECT * FROM entity_pairs",
    "merged": """
SELECT s, t, source, target, arg_min(type, (-confidence, det)) AS type, max(confidence) AS confidence,
       string_agg(evidence, ' | ' ORDER BY det) AS evidence,
       CASE WHEN count(*) > 1 THEN string_agg(type, ' | ' ORDER BY det) ELSE '' END AS detection_methods,
       string_agg(type, ' | ' ORDER BY det) AS methods
FROM pair_hits GROUP BY s, t, source, target""",
}


def _bigint(c):
    return F.col(c).cast("bigint").alias(c)


def _members(spark, sf_dir):
    return link.link_filename(inputs.file_names(spark, sf_dir))


@query(
    "filename_links",
    oracle(
        """
SELECT f.path AS source, h.path AS target, h.type, 0.9::DOUBLE AS confidence,
       'Filename pattern match: ' || h.k AS evidence, n AS group_size
FROM hits h JOIN (SELECT rule, k, count(*) AS n, min(ord) AS first FROM hits GROUP BY rule, k) g USING (rule, k)
     JOIN files f ON f.ord = g.first
WHERE h.ord <> g.first""",
        "files",
        extra=NAME_HITS,
    ),
)
def filename_links(spark, sf_dir):
    return link.spanning_edges(_members(spark, sf_dir)).drop("group_key")


@query(
    "filename_pair_counts",
    oracle(
        """
SELECT type, det || ':' || substr(evidence, 25) AS group_key, count(*) AS n_pairs
FROM name_pairs GROUP BY ALL""",
        "files",
        extra=ALL_HITS,
    ),
)
def filename_pair_counts(spark, sf_dir):
    return link.pair_counts(_members(spark, sf_dir)).select("type", "group_key", _bigint("n_pairs"))


@query(
    "filename_links_documented",
    oracle(
        r"""
SELECT f.path AS source, h.path AS target, h.type, h.k AS group_key, n AS group_size
FROM vhits h JOIN (SELECT type, k, count(*) AS n, min(ord) AS first FROM vhits GROUP BY type, k) g USING (type, k)
     JOIN files f ON f.ord = g.first
WHERE h.ord <> g.first""",
        "files",
        extra={
            "named": "SELECT ord, path, lower(regexp_extract(path, '[^/]*$')) AS name FROM files",
            "vhits": r"""
SELECT ord, path, 'version' AS type, regexp_extract(name, '^(.+)[-_]v[0-9]+', 1) AS k FROM named
WHERE regexp_matches(name, '^(.+)[-_]v[0-9]+')
UNION ALL
SELECT ord, path, 'multi_part_document', regexp_extract(name, '^(.+)[-_]part[-_]?[0-9]+', 1) FROM named
WHERE regexp_matches(name, '^(.+)[-_]part[-_]?[0-9]+')""",
        },
    ),
)
def filename_links_documented(spark, sf_dir):
    members = link.link_filename(inputs.file_names(spark, sf_dir), "documented")
    return link.spanning_edges(members).drop("confidence", "evidence")


@query(
    "invoice_order_links",
    oracle(
        """
SELECT CASE WHEN d.role = 'i' THEN d.path ELSE fi.path END AS source,
       CASE WHEN d.role = 'i' THEN fo.path ELSE d.path END AS target, d.k AS group_key, n_pairs
FROM docs d JOIN (SELECT i.k, count(*) AS n_pairs, min(i.ord) AS first_i, min(o.ord) AS first_o
                  FROM docs i JOIN docs o ON i.k = o.k AND i.role = 'i' AND o.role = 'o' GROUP BY i.k) g ON g.k = d.k
     JOIN files fi ON fi.ord = first_i JOIN files fo ON fo.ord = first_o
WHERE d.role = 'i' OR d.ord <> first_o""",
        "files",
        extra={
            "named": "SELECT ord, path, lower(regexp_extract(path, '[^/]*$')) AS name FROM files",
            "docs": r"""
SELECT ord, path, 'i' AS role, regexp_extract(name, '^inv(oice)?[-_]?([0-9]+)', 2) AS k FROM named
WHERE regexp_matches(name, '^inv(oice)?[-_]?([0-9]+)')
UNION ALL
SELECT ord, path, 'o', regexp_extract(name, '^po[-_]?([0-9]+)', 1) FROM named
WHERE regexp_matches(name, '^po[-_]?([0-9]+)')""",
        },
    ),
)
def invoice_order_links(spark, sf_dir):
    edges = link.link_invoice_orders(inputs.file_names(spark, sf_dir))
    return edges.select("source", "target", "group_key", _bigint("n_pairs"))


def letters(spark, sf_dir, inv=None):
    """Invoices and contracts with a text that names other documents."""
    inv = inputs.invoices(spark, sf_dir) if inv is None else inv
    k = F.col("order_key")
    body = F.concat(
        F.lit("Our reference "),
        F.coalesce("metadata.invoice_number", F.lit("none")),
        F.lit(". As per agreement AGR-"),
        F.col("supp_key").cast("string"),
        F.lit("-"),
        (k % 4).cast("string"),
        F.lit(", order "),
        F.coalesce("metadata.po_number", F.lit("by phone")),
        F.lit(". See also AGR-"),
        F.col("supp_key").cast("string"),
        F.lit("-0."),
    )
    a = inv.select("ord", "path", body.alias("text"), F.col("metadata.invoice_number").alias("own_id"))
    agr = inputs.agreements(spark, sf_dir)
    text = F.concat(F.lit("Agreement "), F.col("metadata.agreement_id"))
    b = agr.select((-1 - F.col("ord")).alias("ord"), "path", text.alias("text"), F.col("metadata.agreement_id").alias("own_id"))
    return a.unionByName(b)


@query(
    "reference_links",
    oracle(
        """
SELECT DISTINCT i.path AS source, a.path AS target, 0.95::DOUBLE AS confidence, 'References ' || a.agreement_id AS evidence,
       1 AS n_targets
FROM inv i JOIN agr a ON a.agreement_id IN ('AGR-' || i.supp_key || '-' || (i.order_key % 4), 'AGR-' || i.supp_key || '-0')""",
        "inv",
        "agr",
    ),
)
def reference_links(spark, sf_dir):
    edges = link.link_reference(letters(spark, sf_dir))
    return edges.select("source", "target", "confidence", "evidence", "n_targets")


def _invoice_entities(spark, sf_dir):
    inv = inputs.invoices(spark, sf_dir)
    entities = link.entity_list(F.col("document_type"), F.col("vendor.name"), F.col("customer.name"))
    return inv.select("ord", "path", entities.alias("entities"))


@query(
    "entity_links",
    oracle(
        """
SELECT DISTINCT f.path AS source, m.path AS target,
       ((f.vendor = m.vendor)::INT + (f.customer = m.customer)::INT) / 2.0::DOUBLE AS confidence,
       'Common entities: ' || concat_ws(', ', CASE WHEN f.customer = m.customer THEN f.customer END,
                                              CASE WHEN f.vendor = m.vendor THEN f.vendor END) AS evidence
FROM (SELECT ord, min(ord) OVER (PARTITION BY vendor) AS first FROM inv
      UNION SELECT ord, min(ord) OVER (PARTITION BY customer) FROM inv
      UNION SELECT ord, min(ord) OVER (PARTITION BY vendor, customer) FROM inv) g
     JOIN inv m ON m.ord = g.ord JOIN inv f ON f.ord = g.first
WHERE m.ord <> g.first""",
        "inv",
    ),
)
def entity_links(spark, sf_dir):
    return link.link_entities(_invoice_entities(spark, sf_dir)).drop("type")


@query(
    "entity_pair_counts",
    oracle(
        """
SELECT e AS entity, CAST(sum(n) AS BIGINT) AS n_docs,
       CAST((sum(n) * (sum(n) - 1) - sum(n * (n - 1))) // 2 AS BIGINT) AS n_pairs_part, CAST(sum(n * (n - 1)) // 2 AS BIGINT) AS n_pairs_full
FROM (SELECT vendor AS e, n FROM cells UNION ALL SELECT customer, n FROM cells) GROUP BY e""",
        "files",
        extra={"cells": "SELECT vendor, customer, count(*) AS n FROM files GROUP BY 1, 2"},
    ),
)
def entity_pair_counts(spark, sf_dir):
    out = link.entity_pair_counts(inputs.file_names(spark, sf_dir))
    return out.select("entity", "n_docs", _bigint("n_pairs_part"), _bigint("n_pairs_full"))


@query(
    "temporal_links",
    oracle(
        """
SELECT vendor AS block, CAST(d1 AS VARCHAR) AS day_a, CAST(d2 AS VARCHAR) AS day_b, d2 - d1 AS days_apart,
       round(1 - 0.5 * (d2 - d1) / 30, 6) AS confidence, count(*) AS n_pairs
FROM (SELECT a.vendor, least(a.invoice_date, b.invoice_date) AS d1, greatest(a.invoice_date, b.invoice_date) AS d2
      FROM inv a JOIN inv b ON a.vendor = b.vendor AND a.ord < b.ord
      WHERE abs(a.invoice_date - b.invoice_date) <= 30)
GROUP BY ALL""",
        "inv",
    ),
)
def temporal_links(spark, sf_dir):
    docs = inputs.invoices(spark, sf_dir).select(
        "ord", "path", F.col("vendor.name").alias("vendor"), F.col("metadata.invoice_date").alias("date")
    )
    out = link.link_temporal(docs, "vendor", "date")
    return out.select(
        "block",
        F.col("day_a").cast("string").alias("day_a"),
        F.col("day_b").cast("string").alias("day_b"),
        "days_apart",
        F.round("confidence", 6).alias("confidence"),
        _bigint("n_pairs"),
    )


@query(
    "period_links",
    oracle(
        """
SELECT vendor || ' ' || strftime(invoice_date, '%Y-%m') AS group_key, count(*) AS n_docs,
       count(*) * (count(*) - 1) // 2 AS n_pairs
FROM inv GROUP BY 1 HAVING count(*) > 1""",
        "inv",
    ),
)
def period_links(spark, sf_dir):
    docs = inputs.invoices(spark, sf_dir).select(
        "ord", "path", F.col("vendor.name").alias("vendor"), F.col("metadata.invoice_date").alias("date")
    )
    return link.pair_counts(link.link_period(docs, "vendor", "date")).select("group_key", "n_docs", _bigint("n_pairs"))


@query(
    "amount_links",
    oracle(
        """
SELECT f.path AS source, m.path AS target, 'Matching amount: ' || k AS evidence, n AS group_size
FROM money m JOIN (SELECT k, count(*) AS n, min(ord) AS first FROM money GROUP BY k) g USING (k)
     JOIN inv f ON f.ord = g.first
WHERE m.ord <> g.first""",
        "inv",
        extra={
            "money": "SELECT ord, path, CAST(total_amount AS VARCHAR) || ' ' || currency AS k FROM inv WHERE currency IS NOT NULL"
        },
    ),
)
def amount_links(spark, sf_dir):
    members = link.link_amount(
        inputs.invoices(spark, sf_dir), F.col("financial.total_amount"), F.col("financial.currency")
    )
    return link.spanning_edges(members).select("source", "target", "evidence", "group_size")


@query(
    "relationships",
    oracle(
        """
SELECT source, target, type, confidence, evidence, detection_methods FROM merged
WHERE (s, t) IN (SELECT g.first, h.ord FROM hits h
                   JOIN (SELECT rule, k, min(ord) AS first FROM hits GROUP BY rule, k) g USING (rule, k)
                 UNION
                 SELECT g.first, f.ord FROM files f
                   JOIN (SELECT vendor, customer, min(ord) AS first FROM files GROUP BY 1, 2) g USING (vendor, customer))""",
        "files",
        extra=ALL_HITS,
    ),
)
def relationships(spark, sf_dir):
    edges = link.map_relationships(inputs.file_names(spark, sf_dir))
    return edges.withColumn("detection_methods", F.coalesce(F.array_join("detection_methods", " | "), F.lit("")))


LISTS = {
    "lists": """
SELECT c_custkey AS ord, 'c/' || c_custkey AS path,
       list_transform(range(0, 1 + c_custkey % 4), lambda i: 'E' || ((c_custkey // 4 * (i + 3) + i) % 41)) AS ents FROM customer""",
    "subsets": """
SELECT ord, path, ents, list_transform(list_filter(range(0, len(u)), lambda i: (mask >> i) & 1 = 1), lambda i: u[i + 1]) AS sub
FROM (SELECT *, unnest(range(1, 1 << len(u))) AS mask FROM (SELECT *, list_sort(list_distinct(ents)) AS u FROM lists))""",
    "keyed": "SELECT * FROM subsets WHERE len(sub) / len(ents) >= 0.6",
    "firsts": "SELECT sub, min(ord) AS first FROM keyed GROUP BY sub",
}


@query(
    "entity_lists",
    oracle(
        """
SELECT DISTINCT f.path AS source, m.path AS target, len(list_intersect(f.ents, m.ents)) / greatest(len(f.ents), len(m.ents)) AS confidence,
       'Common entities: ' || array_to_string(list_sort(list_intersect(f.ents, m.ents)), ', ') AS evidence
FROM keyed m JOIN firsts USING (sub) JOIN lists f ON f.ord = first WHERE m.ord <> first""",
        extra=LISTS,
    ),
)
def entity_lists(spark, sf_dir):
    """Relationships by entity lists of one to four names, some repeated."""
    k = F.col("c_custkey")
    name = lambda i: F.concat(F.lit("E"), ((F.floor(k / 4) * (i + 3) + i) % 41).cast("string"))
    docs = inputs.table(spark, sf_dir, "customer").select(
        k.alias("ord"), F.concat(F.lit("c/"), k.cast("string")).alias("path"),
        F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), name).alias("entities"),
    )
    return link.map_relationships(docs, ["entity_matching"]).select("source", "target", "confidence", "evidence")


LONG_LISTS = {
    "numbered": """
SELECT c_custkey AS ord, 'c/' || c_custkey AS path, c_custkey // 4 AS g,
       CASE WHEN c_custkey // 4 % 5 = 0 AND c_custkey % 4 = 1 THEN 0 ELSE c_custkey % 4 END AS j FROM customer""",
    "lists": """
SELECT ord, path, list_prepend('ALL', list_transform(range(0, 8 + g % 42 + j), lambda i:
       CASE WHEN i % 10 < 2 * j THEN 'K' || ord || '-' || i ELSE 'G' || g || '-' || i END)) AS ents FROM numbered""",
    "profiles": "SELECT list_sort(ents) AS u, min(ord) AS first FROM lists GROUP BY ALL",
    "linked": """
SELECT p.first AS s, l.ord AS t FROM lists l JOIN profiles p ON list_sort(l.ents) = p.u WHERE l.ord <> p.first
UNION ALL SELECT a.first, b.first FROM profiles a JOIN profiles b
ON a.first < b.first AND len(list_intersect(a.u, b.u)) >= 0.6 * greatest(len(a.u), len(b.u))""",
}


@query(
    "entity_long_lists",
    oracle(
        """
SELECT a.path AS source, b.path AS target, len(list_intersect(a.ents, b.ents)) / greatest(len(a.ents), len(b.ents)) AS confidence,
       'Common entities: ' || array_to_string(list_sort(list_intersect(a.ents, b.ents))[1:5], ', ') AS evidence
FROM linked JOIN lists a ON a.ord = s JOIN lists b ON b.ord = t""",
        extra=LONG_LISTS,
    ),
)
def entity_long_lists(spark, sf_dir):
    """Relationships by entity lists of nine to 53 names: equal ones, similar ones, and a name that all share."""
    k = F.col("c_custkey").cast("int")
    g = F.floor(k / 4).cast("int")
    j = F.when((g % 5 == 0) & (k % 4 == 1), 0).otherwise(k % 4)
    name = lambda i: F.when(i % 10 < 2 * j, F.concat(F.lit("K"), k, F.lit("-"), i)).otherwise(F.concat(F.lit("G"), g, F.lit("-"), i))
    docs = inputs.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"), F.concat(F.lit("c/"), k).alias("path"),
        F.concat(F.array(F.lit("ALL")), F.transform(F.sequence(F.lit(0), 7 + g % 42 + j), name)).alias("entities"),
    )
    return link.map_relationships(docs, ["entity_matching"]).select("source", "target", "confidence", "evidence")


FOUR = {
    "docs": """
SELECT o_orderkey AS ord, 'a/' || o_orderkey || '/INV-' || (o_orderkey // 3) || '.pdf' AS path, o_custkey AS cust,
       CAST(o_orderdate AS DATE) AS day, o_orderkey // 3 AS k, o_custkey // 4 AS v FROM orders""",
    "starts": """
SELECT first AS s, ord AS t FROM (SELECT ord, min(ord) OVER (PARTITION BY k) AS first FROM docs) WHERE ord <> first
UNION SELECT first, ord FROM (SELECT ord, min(ord) OVER (PARTITION BY v) AS first FROM docs) WHERE ord <> first""",
    "cells": "SELECT cust, day, count(*) AS n, arg_min(path, ord) AS first, arg_max(path, ord) AS last FROM docs GROUP BY 1, 2",
    "found": """
SELECT a.path AS source, b.path AS target, 1 AS det, 'invoice_for_po' AS type, 0.9::DOUBLE AS confidence, 'Filename pattern match: ' || a.k AS evidence
FROM starts JOIN docs a ON a.ord = s JOIN docs b ON b.ord = t WHERE a.k = b.k
UNION ALL SELECT b.path, a.path, 4, 'explicit_reference', 0.95, 'References AGR-' || a.ord FROM docs a JOIN docs b ON b.ord = a.ord + 1
UNION ALL SELECT a.path, b.path, 5, 'shared_entities', 1.0, 'Common entities: V' || a.v FROM starts JOIN docs a ON a.ord = s JOIN docs b ON b.ord = t WHERE a.v = b.v
UNION ALL SELECT first, last, 6, 'temporal_proximity', 1.0, '0 days apart' FROM cells WHERE n > 1
UNION ALL SELECT a.first, b.first, 6, 'temporal_proximity', 1 - 0.5 * (b.day - a.day) / 30, (b.day - a.day) || ' days apart'
FROM cells a JOIN cells b ON a.cust = b.cust AND b.day - a.day BETWEEN 1 AND 24""",
}


@query(
    "relationships_of_four",
    oracle(
        """
SELECT source, target, arg_min(type, (-confidence, det)) AS type, round(max(confidence), 6) AS confidence,
       string_agg(evidence, ' | ' ORDER BY det, type, evidence) AS evidence,
       CASE WHEN count(*) > 1 THEN string_agg(type, ' | ' ORDER BY det, type, evidence) ELSE '' END AS detection_methods
FROM found GROUP BY source, target""",
        extra=FOUR,
    ),
)
def relationships_of_four(spark, sf_dir):
    """All four detectors over one table of documents."""
    k = F.col("o_orderkey")
    text = lambda n: n.cast("string")
    docs = inputs.table(spark, sf_dir, "orders").select(
        k.alias("ord"),
        F.concat(F.lit("a/"), text(k), F.lit("/INV-"), text(F.floor(k / 3)), F.lit(".pdf")).alias("path"),
        F.concat(F.lit("See also AGR-"), text(k - 1), F.lit(" for this one.")).alias("text"),
        F.concat(F.lit("AGR-"), text(k)).alias("own_id"),
        F.array(F.concat(F.lit("V"), text(F.floor(F.col("o_custkey") / 4)))).alias("entities"),
        F.col("o_custkey").alias("block"),
        F.col("o_orderdate").cast("date").alias("date"),
    )
    edges = link.map_relationships(docs)
    return edges.withColumns(
        {"detection_methods": F.coalesce(F.array_join("detection_methods", " | "), F.lit("")), "confidence": F.round("confidence", 6)}
    )


@query(
    "relationship_counts",
    oracle(
        "SELECT methods AS detection_methods, count(*) AS n_pairs FROM merged GROUP BY methods",
        "files",
        extra=ALL_HITS,
    ),
)
def relationship_counts(spark, sf_dir):
    out = link.relationship_counts(inputs.file_names(spark, sf_dir))
    return out.select("detection_methods", _bigint("n_pairs"))


@query(
    "document_graph",
    oracle(
        """
SELECT path, count(other) AS degree FROM files LEFT JOIN
  (SELECT s AS ord, t AS other FROM merged UNION ALL SELECT t, s FROM merged) USING (ord)
GROUP BY ord, path""",
        "files",
        extra=ALL_HITS,
    ),
)
def document_graph(spark, sf_dir):
    docs = inputs.file_names(spark, sf_dir)
    degrees = link.relationship_degrees(docs)
    return graph.document_graph(docs.select("ord", "path"), degrees, "ord").drop("ord")


@query(
    "consolidated_links",
    oracle(
        """
SELECT source, target, arg_min(type, (-confidence, det, type)) AS type, max(confidence) AS confidence,
       string_agg(evidence, ' | ' ORDER BY det, type, evidence) AS evidence,
       CASE WHEN count(*) > 1 THEN string_agg(type, ' | ' ORDER BY det, type, evidence) ELSE '' END AS detection_methods
FROM (SELECT i.path AS source, a.path AS target, 2 AS det, 'explicit_reference' AS type, 0.95::DOUBLE AS confidence,
             'References ' || a.agreement_id AS evidence
      FROM inv i JOIN agr a ON a.agreement_id IN ('AGR-' || i.supp_key || '-' || (i.order_key % 4), 'AGR-' || i.supp_key || '-0')
      UNION ALL
      SELECT path, 'contracts/' || best || '.pdf', 5, 'invoice_for_contract', 0.8::DOUBLE, 'In force: ' || best
      FROM (SELECT i.path, max_by(agreement_id, (effective_date, -CAST(split_part(agreement_id, '-', 3) AS INTEGER))) AS best
            FROM inv i JOIN agr a ON a.vendor = i.vendor AND i.invoice_date BETWEEN a.effective_date AND a.expiry_date
            GROUP BY i.path))
GROUP BY source, target""",
        "inv",
        "agr",
    ),
)
def consolidated_links(spark, sf_dir):
    """Two detectors with directed pairs: explicit references and the contract in force."""
    inv = cut(inputs.invoices(spark, sf_dir).select("ord", "path", "order_key", "supp_key", "metadata", "vendor"))
    by_text = link.link_reference(letters(spark, sf_dir, inv)).select(
        "source", "target", "type", "confidence", "evidence", F.lit(2).alias("detector")
    )
    matched = matching.contract_asof(inv, inputs.agreements(spark, sf_dir))
    by_contract = matched.filter("agreement_id IS NOT NULL").select(
        F.col("path").alias("source"),
        F.concat(F.lit("contracts/"), F.col("agreement_id"), F.lit(".pdf")).alias("target"),
        F.lit("invoice_for_contract").alias("type"),
        F.lit(0.8).alias("confidence"),
        F.concat(F.lit("In force: "), F.col("agreement_id")).alias("evidence"),
        F.lit(5).alias("detector"),
    )
    edges = link.consolidate(link.threshold(by_text.unionByName(by_contract)))
    return edges.withColumn("detection_methods", F.coalesce(F.array_join("detection_methods", " | "), F.lit("")))


@query(
    "document_clusters",
    oracle(
        """
SELECT path, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size
FROM (SELECT ord, min(label) AS cluster FROM reach GROUP BY ord) JOIN files USING (ord)""",
        "files",
        extra=ALL_HITS
        | {
            "both_ways": "SELECT s AS a, t AS b FROM merged UNION SELECT t, s FROM merged",
            "reach": """
SELECT DISTINCT a AS ord, a AS label FROM both_ways
UNION
SELECT e.b, r.label FROM reach r JOIN both_ways e ON e.a = r.ord""",
        },
        recursive=True,
    ),
)
def document_clusters(spark, sf_dir):
    docs = inputs.file_names(spark, sf_dir)
    names = _members(spark, sf_dir).select("type", "group_key", "ord", "path")
    signature = link.entity_signature(F.col("entities"))
    entities = docs.select(
        F.lit("shared_entities").alias("type"), F.to_json(signature).alias("group_key"), "ord", "path"
    )
    members = names.unionByName(entities)
    edges = link.spanning_edges(members.withColumns({"confidence": F.lit(1.0), "evidence": F.lit("")}), by="ord")
    found = graph.clusters(edges)
    return found.join(docs.select(F.col("ord").alias("node"), "path"), "node").select("path", "cluster", "cluster_size")


# --- matching ----------------------------------------------------------------------------------


@query(
    "contract_match",
    oracle(
        """
SELECT i.vendor, CAST(i.invoice_date AS VARCHAR) AS invoice_date, a.agreement_id, count(*) AS n_invoices,
       CAST(sum(total_amount) AS DOUBLE) AS total
FROM inv i JOIN agr a ON a.vendor = i.vendor AND i.invoice_date BETWEEN a.effective_date AND a.expiry_date
GROUP BY ALL""",
        "inv",
        "agr",
    ),
)
def contract_match(spark, sf_dir):
    out = matching.match_contracts(inputs.invoices(spark, sf_dir), inputs.agreements(spark, sf_dir))
    return out.select(
        "vendor",
        F.col("invoice_date").cast("string").alias("invoice_date"),
        "agreement_id",
        "n_invoices",
        F.col("total").cast("double").alias("total"),
    )


@query(
    "contracts_of_invoices",
    oracle(
        """
SELECT i.path, i.vendor, CAST(i.invoice_date AS VARCHAR) AS invoice_date, a.agreement_id
FROM inv i JOIN agr a ON a.vendor = i.vendor AND i.invoice_date BETWEEN a.effective_date AND a.expiry_date""",
        "inv",
        "agr",
    ),
)
def contracts_of_invoices(spark, sf_dir):
    out = matching.contracts_of(inputs.invoices(spark, sf_dir), inputs.agreements(spark, sf_dir))
    return out.select("path", "vendor", F.col("invoice_date").cast("string").alias("invoice_date"), "agreement_id")


@query(
    "contract_asof",
    oracle(
        """
SELECT i.path, max_by(agreement_id, (effective_date, -slot)) AS agreement_id,
       CAST(max(effective_date) AS VARCHAR) AS effective_date
FROM inv i LEFT JOIN (SELECT *, CAST(split_part(agreement_id, '-', 3) AS INTEGER) AS slot FROM agr) a
     ON a.vendor = i.vendor AND i.invoice_date BETWEEN a.effective_date AND a.expiry_date
GROUP BY i.path""",
        "inv",
        "agr",
    ),
)
def contract_asof(spark, sf_dir):
    out = matching.contract_asof(inputs.invoices(spark, sf_dir), inputs.agreements(spark, sf_dir))
    return out.select("path", "agreement_id", F.col("effective_date").cast("string").alias("effective_date"))


@query(
    "over_limit",
    oracle(
        """
SELECT agreement_id, count(*) AS n_invoices, CAST(sum(total_amount) AS DOUBLE) AS total, CAST(cap AS DOUBLE) AS cap,
       sum(total_amount) > cap AS over_limit
FROM inv i JOIN agr a ON a.vendor = i.vendor AND i.invoice_date BETWEEN a.effective_date AND a.expiry_date
GROUP BY agreement_id, cap""",
        "inv",
        "agr",
    ),
)
def over_limit(spark, sf_dir):
    out = matching.over_limit(inputs.invoices(spark, sf_dir), inputs.agreements(spark, sf_dir))
    return out.select(
        "agreement_id",
        "n_invoices",
        F.col("total").cast("double").alias("total"),
        F.col("cap").cast("double").alias("cap"),
        "over_limit",
    )


@query(
    "invoices_without_po",
    oracle(
        "SELECT path, po_number FROM inv WHERE po_number IS NULL OR po_number NOT IN (SELECT po_number FROM po)",
        "inv",
        "po",
    ),
)
def invoices_without_po(spark, sf_dir):
    out = matching.unmatched_invoices(inputs.invoices(spark, sf_dir), inputs.purchase_orders(spark, sf_dir))
    return out.select("path", "metadata.po_number")


@query(
    "invoices_with_po",
    oracle("SELECT path, po_number FROM inv WHERE po_number IN (SELECT po_number FROM po)", "inv", "po"),
)
def invoices_with_po(spark, sf_dir):
    out = matching.matched_invoices(inputs.invoices(spark, sf_dir), inputs.purchase_orders(spark, sf_dir))
    return out.select("path", "metadata.po_number")


@query(
    "only_new",
    oracle(
        """
SELECT doc_id FROM documents WHERE sha256(text) NOT IN (
  SELECT sha256(text) FROM documents
  WHERE doc_id % 3 = 0 AND TIMESTAMP '2024-01-31' - to_days(CAST(doc_id % 30 AS INTEGER)) > TIMESTAMP '2024-01-24')"""
    ),
)
def only_new(spark, sf_dir):
    """Incremental run: a third of the documents already have results of different age."""
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    age = F.make_dt_interval((F.col("doc_id") % 30).cast("int"))
    results = docs.filter("doc_id % 3 = 0").select("file_hash", (now - age).alias("processed_at"))
    return matching.only_new(docs, results, now, spread="doc_id").select("doc_id")
