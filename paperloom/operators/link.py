"""Relationship detection.

Documents that share a key are all related to each other, so n documents stand for n(n-1)/2
relationships. Writing those pairs out is quadratic and breaks as soon as one key is popular. Here a
detector therefore yields *members*: one row per document and key

    type, group_key, ord, path, confidence, evidence

Every two members of a group are one relationship, earlier `ord` first. This is the complete result,
in linear size. Three views are taken from it:

* `spanning_edges` - real relationships from each group's first document to every other member:
  same connected documents, n-1 rows per group, plus the group size;
* `pair_counts` - the exact number of relationships per group;
* `pairs_of` - all relationships of the documents the caller names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions.paths import last_segment
from paperloom.operators.keys import HOT_ROWS, join_groups, join_skewed, merged_if_many
from paperloom.operators.set_join import link_long_lists
from paperloom.session import cut

# File-name patterns, link types, confidences and thresholds.
FILENAME_RULES = [
    (r"INV[-_]?(\d+)", "invoice_for_po"),
    (r"invoice[-_]?(\d+)", "invoice_for_po"),
    (r"(.+)[-_]part[-_]?(\d+)", "multi_part_document"),
]
FILENAME_CONFIDENCE = 0.9
REFERENCE_CONFIDENCE = 0.95
ENTITY_MIN_SCORE = 0.3
CONFIDENCE_THRESHOLD = 0.6
EVIDENCE_ENTITIES = 5
DETECTORS = ("filename_pattern", "explicit_reference", "entity_matching", "temporal_correlation")
GROUP_DETECTORS = ("filename_pattern", "entity_matching")

# Our own choices where only an intent is documented.
REFERENCE_CANDIDATE = r"\b[IPA](?:NV|O|GR)-[0-9]+(?:-[0-9]+)*"  # one character class first: fast to scan
REFERENCE_START = r"^(?:INV|PO|AGR)-"
AMOUNT_CONFIDENCE = 0.8
PERIOD_CONFIDENCE = 0.5
TEMPORAL_DAYS = 30
SUBSET_ENTITIES = 8  # up to here lists are linked in groups by common subsets, beyond by an exact join of lists
# Columns that a detector needs beside `ord` and `path`.
NEEDS = {
    "filename_pattern": [],
    "explicit_reference": ["text", "own_id"],
    "entity_matching": ["entities"],
    "temporal_correlation": ["block", "date"],
}

COUNT = "decimal(38,0)"
MEMBER = ["type", "group_key", "ord", "path", "confidence", "evidence"]
GROUP = ["type", "group_key"]


def pairs_in(n: Column) -> Column:
    """Number of unordered pairs among n members; decimal, as a big group's count leaves 64 bits."""
    return (n.cast("decimal(19,0)") * (n - 1).cast("decimal(18,0)") / 2).cast(COUNT)


def _members(df: DataFrame, type_: Column, key: Column, confidence: float, evidence: Column) -> DataFrame:
    return df.select(
        type_.alias("type"),
        key.alias("group_key"),
        "ord",
        "path",
        F.lit(float(confidence)).alias("confidence"),
        evidence.alias("evidence"),
    )


# --- detectors ---------------------------------------------------------------------------------


def filename_keys(path: Column) -> Column:
    """Array of (rule, type, key) for every file-name rule that matches somewhere in the name."""
    name = last_segment(path)
    found = [
        F.when(
            name.rlike(pattern),
            F.struct(
                F.lit(i).alias("rule"), F.lit(type_).alias("type"), F.regexp_extract(name, pattern, 1).alias("key")
            ),
        )
        for i, (pattern, type_) in enumerate(FILENAME_RULES, 1)
    ]
    return F.array_compact(F.array(*found))


def link_filename(df: DataFrame, mode: str = "literal") -> DataFrame:
    """File-name members (J1). Needs `path` and a unique `ord`.

    `literal`: equal captured key under one rule, case-sensitive, anywhere in the last segment.
    `documented`: versions and parts of one base name; the invoice / order side is bipartite and has
    its own operator, `link_invoice_orders`.
    """
    if mode == "literal":
        hits = df.select("ord", "path", F.explode(filename_keys(F.col("path"))).alias("hit"))
        return _members(
            hits,
            F.col("hit.type"),
            F.concat_ws(":", F.col("hit.rule").cast("string"), F.col("hit.key")),
            FILENAME_CONFIDENCE,
            F.concat(F.lit("Filename pattern match: "), F.col("hit.key")),
        )
    if mode != "documented":
        raise ValueError(f"unknown mode: {mode}")
    name = F.lower(last_segment(F.col("path")))
    kinds = [("version", r"^(.+)[-_]v[0-9]+"), ("multi_part_document", r"^(.+)[-_]part[-_]?[0-9]+")]
    found = [
        F.when(name.rlike(p), F.struct(F.lit(t).alias("type"), F.regexp_extract(name, p, 1).alias("key")))
        for t, p in kinds
    ]
    hits = df.select("ord", "path", F.explode(F.array_compact(F.array(*found))).alias("hit"))
    evidence = F.concat(F.lit("Filename pattern match: "), F.col("hit.key"))
    return _members(hits, F.col("hit.type"), F.col("hit.key"), FILENAME_CONFIDENCE, evidence)


def link_amount(df: DataFrame, amount: Column, currency: Column) -> DataFrame:
    """Members grouped by equal amount and currency."""
    text = F.concat_ws(" ", amount.cast("decimal(18,2)").cast("string"), currency)
    rows = df.filter(amount.isNotNull() & currency.isNotNull()).withColumn("_key", text)
    return _members(
        rows,
        F.lit("matching_amount"),
        F.col("_key"),
        AMOUNT_CONFIDENCE,
        F.concat(F.lit("Matching amount: "), F.col("_key")),
    )


def link_period(df: DataFrame, block: str, date: str) -> DataFrame:
    """Members of the same block and billing month (J5, by period)."""
    rows = df.filter(F.col(block).isNotNull() & F.col(date).isNotNull())
    month = F.date_format(date, "yyyy-MM")
    return _members(
        rows,
        F.lit("same_billing_period"),
        F.concat_ws(" ", F.col(block), month),
        PERIOD_CONFIDENCE,
        F.concat(F.lit("Same billing period: "), month),
    )


def entity_list(document_type: Column, vendor: Column, customer: Column) -> Column:
    """Entities of a document: vendor and customer of invoices, in that order, blanks left out."""
    keep = lambda c: F.when((document_type == "invoice") & (c != ""), c)
    return F.array_compact(F.array(keep(vendor), keep(customer)))


def overlap_score(left: Column, right: Column) -> Column:
    """Shared distinct entities over the longer list; list lengths count repeats."""
    longest = F.greatest(F.size(left), F.size(right))
    return F.when(longest > 0, F.size(F.array_intersect(left, right)) / longest).otherwise(F.lit(0.0))


def entity_evidence(left: Column, right: Column) -> Column:
    common = F.slice(F.array_sort(F.array_intersect(left, right)), 1, EVIDENCE_ENTITIES)
    return F.concat(F.lit("Common entities: "), F.array_join(common, ", "))


# --- views on members --------------------------------------------------------------------------


def group_stats(members: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per group with at least two members: size and first member (map-side combined)."""
    first = F.min_by(F.struct("ord", "path", *carry), F.col("ord")).alias("first")
    return members.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), first).filter(F.col("n") > 1)


def spanning_edges(members: DataFrame, by: str = "path", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """First member -> every other member, with the number of documents the group holds. `by` picks
    what names a document in source and target (`path` or the shorter `ord`)."""
    joined = join_groups(members, group_stats(members), GROUP, F.col("ord"), hot_rows=hot_rows)
    return joined.filter(F.col("ord") != F.col("first.ord")).select(
        F.col(f"first.{by}").alias("source"),
        F.col(by).alias("target"),
        "type",
        "confidence",
        "evidence",
        "group_key",
        F.col("n").alias("group_size"),
    )


def pair_counts(members: DataFrame) -> DataFrame:
    """Exact number of relationships per group."""
    return (
        members.groupBy(*GROUP)
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .filter(F.col("n_docs") > 1)
        .withColumn("n_pairs", pairs_in(F.col("n_docs")))
    )


def pairs_of(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """All relationships of the documents in `wanted` (column `ord`): one row per pair and group."""
    asked = members.join(wanted.select("ord").distinct(), "ord", "left_semi").select(
        *GROUP, F.struct("ord", "path").alias("a")
    )
    other = members.select(*GROUP, F.struct("ord", "path").alias("b"), "confidence", "evidence")
    pairs = join_skewed(other, asked, GROUP, F.col("b.ord")).filter(F.col("a.ord") != F.col("b.ord"))
    return (
        pairs.select(
            F.least("a", "b").alias("s"), F.greatest("a", "b").alias("t"), *GROUP, "confidence", "evidence"
        )
        .dropDuplicates(["s", "t", *GROUP])
        .select(
            F.col("s.path").alias("source"),
            F.col("t.path").alias("target"),
            "type",
            "confidence",
            "evidence",
            "group_key",
        )
    )


# --- entity links (J4) -------------------------------------------------------------------------


def entity_keys(entities: Column, minimum: float, inclusive: bool = True) -> Column:
    """Keys such that two documents of at most SUBSET_ENTITIES entities share one exactly if their overlap
    score reaches `minimum` (or, not `inclusive`, exceeds it). Longer lists have none: their links, to short
    lists as well, are those of `link_long_lists`.

    A pair whose longer list has m entities needs r(m) common ones. A list of n entities gives every
    subset of its distinct entities with at least r(n) members. Two lists with a common subset of size r
    are both short enough for r to suffice, and a pair that reaches the score has such a subset.
    """
    return F.transform(_shared_by(entities, minimum, inclusive), lambda x: F.concat(F.lit("entities:"), F.to_json(x)))


def _shared_by(entities: Column, minimum: float, inclusive: bool) -> Column:
    """The subsets of `entity_keys`, as sorted arrays."""
    enough = lambda r, n: r / n >= minimum - 1e-12 if inclusive else r / n > minimum + 1e-12
    least = [next(r for r in range(1, n + 1) if r == n or enough(r, n)) for n in range(1, SUBSET_ENTITIES + 1)]
    unique = F.array_sort(F.array_distinct(entities))
    subsets = F.aggregate(
        unique,
        F.array(F.array().cast("array<string>")),
        lambda acc, e: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(e)))),
    )
    needed = F.element_at(F.array(*[F.lit(r) for r in least]), F.size(entities))
    large = F.filter(subsets, lambda x: F.size(x) >= needed)
    return F.when(F.size(entities).between(1, SUBSET_ENTITIES), large).otherwise(F.array().cast("array<array<string>>"))


def _linked_by_entities(df: DataFrame, minimum: float, inclusive: bool) -> DataFrame | None:
    """Links (first, other) of lists above SUBSET_ENTITIES, or None where there are no such lists."""
    if df.filter(F.size("entities") > SUBSET_ENTITIES).isEmpty():
        return None
    return link_long_lists(df, SUBSET_ENTITIES, minimum, inclusive)


def link_entities(df: DataFrame, entities: str = "entities", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Documents whose overlap score exceeds 0.3 (J4), lists of any length.

    Short lists give spanning edges: from the first document of every group that shares enough entities to
    each other one; every two members of a group are related. Links of longer lists are found by an exact join
    (`set_join`) and written between the first documents of every two different lists.
    """
    listed = cut(df.select("ord", "path", F.col(entities).alias("entities")))
    shared = F.explode(_shared_by(F.col("entities"), ENTITY_MIN_SCORE, False)).alias("shared")
    members = listed.select("*", shared)
    repeated = not listed.groupBy("ord").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    doc = F.struct("ord", "path", "entities")
    if repeated:
        groups = members.groupBy("shared").agg(F.count(F.lit(1)).alias("n"), F.min_by(doc, "ord").alias("first"))
    else:  # numbers are aggregated by hash, documents only after a sort; so the first document is looked up
        found = members.groupBy("shared").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("_ord")).filter("n > 1")
        groups = found.join(listed.select(F.col("ord").alias("_ord"), doc.alias("first")), "_ord").drop("_ord")
    joined = join_groups(members, groups.filter("n > 1"), ["shared"], F.col("ord"), hot_rows=hot_rows)
    common = F.size(F.array_intersect("first.entities", "entities"))
    found = joined.filter(F.col("ord") != F.col("first.ord"))
    # lists of up to three entities link by any common one: who is first by some of a pair's common entities is first
    # by all of them, and that row stands for the pair
    longest = listed.agg(F.max(F.when(F.size("entities") <= SUBSET_ENTITIES, F.size("entities")))).first()[0] or 0
    once = not repeated and longest * ENTITY_MIN_SCORE < 1
    if once:
        found = found.filter(F.size("shared") == common)
    found = found.select("first", F.struct("ord", "path", "entities").alias("other"))
    longer = _linked_by_entities(listed, ENTITY_MIN_SCORE, False)
    if longer is not None:
        found = found.unionByName(longer)
    mine, theirs = F.col("other.entities"), F.col("first.entities")
    edges = found.select(
        F.col("first.ord").alias("source_ord"),
        F.col("other.ord").alias("target_ord"),
        F.col("first.path").alias("source"),
        F.col("other.path").alias("target"),
        F.lit("shared_entities").alias("type"),
        overlap_score(theirs, mine).alias("confidence"),
        entity_evidence(theirs, mine).alias("evidence"),
    )
    if not once or longer is not None:
        edges = edges.dropDuplicates(["source_ord", "target_ord"])
    return edges.drop("source_ord", "target_ord")


def entity_signature(entities: Column) -> Column:
    """Key shared by documents whose overlap score is 1: the sorted list, null if it has repeats."""
    unique = F.array_distinct(entities)
    return F.when((F.size(entities) > 0) & (F.size(unique) == F.size(entities)), F.array_sort(unique))


def _at_most_two(entities: Column) -> Column:
    """Counting without pairs needs short lists; longer ones are refused, not miscounted."""
    error = F.raise_error(F.lit("relationships of more than two entities can be listed, not counted"))
    return F.when(F.size(entities) > 2, error.cast("array<string>")).otherwise(entities)


def entity_pair_counts(df: DataFrame, entities: str = "entities") -> DataFrame:
    """Per entity: documents, pairs that share only part of their lists, pairs with equal lists.

    For lists of at most two entities a pair either has equal lists (score 1) or shares exactly one
    entity (score 0.5), so both numbers follow from group sizes and no pair is formed. Longer lists raise.
    """
    listed = df.select(_at_most_two(F.col(entities)).alias("entities"))
    members = listed.select(
        F.explode(F.array_distinct("entities")).alias("entity"), entity_signature(F.col("entities")).alias("signature")
    )
    per_signature = members.groupBy("entity", "signature").agg(F.count(F.lit(1)).alias("n"))
    full = F.when(F.col("signature").isNotNull(), pairs_in(F.col("n"))).otherwise(F.lit(0).cast(COUNT))
    totals = per_signature.groupBy("entity").agg(F.sum("n").alias("n_docs"), F.sum(full).alias("n_pairs_full"))
    return totals.select(
        "entity",
        "n_docs",
        (pairs_in(F.col("n_docs")) - F.col("n_pairs_full")).alias("n_pairs_part"),
        "n_pairs_full",
    )


# --- bipartite links (J2, J3) ------------------------------------------------------------------


def _side_stats(side: DataFrame, name: str) -> DataFrame:
    """Per key: number of documents of one side, its first and its last document."""
    doc = F.struct("ord", "path")
    return side.groupBy("group_key").agg(
        F.count(F.lit(1)).alias(f"n_{name}"), F.min(doc).alias(f"first_{name}"), F.max(doc).alias(f"last_{name}")
    )


def link_invoice_orders(df: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """INV-n <-> PO-n (J2): every invoice to the first order of its number, every further order to the
    first invoice. `n_pairs` is the number of relationships the whole key stands for."""
    name = F.lower(last_segment(F.col("path")))
    key = lambda p: F.regexp_extract(name, p, 1)
    keyed = df.select(
        "ord", "path", key(r"^inv(?:oice)?[-_]?([0-9]+)").alias("inv"), key(r"^po[-_]?([0-9]+)").alias("po")
    )
    docs = keyed.filter((F.col("inv") != "") | (F.col("po") != "")).select(
        "ord",
        "path",
        F.when(F.col("inv") != "", F.lit("invoice")).otherwise(F.lit("order")).alias("role"),
        F.when(F.col("inv") != "", F.col("inv")).otherwise(F.col("po")).alias("group_key"),
    )
    of = lambda role, value: F.when(F.col("role") == role, value)
    doc = F.struct("ord", "path")
    stats = (
        docs.groupBy("group_key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(of("invoice", F.lit(1))).alias("n_invoice"),
            F.count(of("order", F.lit(1))).alias("n_order"),
            F.min(of("invoice", doc)).alias("first_invoice"),
            F.min(of("order", doc)).alias("first_order"),
        )
        .filter((F.col("n_invoice") > 0) & (F.col("n_order") > 0))
    )
    joined = join_groups(docs, stats, ["group_key"], F.col("ord"), hot_rows=hot_rows)
    is_invoice = F.col("role") == "invoice"
    edges = joined.filter(is_invoice | (F.col("ord") != F.col("first_order.ord")))
    return edges.select(
        F.when(is_invoice, F.col("path")).otherwise(F.col("first_invoice.path")).alias("source"),
        F.when(is_invoice, F.col("first_order.path")).otherwise(F.col("path")).alias("target"),
        F.lit("invoice_for_po").alias("type"),
        F.lit(FILENAME_CONFIDENCE).alias("confidence"),
        F.concat(F.lit("Filename pattern match: "), F.col("group_key")).alias("evidence"),
        "group_key",
        (F.col("n_invoice").cast("decimal(19,0)") * F.col("n_order").cast("decimal(18,0)")).alias("n_pairs"),
    )


def reference_mentions(df: DataFrame, text: str = "text", own_id: str = "own_id") -> DataFrame:
    """Rows (ord, path, group_key, holds_it): the ids a text names, once each, and whether it holds the id itself."""
    found = F.regexp_extract_all(F.col(text), F.lit(REFERENCE_CANDIDATE), F.lit(0))
    ids = F.array_distinct(F.filter(found, lambda m: m.rlike(REFERENCE_START)))
    mentions = df.select("ord", "path", F.explode(ids).alias("group_key"), F.col(own_id).alias("_own"))
    holds_it = F.coalesce(F.col("_own") == F.col("group_key"), F.lit(False))
    return mentions.withColumn("holds_it", holds_it).drop("_own")


def reference_holders(df: DataFrame, own_id: str = "own_id") -> DataFrame:
    """Per id: the number of documents that hold it, the first and the last."""
    own = df.select("ord", "path", F.col(own_id).alias("group_key")).filter(F.col("group_key").isNotNull())
    return _side_stats(own, "holder")


def reference_edges(joined: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Edges of mentions joined with the holders of their ids; mentions without another holder go."""
    others = F.col("n_holder") - F.col("holds_it").cast("bigint")
    target = F.when(F.col("first_holder.ord") == F.col("ord"), F.col("last_holder.path")).otherwise(
        F.col("first_holder.path")
    )
    return (
        joined.withColumn("n_targets", others)
        .filter(F.col("n_targets") > 0)
        .select(
            F.col("path").alias("source"),
            target.alias("target"),
            F.lit("explicit_reference").alias("type"),
            F.lit(REFERENCE_CONFIDENCE).alias("confidence"),
            F.concat(F.lit("References "), F.col("group_key")).alias("evidence"),
            "group_key",
            "n_targets",
            *carry,
        )
    )


def link_reference(
    df: DataFrame, text: str = "text", own_id: str = "own_id", hot_rows: int | None = None
) -> DataFrame:
    """A text that names another document's id (J3): document -> first other holder of that id.

    `n_targets` counts all other holders; they share `group_key`, so none is lost. The holders are written
    out, so that texts are read once; with `hot_rows` the mentions are counted and hot ids salted instead.
    """
    holders = reference_holders(df, own_id)
    if hot_rows is None:  # Spark splits an id that very many texts mention only if the other side is no aggregate
        holders = merged_if_many(cut(holders))
    mentions = reference_mentions(df, text, own_id)
    return reference_edges(join_skewed(mentions, holders, ["group_key"], F.col("ord"), hot_rows=hot_rows))


# --- temporal links (J5) -----------------------------------------------------------------------


def temporal_confidence(days_apart: Column, days: int) -> Column:
    """1.0 on the same day, falling to 0.5 at the window's end."""
    return 1 - 0.5 * days_apart / days


def day_cells(df: DataFrame, block: str, date: str) -> DataFrame:
    """Rows (block, day, n, first, last): the documents of a block and day, their first and last."""
    return (
        df.filter(F.col(block).isNotNull() & F.col(date).isNotNull())
        .groupBy(F.col(block).alias("block"), F.col(date).cast("date").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("ord", "path")).alias("first"),
            F.max(F.struct("ord", "path")).alias("last"),
        )
    )


def link_temporal(df: DataFrame, block: str, date: str, days: int = TEMPORAL_DAYS) -> DataFrame:
    """Documents of one block at most `days` apart, as links between its calendar days.

    Rows are first reduced to (block, day) cells. A cell then meets the later cells of its own and the
    next bin of `days` days in an equi-join on (block, bin). A bin holds at most `days` cells, so no key
    grows with the number of documents and a cell has at most `days` partners. `n_pairs` document pairs
    stand behind each row; source and target are the cells' first documents (first and last within one
    day).
    """
    return link_cells(day_cells(df, block, date), days)


def link_cells(cells: DataFrame, days: int = TEMPORAL_DAYS, changed: Column | None = None) -> DataFrame:
    """The links of `link_temporal` from the cells of `day_cells`; with `changed`, a flag of the cells that is never
    null, only those of two days of which one is changed."""
    flag = F.lit(True) if changed is None else changed
    cells = cells.withColumn("_changed", flag).withColumn("bin", F.floor(F.unix_date("day") / days))
    earlier = cells.select(
        "block",
        "bin",
        F.col("day").alias("day_a"),
        F.col("n").alias("n_a"),
        F.col("first").alias("first_a"),
        F.col("_changed").alias("_changed_a"),
    )
    later = cells.select("block", "day", "n", "first", "_changed", F.explode(F.array("bin", F.col("bin") - 1)).alias("bin"))
    gap = F.datediff("day", "day_a")
    across = (
        earlier.join(later, ["block", "bin"])
        .filter(gap.between(1, days) & (F.col("_changed_a") | F.col("_changed")))
        .select(
            "block",
            "day_a",
            F.col("day").alias("day_b"),
            gap.alias("days_apart"),
            (F.col("n_a").cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")).alias("n_pairs"),
            F.col("first_a.path").alias("source"),
            F.col("first.path").alias("target"),
        )
    )
    within = cells.filter((F.col("n") > 1) & F.col("_changed")).select(
        "block",
        F.col("day").alias("day_a"),
        F.col("day").alias("day_b"),
        F.lit(0).alias("days_apart"),
        pairs_in(F.col("n")).alias("n_pairs"),
        F.col("first.path").alias("source"),
        F.col("last.path").alias("target"),
    )
    return (
        across.unionByName(within)
        .withColumn("type", F.lit("temporal_proximity"))
        .withColumn("confidence", temporal_confidence(F.col("days_apart"), days))
        .withColumn("evidence", F.concat(F.col("days_apart").cast("string"), F.lit(" days apart")))
    )


# --- threshold, consolidation, whole mapping (G6-G8) --------------------------------------------


def threshold(edges: DataFrame, minimum: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    return edges.filter(F.col("confidence") >= minimum)


def consolidate(edges: DataFrame, order: str = "detector") -> DataFrame:
    """One row per (source, target): best confidence (earliest detector on ties), all evidence in
    detector order, and the list of types when there was more than one hit.

    A pair has one hit per detector rule, so the list per group is as short as the rule list.
    """
    hit = F.struct(order, "type", "evidence", "confidence")
    # the list alone is aggregated, and the best hit is taken from it: one buffer to sort and shuffle, not three
    listed = edges.groupBy("source", "target").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    ranked = F.transform("hits", lambda h: F.struct(-h["confidence"], h[order], h["type"].alias("type")))
    return _merged(
        listed.withColumn("type", F.array_min(ranked)["type"]).withColumn(
            "confidence", F.array_max(F.transform("hits", lambda h: h["confidence"]))
        )
    )


def _merged(df: DataFrame) -> DataFrame:
    return df.select(
        "source",
        "target",
        "type",
        "confidence",
        F.array_join(F.transform("hits", lambda h: h["evidence"]), " | ").alias("evidence"),
        F.when(F.size("hits") > 1, F.transform("hits", lambda h: h["type"])).alias("detection_methods"),
    )


def _relationship_keys(df: DataFrame, detectors: Sequence[str], minimum: float) -> DataFrame:
    """Per document: its file-name keys, its entities and the keys under which partners are found."""
    none = F.array().cast("array<struct<rule:int,type:string,key:string>>")
    names = filename_keys(F.col("path")) if "filename_pattern" in detectors and minimum <= FILENAME_CONFIDENCE else none
    entities = F.col("entities") if "entity_matching" in detectors else F.array().cast("array<string>")
    keyed = df.select("ord", "path", names.alias("names"), entities.alias("entities"))
    by_name = F.transform("names", lambda h: F.concat_ws(":", F.lit("name"), h["rule"].cast("string"), h["key"]))
    if minimum > ENTITY_MIN_SCORE:
        by_entity = entity_keys(F.col("entities"), minimum)
    else:
        by_entity = entity_keys(F.col("entities"), ENTITY_MIN_SCORE, False)
    return keyed.withColumn("keys", F.concat(by_name, by_entity))


def _usable(df: DataFrame, detectors: Sequence[str] | None) -> list[str]:
    """The named detectors, or all that find their columns; unknown names and missing columns raise."""
    missing = {d: [c for c in needs if c not in df.columns] for d, needs in NEEDS.items()}
    if detectors is None:
        return [d for d in DETECTORS if not missing[d]]
    for d in detectors:
        if d not in NEEDS:
            raise ValueError(f"unknown detector: {d}; there are {', '.join(DETECTORS)}")
        if missing[d]:
            raise ValueError(f"{d} needs {', '.join(missing[d])}")
    return list(detectors)


def _hit(detector: Column, type_: Column, evidence: Column, confidence: Column) -> Column:
    return F.struct(
        detector.cast("int").alias("detector"), type_.alias("type"), evidence.alias("evidence"), confidence.alias("confidence")
    )


def map_relationships(
    df: DataFrame,
    detectors: Sequence[str] | None = None,
    minimum: float = CONFIDENCE_THRESHOLD,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Detect, drop weak hits, consolidate (G8). Needs `ord`, `path` and the columns of its detectors:
    `entities` for entity_matching, `text` and `own_id` for explicit_reference, `block` and `date` for
    temporal_correlation. Without `detectors`, all run that find their columns.

    File names and entities give the relationship from each group's first document to every other member.
    Both documents' keys are at hand on the joined row, so a row carries *all* evidence for its pair,
    including hits from groups whose first document is another one. References run from the document that
    names to the one that is named; temporal hits link the first documents of two days (or the first and
    last of one). Hits of one (source, target) become one row, in the order of the detectors.
    """
    detectors = _usable(df, detectors)
    parts = []
    if set(detectors) & set(GROUP_DETECTORS):
        parts.append(_group_hits(df, detectors, minimum, hot_rows))
    rules = len(FILENAME_RULES)
    single = lambda n: F.array(_hit(F.lit(n), F.col("type"), F.col("evidence"), F.col("confidence"))).alias("hits")
    if "explicit_reference" in detectors:
        named = threshold(link_reference(df.select("ord", "path", "text", "own_id")), minimum)
        parts.append(named.select("source", "target", single(rules + 1)))
    if "temporal_correlation" in detectors:
        near = threshold(link_temporal(df.select("ord", "path", "block", "date"), "block", "date"), minimum)
        parts.append(near.select("source", "target", single(rules + 3)))
    found = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        found = found.groupBy("source", "target").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    best = F.aggregate(
        F.slice("hits", 2, F.greatest(F.size("hits"), F.lit(1))),
        F.col("hits")[0],
        lambda acc, h: F.when(h["confidence"] > acc["confidence"], h).otherwise(acc),
    )
    scored = found.withColumn("_best", best)
    return _merged(scored.withColumn("type", F.col("_best.type")).withColumn("confidence", F.col("_best.confidence")))


def _group_hits(df: DataFrame, detectors: Sequence[str], minimum: float, hot_rows: int | None) -> DataFrame:
    """(source, target, hits) of file names and entities, one row per pair."""
    keyed = _relationship_keys(df, detectors, minimum)
    members = keyed.select(
        "ord", "path", "names", "entities", F.lit("any").alias("type"), F.explode("keys").alias("group_key")
    )
    stats = group_stats(members, ["names", "entities"])
    joined = join_groups(members, stats, GROUP, F.col("ord"), hot_rows=hot_rows).filter(
        F.col("ord") != F.col("first.ord")
    )
    doc = ("ord", "path", "names", "entities")
    found = joined.select(F.struct(*[F.col(f"first.{c}").alias(c) for c in doc]).alias("first"), F.struct(*doc).alias("other"))
    if "entity_matching" in detectors:
        inclusive = minimum > ENTITY_MIN_SCORE
        longer = _linked_by_entities(keyed.select(*doc), minimum if inclusive else ENTITY_MIN_SCORE, inclusive)
        if longer is not None:
            found = found.unionByName(longer)
    by_name = F.transform(
        F.array_intersect("first.names", "other.names"),
        lambda h: _hit(
            h["rule"], h["type"], F.concat(F.lit("Filename pattern match: "), h["key"]), F.lit(FILENAME_CONFIDENCE)
        ),
    )
    score = overlap_score(F.col("first.entities"), F.col("other.entities"))
    evidence = entity_evidence(F.col("first.entities"), F.col("other.entities"))
    hit = _hit(F.lit(len(FILENAME_RULES) + 2), F.lit("shared_entities"), evidence, score)
    by_entity = F.array_compact(F.array(F.when((score > ENTITY_MIN_SCORE) & (score >= minimum), hit)))
    edges = found.select(
        F.col("first.ord").alias("source_ord"),
        F.col("other.ord").alias("target_ord"),
        F.col("first.path").alias("source"),
        F.col("other.path").alias("target"),
        F.concat(by_name, by_entity).alias("hits"),
    )
    return edges.dropDuplicates(["source_ord", "target_ord"]).select("source", "target", "hits")


def _key_sets(df: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """Every non-empty subset of a document's keys (at most four keys: three rules, and one list of at most
    two entities; longer lists raise)."""
    if unknown := set(detectors) - set(GROUP_DETECTORS):
        raise ValueError(f"relationships of {', '.join(sorted(unknown))} can be listed, not counted")
    if "entity_matching" in detectors:
        df = df.withColumn("entities", _at_most_two(F.col("entities")))
    keyed = _relationship_keys(df, detectors, CONFIDENCE_THRESHOLD)
    types = F.concat(
        F.transform("names", lambda h: h["type"]),
        F.when(entity_signature(F.col("entities")).isNotNull(), F.array(F.lit("shared_entities"))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    tagged = keyed.select("ord", "path", F.arrays_zip(F.col("keys"), types.alias("types")).alias("tags"))
    subsets = F.aggregate(
        "tags",
        F.array(F.array().cast("array<struct<keys:string,types:string>>")),
        lambda acc, tag: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(tag)))),
    )
    exploded = tagged.select("ord", "path", F.explode(subsets).alias("subset")).filter(F.size("subset") > 0)
    return exploded.select(
        "ord",
        "path",
        F.to_json(F.transform("subset", lambda t: t["keys"])).alias("key_set"),
        F.transform("subset", lambda t: F.struct(t["keys"], t["types"])).alias("subset"),
    )


def relationship_counts(df: DataFrame, detectors: Sequence[str] = GROUP_DETECTORS) -> DataFrame:
    """Exact number of consolidated relationships per list of detection methods.

    Counting documents per key subset gives, for each subset of rules, the pairs that agree on at
    least those rules; inclusion-exclusion over the few rule subsets gives the pairs that agree on
    exactly those. No pair is formed.
    """
    sets = _key_sets(df, detectors)
    rules = F.transform(
        "subset",
        lambda t: F.struct(
            F.when(t["keys"].startswith("name:"), F.substring(t["keys"], 6, 1).cast("int"))
            .otherwise(F.lit(len(FILENAME_RULES) + 1))
            .alias("rule"),
            t["types"].alias("type"),
        ),
    )
    groups = sets.groupBy("key_set").agg(F.count(F.lit(1)).alias("n"), F.first(rules).alias("rules"))
    at_least = (
        groups.filter(F.col("n") > 1).groupBy("rules").agg(F.sum(pairs_in(F.col("n"))).alias("n_pairs"))
    )
    smaller = F.filter(
        F.aggregate(
            "rules",
            F.array(F.array().cast("array<struct<rule:int,type:string>>")),
            lambda acc, r: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(r)))),
        ),
        lambda s: F.size(s) > 0,
    )
    spread = at_least.select("n_pairs", F.size("rules").alias("size"), F.explode(smaller).alias("rules"))
    sign = F.when((F.col("size") - F.size("rules")) % 2 == 0, 1).otherwise(-1)
    exact = spread.groupBy("rules").agg(F.sum(sign * F.col("n_pairs")).alias("n_pairs"))
    methods = F.array_join(F.transform("rules", lambda r: r["type"]), " | ")
    return (
        exact.groupBy(methods.alias("detection_methods"))
        .agg(F.sum("n_pairs").alias("n_pairs"))
        .filter(F.col("n_pairs") > 0)
    )


def relationship_degrees(df: DataFrame, detectors: Sequence[str] = GROUP_DETECTORS, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Number of distinct related documents of every document, by the same counting."""
    sets = _key_sets(df, detectors).select("ord", "path", "key_set", F.size("subset").alias("size"))
    groups = sets.groupBy("key_set").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    joined = join_groups(sets, groups, ["key_set"], F.col("ord"), hot_rows=hot_rows)
    sign = F.when(F.col("size") % 2 == 1, 1).otherwise(-1)
    return joined.groupBy("ord", "path").agg(F.sum(sign * (F.col("n") - 1)).alias("degree"))
