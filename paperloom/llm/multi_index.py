"""SimHash near-duplicates by multi-index hashing.

1. Fingerprints. Every text's word shingles are hashed (XXH64); bit b of the fingerprint is the majority of
   the hashes' bits b. Hashes are counted block by block, so a long text costs no more memory than a short one.
2. Classes. Documents of one fingerprint go on as one, named by their least key. A fingerprint that a third of
   all documents share is one row from here on.
3. Tables. A fingerprint is two segments of 32 bits. Two fingerprints that differ in at most two bits differ in
   at most one bit of the first segment, or not at all in the second. So the table of first segments is asked
   with the Hamming ball of radius one around each first segment, the table of second segments with the
   segment itself. A link is asked for once, from the side that has a 0 in the flipped bit. Each match is
   verified on the whole fingerprint.
4. Crowded segments. Where one segment value belongs to more than `crowd` fingerprints, asking its table would
   pair all of them. Their links are found exactly without it: every fingerprint in or next to a crowded
   segment also stands at all places one bit away. Two of them differ in at most two bits if and only if they
   stand at a common place, and at most 65 fingerprints can stand at any place, whatever the data.
5. Components of the links, joined back to the documents by fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.common import give_back, settle, slices
from paperloom.operators.graph import connected
from paperloom.operators.keys import join_groups

SHINGLE = 3
SEED = 42
DISTANCE = 2
CROWD = 64
#: Shingles whose bits are counted at a time, and bytes of text that a slice of a batch holds.
BLOCK, SLICE = 1 << 14, 1 << 24
#: Documents of one fingerprint from which their rows are dealt out when components are joined back.
HOT_ROWS = 50_000

_LOW = 0xFFFFFFFF


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text: A-Z lower-cased, words between the bytes 9 to 13 and 32, shingles of
    `shingle` words joined by a space (with fewer words, all of them), repeats counted; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[: n - 1]])
    stops = ends[min(shingle, len(words)) - 1 :] - 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        spans = zip(begins[at : at + BLOCK].tolist(), stops[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, bits): the fingerprint of every row's text as the long of the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for part in slices(batch, "text", SLICE):
                bits = [fingerprint(t.as_py(), shingle, seed) for t in part.column("text")]
                signed = np.array(bits, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(signed)], ["key", "bits"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, bits long")


def _segments(bits: Column) -> Column:
    """(table, value) of the two segments."""
    part = lambda i, value: F.struct(F.lit(i).alias("table"), value.alias("value"))
    return F.array(part(1, F.shiftrightunsigned(bits, 32)), part(2, bits.bitwiseAND(F.lit(_LOW))))


def _asked(bits: Column) -> Column:
    """(table, value) of the places to ask: the first segment and each that has one more bit set, and the
    second segment itself."""
    first, second = F.shiftrightunsigned(bits, 32), bits.bitwiseAND(F.lit(_LOW))
    ask = lambda i, value: F.struct(F.lit(i).alias("table"), value.alias("value"))
    flips = [1 << i for i in range(32)]
    one_more = F.filter(F.array(*[F.lit(f).cast("long") for f in flips]), lambda f: first.bitwiseAND(f) == 0)
    return F.concat(
        F.transform(one_more, lambda f: ask(1, first.bitwiseOR(f))), F.array(ask(1, first), ask(2, second))
    )


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _ball(bits: Column) -> Column:
    """The 65 places at most one bit away."""
    flips = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    return F.concat(F.array(bits), F.transform(flips, lambda f: bits.bitwiseXOR(f)))


def links(classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Rows (source, target): links between different fingerprints that differ in at most two bits. `classes`
    has one row (bits, node) per fingerprint. All links outside crowded segments; in them, links that
    connect the same fingerprints (from the least at each place to the others there)."""
    table = classes.select("bits", "node", F.explode(_segments(F.col("bits"))).alias("at")).select("at.*", "bits", "node")
    crowded = settle(
        table.groupBy("table", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("table", "value")
    )
    asked = classes.select(
        F.col("bits").alias("_bits"), F.col("node").alias("_node"), F.explode(_asked(F.col("bits"))).alias("at")
    ).select("at.*", "_bits", "_node")
    place = ["table", "value"]
    plain = crowded.isEmpty()
    open_table = table if plain else table.join(crowded, place, "left_anti")
    met = (
        asked.join(open_table, place)
        .filter((F.col("_bits") != F.col("bits")) & (_distance(F.col("_bits"), F.col("bits")) <= DISTANCE))
        .select(F.col("_node").alias("source"), F.col("node").alias("target"))
    )
    if plain:
        return met
    near = asked.join(crowded, place, "left_semi").select(F.col("_bits").alias("bits"), F.col("_node").alias("node")).distinct()
    standing = near.select(F.explode(_ball(F.col("bits"))).alias("place"), "node")
    # at most 65 fingerprints can stand at a place
    there = standing.groupBy("place").agg(F.collect_list("node").alias("nodes")).filter(F.size("nodes") > 1)
    least = F.array_min("nodes").alias("source")
    return met.unionByName(there.select(least, F.explode("nodes").alias("target")).filter("source <> target"))


def simhash_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    seed: int = SEED,
    crowd: int = CROWD,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per row of `docs`: key, fingerprint (16 lowercase hex digits), component_id.

    Documents are linked if their fingerprints differ in at most two bits. `component_id` is the least key
    that can be reached by links, the document's own included. A text that is null, empty or without words
    has the fingerprint zero and is linked like any other. Rows of one key count as one document: their
    links are joined. A row with a null key has its fingerprint, a null component and links with nothing.
    Repeated rows give repeated rows; only the named columns are read, so others may have any name.
    """
    marks = settle(fingerprints(docs, key, text, shingle, seed))
    keyed = marks.filter(F.col("key").isNotNull())
    classes = settle(keyed.groupBy("bits").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("n")))
    found = links(classes, crowd)
    least = classes.select("bits", F.col("node").alias("_node"))
    several = keyed.groupBy("key").agg(F.min("bits").alias("a"), F.max("bits").alias("b")).filter("a <> b").select("key")
    several = settle(several)
    if not several.isEmpty():  # a key with several fingerprints joins their classes
        of = keyed.join(several, "key").distinct().join(least, "bits")
        found = found.unionByName(of.select(F.col("key").alias("source"), F.col("_node").alias("target")))
    joined = connected(found).select(F.col("node"), F.col("cluster").alias("root"))
    named = classes.join(joined, "node", "left").select("bits", "n", F.coalesce("root", "node").alias("root"))
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    out = join_groups(marks, named, ["bits"], F.col("key"), how="left", hot_rows=hot_rows)
    return out.select(
        F.col("key").alias(key),
        digits.alias("fingerprint"),
        F.when(F.col("key").isNotNull(), F.col("root")).alias("component_id"),
    )
