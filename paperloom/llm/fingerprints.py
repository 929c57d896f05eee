"""Document fingerprints: one-permutation MinHash, all in column expressions.

Every shingle (five words in a row; a shorter text is one shingle) is hashed once. The top bits of the
hash choose a bin, the rest is its value, and a bin keeps its least value. An empty bin i borrows from
the non-empty bin that comes first in an order of all bins drawn for i (optimal densification: such an
order is what repeated draws of a random bin until one is non-empty amount to). The low-order bits of
the bins, packed as hex digits, are the fingerprint. Two unrelated bins agree in b bits with
probability 2^-b, and `likeness` corrects for that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.llm.common import SPACE, settle

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
_LOW = (1 << LOW_BITS) - 1
_DIGITS = LOW_BITS // 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """One 64-bit hash per k words in a row; fewer words are one shingle; without words there is none."""
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")

    def windows(w: Column) -> Column:
        long = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[w[i + j] for j in range(k)]))
        return F.when(F.size(w) >= k, long).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array())

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BIN_BITS)


def bin_minima(hashes: Column) -> Column:
    """The least value of each non-empty bin, bin number included, in one fixed order of bins."""
    return let(
        F.sort_array(hashes),
        lambda h: F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1)))),
    )


def densified(minima: Column) -> Column:
    """Low-order bits of all bins; `minima` has one entry at least."""

    def fill(m: Column) -> Column:
        bins = F.transform(m, _bin)

        def of(b: Column) -> Column:
            def bit(i: Column) -> Column:
                at = F.array_position(b, i)
                order = F.transform(
                    m, lambda x: F.xxhash64(i, _bin(x)).bitwiseAND(F.lit(~_LOW)).bitwiseOR(x.bitwiseAND(F.lit(_LOW)))
                )
                return F.when(at > 0, F.get(m, (at - 1).cast("int"))).otherwise(F.array_min(order)).bitwiseAND(F.lit(_LOW))

            return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), bit)

        return let(bins, of)

    return let(minima, fill)


def fingerprint(text: Column) -> Column:
    """Packed fingerprint of a text; the empty string for a text without words."""

    def pack(m: Column) -> Column:
        digits = F.transform(densified(m), lambda x: F.lpad(F.lower(F.hex(x)), _DIGITS, "0"))
        return F.when(F.size(m) == 0, F.lit("")).otherwise(F.array_join(digits, ""))

    return let(bin_minima(shingle_hashes(text)), pack)


def likeness(one: Column, two: Column) -> Column:
    """Estimated Jaccard similarity of two shingle sets, from 0 to 1; two without shingles are alike."""
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        F.lit(0),
        lambda n, i: n
        + (F.substr(one, i * _DIGITS + 1, F.lit(_DIGITS)) == F.substr(two, i * _DIGITS + 1, F.lit(_DIGITS))).cast("int"),
    )
    chance = 2.0**-LOW_BITS
    return (
        F.when(one == two, 1.0)
        .when((one == "") | (two == ""), 0.0)
        .otherwise(F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance)))
    )


def _neighbours(ids: DataFrame) -> DataFrame:
    """Rows (key, h, half, next_key, next_h, prev_key, prev_h, prev_half): each document's neighbours in
    ascending order, as a ring. Documents are sorted in ranges; the ends of ranges are joined to the next."""
    parts = settle(
        ids.repartitionByRange(F.col("key").asc_nulls_first(), "h").withColumn("part", F.spark_partition_id())
    )
    me = F.struct(F.col("key"), F.col("h"), F.col("half"))
    ends = parts.groupBy("part").agg(
        F.min(F.struct(F.col("key").isNotNull(), me.alias("d"))).getField("d").alias("first"),
        F.max(F.struct(F.col("key").isNotNull(), me.alias("d"))).getField("d").alias("last"),
    )
    ring = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("part")  # one row per range
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(order), F.first("first").over(ring)).alias("_after"),
        F.coalesce(F.lag("last").over(order), F.last("last").over(ring)).alias("_before"),
    )
    inside = Window.partitionBy("part").orderBy(F.col("key").asc_nulls_first(), "h")
    linked = parts.withColumns({"_n": F.lead(me).over(inside), "_p": F.lag(me).over(inside)}).join(ends, "part")
    return linked.withColumns({"_n": F.coalesce("_n", "_after"), "_p": F.coalesce("_p", "_before")}).select(
        F.col("key").alias("_key"),
        F.col("h").alias("_h"),
        "half",
        F.col("_n.key").alias("next_key"),
        F.col("_n.h").alias("next_h"),
        F.col("_p.key").alias("prev_key"),
        F.col("_p.h").alias("prev_h"),
        F.col("_p.half").alias("prev_half"),
    )


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many (or
    all) of the next document, in ascending order of key, the first following the last. Null text is
    empty; a null key comes first; equal keys are ordered by a hash of the text. Rows equal in key and
    text are one document and give one row. A document that is alone is its own next one. Texts without
    words have an empty fingerprint, alike only to another empty one. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "h", F.xxhash64("text")
    )
    ids = settle(rows.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("_chars")))
    if (ids.agg(F.max("n")).first()[0] or 1) > 1:
        rows = rows.dropDuplicates(["key", "h"])
    links = settle(_neighbours(ids.select("key", "h", F.floor(F.col("_chars") / 2).cast("int").alias("half"))))
    own = F.col("key").eqNullSafe(F.col("_key")) & (F.col("h") == F.col("_h"))
    placed = rows.join(links, own)
    lent = placed.select(
        F.col("prev_key").alias("_to"),
        F.col("prev_h").alias("_to_h"),
        F.substr("text", F.lit(1), "prev_half").alias("borrowed"),
    )
    edited = (
        placed.join(lent, F.col("key").eqNullSafe(F.col("_to")) & (F.col("h") == F.col("_to_h")))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.substr("text", F.lit(1), F.length("text") - F.col("half")), "borrowed"))
    )
    marked = settle(
        edited.select(
            "key",
            "h",
            "next_key",
            "next_h",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("text")).alias("fingerprint"),
            fingerprint(F.col("edited")).alias("edited_fingerprint"),
        )
    )
    following = marked.select(
        F.col("key").alias("_key"), F.col("h").alias("_h"), F.col("fingerprint").alias("_next")
    )
    return marked.join(
        following, F.col("next_key").eqNullSafe(F.col("_key")) & (F.col("next_h") == F.col("_h"))
    ).select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )
