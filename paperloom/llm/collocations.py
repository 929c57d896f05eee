"""Phrase collocations by weighted acyclic automata (see `transducer`).

1. Words. Every shard counts its words; sums per language make the vocabulary of words that occur often
   enough. A word is a 64-bit label from here on, made of its language and its bytes. Two words with one label
   are noticed and raise.
2. Pairs, then longer phrases. Every shard makes count transducers of its sorted n-grams, one per prefix
   range, and only these travel. A range's transducers are united and their weights added up; n-grams below
   the least count are then dropped. A phrase can only be frequent if its words and its pairs are, so windows
   that contain another word or pair are left out before they are counted. What is frequent is told by a
   bitmap of fixed size: a false hit costs a window, never a result.
3. Prefix ranges are ranges of the first label. A first word with more than a range's share of all words is
   dealt on by the whole n-gram; an n-gram that is itself frequent is one arc per shard.
4. Lookups. The parts of the candidates (distinct ones) are composed with the united transducers of their
   ranges, which gives each part's count. Single words are looked up in the vocabulary, with salts, as a
   common word is a part of very many phrases.
5. Scores are exact decimals; the best of each language are picked in two steps, so that no language has to
   be sorted in one task.

Memory is bounded per task by SHARD words when counting, by the n-grams of one range when uniting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperloom.llm.common import give_back, mix, parts_for, settle, slices, text_bytes
from paperloom.llm.transducer import Grams, build, compose, count_windows, grams_of, pack, union, unpack

LONGEST = 5
LEAST = 100
TOP = 2000
UNKNOWN = "und"
#: Words a shard counts at a time, words (of the corpus) a prefix range stands for, and ranges at most.
SHARD_WORDS, RANGE_WORDS, MOST_RANGES = 1 << 20, 1 << 21, 1 << 16
#: N-grams that wait to be united, distinct words a shard collects, bytes of text in a slice and in a step of it.
WAITING, DISTINCT, SLICE, STEP = 1 << 20, 1 << 18, 1 << 22, 1 << 19
#: Bitmaps hold 2 ** BITS bits whatever the corpus: 8 MB.
BITS = 26
SALTS = 64

_KIND = np.zeros(256, np.uint8)  # 0 part of a word, 1 ends a word, 2 ends a piece
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTOR = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd factor modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
            p = np.full(max(n, 2 * STEP), np.uint64(base), np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS


@dataclass
class Words:
    """Words of a batch of texts in order: where they begin and end in `flat`, label, piece, text."""

    flat: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    label: np.ndarray
    piece: np.ndarray
    text: np.ndarray

    def word(self, i: int) -> str:
        return self.flat[self.begin[i] : self.end[i]].tobytes().lower().decode()


def _steps(flat: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of whole words of about STEP bytes; `flat` ends with a byte that ends a piece."""
    at = 0
    while at < len(flat):
        size = STEP
        while True:
            kinds = _KIND[flat[at : at + size]]
            if at + size >= len(flat):
                break
            back = int((kinds[::-1] > 0).argmax())
            if kinds[len(kinds) - 1 - back]:
                kinds = kinds[: len(kinds) - back]
                break
            size *= 2
        yield at, kinds
        at += len(kinds)


def split_words(texts: pa.Array, langs: list[str | None]) -> Words:
    """Words of whole texts: A-Z lower-cased, cut at `.,;:!?` and the bytes 10 to 13 into pieces and at
    spaces and tabs into words."""
    wide = pa.large_string()
    closed = pc.binary_join_element_wise(pc.cast(texts, wide).fill_null(""), pa.scalar("", wide), pa.scalar("\n", wide))
    flat, offsets = text_bytes(closed)
    begins, ends, hashes, pieces, before = [], [], [], [], 0
    for at, kinds in _steps(flat):
        inside = np.concatenate([[0], (kinds == 0).view(np.int8), [0]])
        edge = np.diff(inside)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        closes = np.cumsum(kinds == 2)
        pieces.append(before + closes[begin])
        before += int(closes[-1])
        up, down = _powers(len(kinds) + 1)
        sums = np.zeros(len(kinds) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[flat[at : at + len(kinds)]]] * up[: len(kinds)], out=sums[1:])
        hashes.append(mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)))
        begins.append(begin + at)
        ends.append(end + at)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    begin = join(begins, np.int64)
    text = np.repeat(np.arange(len(langs)), np.diff(np.searchsorted(begin, offsets)))
    own = [UNKNOWN if lang is None else lang for lang in langs]
    digest = lambda lang: hashlib.blake2b(lang.encode(), digest_size=8).digest()
    of = {lang: int.from_bytes(digest(lang), "little") for lang in set(own)}
    seeds = np.array([of[lang] for lang in own], np.uint64)
    label = np.maximum(mix(join(hashes, np.uint64) + seeds[text]), np.uint64(1))
    return Words(flat, begin, join(ends, np.int64), label, join(pieces, np.int64), text)


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str | None]]]:
    for batch in batches:
        give_back()
        for part in slices(batch, "text", SLICE):
            langs = part.column("lang").to_pylist()
            yield split_words(part.column("text"), langs), langs


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, label, word, n) of all words, whatever their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        names: dict[int, tuple[str, str]] = {}

        def flush() -> pa.RecordBatch:
            langs, words = zip(*[names[x] for x in labels.tolist()], strict=True) if len(labels) else ((), ())
            columns = [pa.array(langs, pa.string()), pa.array(labels.view(np.int64)), pa.array(words, pa.string()), pa.array(counts)]
            names.clear()
            return pa.RecordBatch.from_arrays(columns, ["lang", "label", "word", "n"])

        for words, langs in _batches(batches):
            found, where, n = np.unique(words.label, return_index=True, return_counts=True)
            fresh = ~np.isin(found, labels, assume_unique=True)
            for label, i in zip(found[fresh].tolist(), where[fresh].tolist(), strict=True):
                lang = langs[words.text[i]]
                names[label] = (UNKNOWN if lang is None else lang, words.word(i))
            merged, to = np.unique(np.concatenate([labels, found]), return_inverse=True)
            sums = np.zeros(len(merged), np.int64)
            np.add.at(sums, to, np.concatenate([counts, n]))
            labels, counts = merged, sums
            if len(labels) > DISTINCT:
                yield flush()
                labels, counts = labels[:0], counts[:0]
        yield flush()

    found = rows.mapInArrow(run, "lang string, label long, word string, n long")
    return found.groupBy("lang", "label", "word").agg(F.sum("n").alias("n"))


def bitmap(marks: DataFrame) -> np.ndarray:
    """The 64-bit numbers of a column `mark` as a bitmap of 2**BITS bits, by their first BITS bits."""
    bit = F.shiftrightunsigned("mark", 64 - BITS)
    one = F.expr("shiftleft(1L, cast(_bit & 63 AS int))")
    words = marks.select(bit.alias("_bit")).select(F.shiftright("_bit", 6).alias("at"), one.alias("bits"))
    set_ = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**(BITS - 6) rows
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[set_["at"].to_numpy()] = set_["bits"].to_numpy().view(np.uint64)
    return out


def _is_set(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = marks >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _path_hash(labels: np.ndarray) -> np.ndarray:
    """A hash of every row of labels (0 after the end)."""
    out = labels[:, 0].copy()
    for column in labels.T[1:]:
        out = np.where(column > 0, mix(out + column * np.uint64(_FACTOR)), out)
    return out


@dataclass
class Ranges:
    """Prefix ranges: `n` equal ranges of the first label; first labels in `hot` are dealt to `dealt` cells
    each, from `base` on, by the hash of the whole n-gram."""

    n: int
    hot: np.ndarray
    dealt: np.ndarray
    base: np.ndarray

    def cells(self, labels: np.ndarray) -> np.ndarray:
        first = labels[:, 0]
        cell = (((first >> np.uint64(32)) * np.uint64(self.n)) >> np.uint64(32)).astype(np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
            is_hot = self.hot[at] == first
            at = at[is_hot]
            cell[is_hot] = self.base[at] + (_path_hash(labels[is_hot]) % self.dealt[at].astype(np.uint64)).astype(np.int64)
        return cell


def ranges_of(vocabulary: DataFrame, range_words: int = RANGE_WORDS) -> tuple[Ranges, int]:
    """The ranges for a vocabulary, and how many cells there are. At most `n` words can be hot, each holding
    more than one range's share of all words."""
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    n = min(parts_for(int(total), range_words), MOST_RANGES)
    hot = vocabulary.filter(F.col("n") * n > total).select("label", "n").collect() if n > 1 else []
    pairs = sorted((r["label"] % (1 << 64), -(-r["n"] * n // total)) for r in hot)
    dealt = np.array([d for _, d in pairs], np.int64)
    base = n + np.concatenate([[0], np.cumsum(dealt)[:-1]]) if len(pairs) else dealt
    return Ranges(n, np.array([x for x, _ in pairs], np.uint64), dealt, base), n + int(dealt.sum())


def _reach(joined: np.ndarray, most: int) -> np.ndarray:
    """How many words, `most` at most, follow each other from every word on."""
    reach, on = np.ones(len(joined), np.int64), joined.copy()
    for i in range(1, most):
        reach += on
        on[: len(on) - i] &= joined[i:]
        on[len(on) - i :] = False
    return reach


def shard_transducers(
    rows: DataFrame, words: np.ndarray, pairs: np.ndarray | None, ranges: Ranges, least: int, most: int, shard_words: int
) -> DataFrame:
    """(cell, data): count transducers of every shard's n-grams of `least` to `most` words, one per prefix
    range. Windows hold only words in the bitmap `words` and, if given, only pairs in the bitmap `pairs`."""
    sc = rows.sparkSession.sparkContext
    words_there, pairs_there = sc.broadcast(words), None if pairs is None else sc.broadcast(pairs)

    def machines(labels: np.ndarray, joined: np.ndarray) -> pa.RecordBatch:
        reach = _reach(joined, most)
        grams = count_windows(labels, np.arange(len(labels)), reach, least, most)
        cells = ranges.cells(grams.labels()) if len(grams) else np.zeros(0, np.int64)
        order = np.argsort(cells, kind="stable")
        grams = Grams(grams.alphabet, grams.ranks[order], grams.weights[order])
        found, starts = np.unique(cells[order], return_index=True)
        data = []
        for a, b in zip(starts, np.append(starts[1:], len(cells)), strict=True):
            here = np.zeros(len(cells), bool)
            here[a:b] = True
            data.append(pack(build(grams.where(here))))
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(data, pa.binary())], ["cell", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = machines(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
            held.clear()
            return out

        for found, _ in _batches(batches):
            usual = _is_set(words_there.value, found.label)
            joined = np.zeros(len(usual), bool)  # with the word after it
            joined[:-1] = usual[:-1] & usual[1:] & (found.piece[:-1] == found.piece[1:])
            if pairs_there is not None and len(joined):
                at = np.flatnonzero(joined)
                two = np.stack([found.label[at], found.label[at + 1]], axis=1)
                joined[at] = _is_set(pairs_there.value, _path_hash(two))
            used = joined.copy()
            used[1:] |= joined[:-1]
            labels, joined = found.label[used], joined[used]
            at = 0
            while at < len(labels):  # a shard ends where no window runs on
                stops = np.flatnonzero(~joined[at + shard_words - size :])[:1] if len(labels) - at > shard_words - size else []
                end = at + shard_words - size + int(stops[0]) + 1 if len(stops) else len(labels)
                held.append((labels[at:end], joined[at:end]))
                size += end - at
                at = end
                if size >= shard_words:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return rows.mapInArrow(run, "cell long, data binary")


def unite(pieces: DataFrame, cells: int, least_count: int) -> DataFrame:
    """(cell, data): per prefix range the union of its transducers, without n-grams below the least count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, size = None, [], 0

        def result() -> pa.RecordBatch:
            whole = union(held)
            data = pack(build(whole.where(whole.weights >= least_count)))
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([data], pa.binary())], ["cell", "data"])

        for batch in batches:
            give_back()
            for now, data in zip(batch.column("cell").to_pylist(), batch.column("data"), strict=True):
                if now != cell:
                    if held:
                        yield result()
                    cell, held, size = now, [], 0
                held.append(grams_of(unpack(data.as_py())))
                size += len(held[-1])
                if size > WAITING and len(held) > 1:
                    held = [union(held)]
                    size = 0  # what is united already does not count again
        if held:
            yield result()

    dealt = pieces.repartition(parts_for(cells, 2), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "cell long, data binary")


def _binary(labels: np.ndarray) -> list[bytes]:
    """Rows of labels as bytes, eight a label, high byte first, without the zeros after the end."""
    raw = labels.astype(">u8").tobytes()
    width = 8 * labels.shape[1]
    sizes = 8 * (labels > 0).sum(1)
    return [raw[i * width : i * width + n] for i, n in enumerate(sizes.tolist())]


def _matrix(paths: list[bytes]) -> np.ndarray:
    width = max(map(len, paths), default=8)
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in paths), ">u8").reshape(-1, width // 8).astype(np.uint64)


def _per_machine(machines: DataFrame, make: Callable[[Grams], dict[str, pa.Array]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                grams = grams_of(unpack(data.as_py()))
                labels = grams.labels()
                for at in range(0, len(grams), 1 << 16):
                    part = make(labels[at : at + (1 << 16)], grams.weights[at : at + (1 << 16)])
                    yield pa.RecordBatch.from_pydict(part)

    return machines.select("data").mapInArrow(run, schema)


def phrases_of(machines: DataFrame) -> DataFrame:
    """(gram, a) of united transducers."""
    made = lambda labels, weights: {"gram": pa.array(_binary(labels), pa.binary()), "a": pa.array(weights)}
    return _per_machine(machines, made, "gram binary, a long")


def _pair_marks(machines: DataFrame) -> DataFrame:
    made = lambda labels, _: {"mark": pa.array(_path_hash(labels).view(np.int64))}
    return _per_machine(machines, made, "mark long")


def cuts_of(candidates: DataFrame, ranges: Ranges) -> DataFrame:
    """(gram, a, k, side, part, level, cell): both parts of every cut of every candidate, and where the
    part's transducer is (`level` 2 for pairs, 3 for longer parts, 1 for single words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, weights = batch.column("gram").to_pylist(), batch.column("a").to_pylist()
            out = [
                (g, a, k, side, part)
                for g, a in zip(grams, weights, strict=True)
                for k in range(1, len(g) // 8)
                for side, part in ((0, g[: 8 * k]), (1, g[8 * k :]))
            ]
            if not out:
                continue
            columns = list(zip(*out, strict=True))
            level = np.minimum([len(p) // 8 for p in columns[4]], 3)
            cells = ranges.cells(_matrix(list(columns[4])))
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            arrays += [pa.array(level, pa.int32()), pa.array(cells, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["gram", "a", "k", "side", "part", "level", "cell"])

    return candidates.select("gram", "a").mapInArrow(
        run, "gram binary, a long, k int, side int, part binary, level int, cell long"
    )


def look_up(machines: DataFrame, asked: DataFrame) -> DataFrame:
    """(part, f): distinct parts (level, cell, part) composed with the transducers (level, cell, data)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        parts, weights = right.column("part").to_pylist(), []
        if len(left) and parts:
            weights = compose(_matrix(parts), unpack(left.column("data")[0].as_py())).tolist()
        return pa.table({"part": pa.array(parts[: len(weights)], pa.binary()), "f": pa.array(weights, pa.int64())})

    by = ["level", "cell"]
    return machines.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, "part binary, f long")


def _score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (F.lit(1000).cast("decimal(4,0)") * wide(a)).cast("decimal(22,0)") * n.cast("decimal(16,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(l) * r.cast("decimal(18,0)")).cast("decimal(38,0)"))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    percent: int = 100,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
    range_words: int = RANGE_WORDS,
) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    A phrase is 2 to `longest` words in a row inside a piece of a text; `a` is how often it occurs, overlaps
    included. Candidates occur at least `least` times. Cutting one after k words gives parts that occur l and
    r times, and a score of floor(1000 * a * n / (l * r)) for the n words of the language; its least score
    counts, of equal ones that of the least k. A candidate that lies inside a longer one with at least
    `percent` of its occurrences is dropped. Of the others, each language's first `top` by score, then a (both
    descending), then the phrase's bytes are returned with their rank.

    Null texts are empty, a null language is `und`. Texts without words count nothing; a table without
    candidates gives no rows. Repeated rows count as often as they occur; only the named columns are read, so
    others may have any name.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    rows = _rows(docs, text, lang)
    counted = settle(count_words(rows))
    if not counted.groupBy("label").count().filter("count > 1").isEmpty():
        raise ValueError("two words have one label")
    totals = settle(counted.groupBy("lang").agg(F.sum("n").alias("n")))
    vocabulary = settle(counted.filter(F.col("n") >= least))
    ranges, cells = ranges_of(vocabulary, range_words)
    words = bitmap(vocabulary.select(F.col("label").alias("mark")))

    def united(pairs: np.ndarray | None, low: int, high: int) -> DataFrame:
        pieces = shard_transducers(rows, words, pairs, ranges, low, high, shard_words)
        return settle(unite(pieces, cells, least))

    two = united(None, 2, 2)
    machines, found = two.withColumn("level", F.lit(2)), phrases_of(two)
    if longest > 2:
        more = united(bitmap(_pair_marks(two)), 3, longest)
        machines = machines.unionByName(more.withColumn("level", F.lit(3)))
        longer = settle(phrases_of(more))
        found = found.unionByName(longer)
        ends = F.array(F.expr("substring(gram, 1, length(gram) - 8)"), F.expr("substring(gram, 9)"))
        inside = longer.select(F.explode(ends).alias("gram"), "a").groupBy("gram").agg(F.max("a").alias("_longer"))
        # whatever lies in a longer candidate lies in one that is longer by one word and occurs as often at least
        found = found.join(inside, "gram", "left").filter(
            F.coalesce(100 * F.col("_longer") < percent * F.col("a"), F.lit(True))
        )
    cuts = settle(cuts_of(found, ranges))
    asked = cuts.filter("level > 1").select("level", "cell", "part").distinct()
    several = look_up(machines, asked).withColumns({"lang": F.lit(None).cast("string"), "salt": F.lit(0)})
    as_part = F.unhex(F.lpad(F.hex("label"), 16, "0")).alias("part")
    single = vocabulary.select(as_part, F.col("n").alias("f"), "lang", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.when(F.col("level") > 1, 0).otherwise(F.pmod(F.xxhash64("gram"), F.lit(SALTS))).cast("int")
    parts = cuts.withColumn("salt", salt).join(several.unionByName(single), ["part", "salt"])
    # each candidate has two parts per cut, eight at most
    seen = F.collect_list(F.struct("k", "side", "f")).alias("seen")
    whole = parts.groupBy("gram", "a").agg(F.max("lang").alias("lang"), seen).join(totals, "lang")
    side = lambda k, s: F.element_at(F.filter("seen", lambda x: (x["k"] == k) & (x["side"] == s)), 1)["f"]
    options = F.array_compact(
        F.array(
            *[
                F.when(
                    F.expr("length(gram)") > 8 * k,
                    F.struct(
                        _score(F.col("a"), F.col("n"), side(k, 0), side(k, 1)).alias("score"),
                        F.lit(k).alias("k"),
                        side(k, 0).alias("l"),
                        side(k, 1).alias("r"),
                    ),
                )
                for k in range(1, longest)
            ]
        )
    )
    scored = settle(whole.withColumn("cut", F.array_min(options)).select("lang", "gram", "a", "n", "cut.score", "cut.l", "cut.r"))
    order = [F.col("score").desc(), F.col("a").desc()]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).orderBy(*order)
    first = scored.withColumn("_at", F.rank().over(salted)).filter(F.col("_at") <= top)
    first = first.withColumn("_at", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_at") <= top)
    first = settle(first.drop("_at"))  # the first of every language, with all ties at the end
    labels = F.transform(F.sequence(F.lit(0), F.expr("length(gram) div 8 - 1")), lambda i: F.substring("gram", 8 * i.cast("int") + 1, F.lit(8)))
    named = first.select("gram", F.posexplode(labels).alias("at", "part")).join(vocabulary.select(as_part, "word"), "part")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    spelled = first.join(named.groupBy("gram").agg(phrase.alias("phrase")), "gram")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    return (
        spelled.withColumn("rank", rank)
        .filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
