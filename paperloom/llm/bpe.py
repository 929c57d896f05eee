"""Byte-level BPE, encoded in padded matrices and decoded by table.

Pieces of text (matches of the split pattern) that a worker has not met yet are sorted into buckets of
similar length. A bucket is a padded matrix of token ids with a matrix of pair ranks beside it. In each
round every row merges its leftmost pair of least rank: ranks of the two new pairs are looked up in a
hash table, the row closes the gap, and rows without a pair left leave the matrix. Whole texts are
then put together from the pieces' ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.common import slices

NONE = np.int32(2**31 - 1)
#: Pieces longer than this are merged with a heap: a matrix row would take a round per merge.
LONG_PIECE = 256
#: Pieces a worker remembers; beyond, it starts anew.
REMEMBERED = 400_000
MATRIX_CELLS = 1 << 20


class PairTable:
    """Ranks of id pairs in an open-addressing table that numpy probes for many pairs at once."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        size = 1 << max(4, (3 * len(pairs)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        ranks = np.array(list(pairs.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):  # each round the first pair at a free slot takes it, the others move on
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            takes = np.zeros(len(keys), bool)
            takes[first] = True
            takes &= free
            self.keys[slot[takes]], self.ranks[slot[takes]] = keys[takes], ranks[takes]
            keys, ranks, slot = keys[~takes], ranks[~takes], (slot[~takes] + 1) & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) >> np.uint64(7) & self.mask).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no pair; negative ids are padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys.ravel()[todo]
        slot = self._slot(keys)
        flat = out.reshape(-1)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys
            flat[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != -1)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & int(self.mask)
        return out


class Codec:
    """Ranks of a byte-level vocabulary (`{token bytes: id}`) with the split pattern of its texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {
            (ranks[t[:i]], ranks[t[i:]]): rank
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        self.table = PairTable(self.pairs)
        self.known: dict[str, bytes] = {}

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        """Token ids of every piece on its own."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        begin = int(np.searchsorted(lengths[order], 1))
        while begin < len(order):
            shortest = int(lengths[order[begin]])
            if shortest > LONG_PIECE:
                for i in order[begin:]:
                    out[i] = self._by_heap(pieces[i])
                break
            width = min(LONG_PIECE, shortest + max(2, shortest // 4))
            end = int(np.searchsorted(lengths[order], width, "right"))
            end = min(end, begin + max(1, MATRIX_CELLS // width))
            rows = order[begin:end]
            for i, ids in zip(rows, self._by_matrix([pieces[i] for i in rows], lengths[rows]), strict=True):
                out[i] = ids
            begin = end
        return out

    def _by_matrix(self, pieces: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
        n, width = len(pieces), int(lengths.max())
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        filled = np.arange(width)[None, :] < lengths[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[filled] = self.byte_id[raw]
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * n
        rank = np.full((n, width), NONE, np.int32)
        if width > 1:
            rank[:, :-1] = self.table.rank(ids[:, :-1], ids[:, 1:])
        row, left = np.arange(n), lengths.copy()
        columns = np.arange(width)
        while len(row):
            at = rank.argmin(1)  # the first of equal minima: the leftmost
            each = np.arange(len(row))
            least = rank[each, at]
            over = least == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done[row[k]] = ids[k, : left[k]].copy()
                live = ~over
                row, left, ids, rank, at, least = row[live], left[live], ids[live], rank[live], at[live], least[live]
                if not len(row):
                    break
                width = int(left.max())
                ids, rank, columns = ids[:, :width], rank[:, :width], columns[:width]
                each = np.arange(len(row))
            # close the gap: cells behind the merged pair move one to the left
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, 1)
            rank = np.take_along_axis(rank, source, 1)
            ids[each, at] = least
            left = left - 1
            ids[each, left] = -1
            rank[each, left] = NONE
            after = ids[each, np.minimum(at + 1, width - 1)]
            rank[each, at] = np.where(at + 1 < left, self.table.rank(ids[each, at], after), NONE)
            inner = np.flatnonzero(at > 0)
            before = at[inner] - 1
            rank[inner, before] = self.table.rank(ids[inner, before], ids[inner, at[inner]])
        return done

    def _by_heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, with a heap of (rank, place) and linked cells."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or pairs.get((ids[i], ids[j])) != r:
                continue  # one of the two has been merged since
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := pairs.get((ids[h], r))) is not None:
                heapq.heappush(heap, (x, h))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = [self.split(t) for t in texts]
        new = list({p for pieces in split for p in pieces if p not in known})
        step = 1 << 15
        for i in range(0, len(new), step):
            some = new[i : i + step]
            for piece, ids in zip(some, self.encode_pieces([p.encode() for p in some]), strict=True):
                known[piece] = ids.astype("<u4").tobytes()
        return [b"".join([known[p] for p in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    """The codec of a rank file; a worker process reads the file once."""
    if (rank_file, pattern) not in _CODECS:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        _CODECS[rank_file, pattern] = Codec(ranks, pattern)
    return _CODECS[rank_file, pattern]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, and the bytes
    they decode to.

    One row per row of `docs`, repeated ones too; null text is empty and has no ids. Keys may be null or
    repeat. The rank file must be at `rank_file` on every executor (it is a part of the installation).
    Other columns of `docs`, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                ids = own.encode([t or "" for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([own.decode(x) for x in ids], pa.binary()),
                    ],
                    ["key", "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_tokens long, ids binary, decoded binary")
    return out.withColumnRenamed("key", key)
