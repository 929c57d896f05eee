"""Removal of long repeated byte strings, by bucket-pointer refinement.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller key.
All strings of that length in the corpus would have to be sorted to see it; the work is cut down, with
nothing lost, in four steps. Documents travel in chunks of some megabytes, one row each.

1. Buckets. Every string of `length` bytes is filed under one of its q-grams: the leftmost one with the
   least hash. These q-grams, one in some sixteen bytes, are the initial buckets. Chunks send the
   numbers of their buckets (each once) to where buckets are counted, and hear back which of them
   another document has too. Strings in any other bucket are unique.
2. Contexts. Chunks send the strings of the shared buckets, as the stretch of text that holds them, to
   where their bucket is refined. Equal stretches of a chunk are sent once, for the smallest key; the
   rest is settled at home. Buckets that very many documents share are sent string by string, by the
   string's own hash, so that no bucket meets in one task.
3. Refinement. Every place has a bucket pointer, at first that of its q-gram. A pass sorts places by
   their pointer and the pointer at the offset where that one's bytes end, and updates all pointers,
   which then stand for twice the bytes; the next pass looks up the updated ones, so that a few passes
   cover the whole string. Buckets of a single document drop out on the way. Strings that share the last
   bucket are equal, and all but those of the smallest key are repeats.
4. Removal. Chunks receive their repeats' places, join them to runs and cut them out.

q-grams are identified by 64-bit hashes, strings by the buckets of the q-grams that cover them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.common import give_back, mix, parts_for, settle, slices, text_bytes
from paperloom.llm.shingles import _BYTE, _powers
from paperloom.session import drop_cut

Q = 20
CHUNK_BYTES = 8 << 20
SEGMENT = 1 << 18
#: Buckets that a counting task holds, and bytes of text that a refining task holds, at a time.
BUCKETS_EACH = 1 << 19
CONTEXT_BYTES_EACH = 2 << 20
#: Buckets with more occurrences are dealt out string by string.
HOT = 4096
NUMBER_BYTES = 5
LAST_KEY = np.iinfo(np.int64).max


def _pack(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(a.tobytes() for a in arrays), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    sizes = [n * np.dtype(k).itemsize for k in kinds]
    raw = pa.decompress(data, sum(sizes), codec="zstd", asbytes=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(raw[a:b], k) for a, b, k in zip(at[:-1], at[1:], kinds, strict=True)]


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Best of every `width` neighbours."""
    have = 1
    out = values
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out


class Bytes:
    """Hashes of any stretch of a piece of text."""

    def __init__(self, flat: np.ndarray) -> None:
        up, self.down = _powers(len(flat) + 1)
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(_BYTE[flat] * up[: len(flat)], out=self.sums[1:])

    def grams(self, q: int) -> np.ndarray:
        return mix((self.sums[q:] - self.sums[:-q]) * self.down[: len(self.sums) - q])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start])


def filed(
    flat: np.ndarray, offsets: np.ndarray, length: int
) -> Iterator[tuple[int, Bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Per segment of a chunk: its first byte, its hashes, and per bucket the q-gram's hash and the first
    and last of the strings (places in the chunk) filed under it."""
    width = length - Q + 1
    ends = offsets[1:]
    for begin in range(0, max(0, len(flat) - length + 1), SEGMENT):
        piece = flat[begin : begin + SEGMENT + length - 1]
        hashes = Bytes(piece)
        grams = hashes.grams(Q)
        least = _sliding(grams, width, np.minimum)  # per string of the segment
        n = len(least)
        # a q-gram is a bucket if it is the least of some string that holds it
        padded = np.zeros(n + 2 * (width - 1), np.uint64)
        padded[width - 1 : width - 1 + n] = least
        place = np.flatnonzero(grams == _sliding(padded, width, np.maximum))
        value = grams[place]
        # strings lose it to an earlier one that is not larger or a later one that is smaller
        first, last = place - (width - 1), place.copy()
        before, after = np.arange(len(place)) - 1, np.arange(len(place)) + 1
        todo = np.flatnonzero(before >= 0)
        while len(todo):
            near = place[before[todo]] >= place[todo] - (width - 1)
            todo = todo[near]
            beaten = value[before[todo]] <= value[todo]
            stop = todo[beaten]
            first[stop] = place[before[stop]] + 1
            todo = todo[~beaten]
            before[todo] -= 1
            todo = todo[before[todo] >= 0]
        todo = np.flatnonzero(after < len(place))
        while len(todo):
            near = place[after[todo]] <= place[todo] + (width - 1)
            todo = todo[near]
            beaten = value[after[todo]] < value[todo]
            stop = todo[beaten]
            last[stop] = place[after[stop]] - width
            todo = todo[~beaten]
            after[todo] += 1
            todo = todo[after[todo] < len(place)]
        # strings begin in the segment and end in the q-gram's own document
        place += begin
        doc = np.searchsorted(ends, place, "right")
        first = np.maximum(np.maximum(first + begin, offsets[doc]), begin)
        last = np.minimum(np.minimum(last + begin, ends[doc] - length), begin + n - 1)
        some = first <= last
        yield begin, hashes, value[some], first[some], last[some]


def _numbers(value: np.ndarray, buckets: int) -> np.ndarray:
    """Task of a bucket (high bits) and its number there (NUMBER_BYTES bytes) in one integer."""
    number = (value // np.uint64(buckets)) & np.uint64((1 << 8 * NUMBER_BYTES) - 1)
    return ((value % np.uint64(buckets)) << np.uint64(8 * NUMBER_BYTES)) | number


def _short(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NUMBER_BYTES].tobytes()


def _long(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // NUMBER_BYTES, 8), np.uint8)
    wide[:, :NUMBER_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, NUMBER_BYTES)
    return wide.view("<u8").ravel()


def text_chunks(docs: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
    """Chunks of documents: chunk, keys, sizes (bytes), all bytes (zstd), other columns (Arrow IPC)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            nonlocal number, held, size
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            flat, offsets = text_bytes(rows.column("_text"))
            sink = pa.BufferOutputStream()
            rest = rows.select([c for c in rows.schema.names if c not in ("_text", "_key")])
            with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rest)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    one(rows.column("_key")),
                    one(pa.array(np.diff(offsets))),
                    pa.array([len(flat)], pa.int64()),
                    pa.array([_pack(flat)], pa.binary()),
                    pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                ],
                ["chunk", "keys", "sizes", "n_bytes", "data", "rest"],
            )
            number, held, size = number + 1, [], 0
            return row

        for whole in batches:
            give_back()
            for batch in slices(whole, "_text", CHUNK_BYTES // 4):
                held.append(batch)
                size += len(text_bytes(batch.column("_text"))[0])
                if size >= CHUNK_BYTES:
                    yield chunk()
        if held:
            yield chunk()

    rows = docs.select(
        F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"), *[F.col(c).alias(f"c_{c}") for c in carry]
    )
    return rows.mapInArrow(
        run, "chunk long, keys array<long>, sizes array<long>, n_bytes long, data binary, rest binary"
    )


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and ranks (null last) of a chunk row."""
    (flat,) = _unpack(row["data"].as_py(), row["n_bytes"].as_py(), "u1")
    offsets = np.concatenate([[0], np.cumsum(row["sizes"].values.to_numpy())]).astype(np.int64)
    return flat, offsets, row["keys"].values.fill_null(LAST_KEY).to_numpy()


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for i in range(table.num_rows):
        yield {name: table.column(name)[i] for name in table.schema.names}


def shared_buckets(chunks: DataFrame, length: int, buckets: int, hot: int) -> DataFrame:
    """Rows (chunk, task, numbers, hot): the buckets of a chunk that two documents share."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                flat, offsets, ranks = _opened(row)
                values, ids = [], []
                for _, _, value, first, _ in filed(flat, offsets, length):
                    values.append(_numbers(value, buckets))
                    ids.append(ranks[np.searchsorted(offsets, first, "right") - 1])
                if not values:
                    continue
                number, rank = np.concatenate(values), np.concatenate(ids)
                order = np.argsort(number, kind="stable")
                number, rank = number[order], rank[order]
                head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
                if not len(number):
                    continue
                several = np.minimum.reduceat(rank, head) != np.maximum.reduceat(rank, head)
                times = np.minimum(np.diff(np.append(head, len(number))), 0x7FFF).astype("<u2")
                times |= several.astype("<u2") << np.uint16(15)
                number = number[head]
                task = (number >> np.uint64(8 * NUMBER_BYTES)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
                ends = np.append(cut[1:], len(task))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(task[cut]),
                        pa.array(np.full(len(cut), row["chunk"].as_py())),
                        pa.array([_short(number[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()),
                        pa.array([times[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                    ],
                    ["task", "chunk", "numbers", "times"],
                )

    def count(table: pa.Table) -> pa.Table:
        give_back()
        lists = [_long(x.as_py()) for x in table.column("numbers")]
        number = np.concatenate(lists)
        times = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in table.column("times")])
        source = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(number, kind="stable")
        number, times, source = number[order], times[order], source[order]
        head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        sizes = np.diff(np.append(head, len(number)))
        shared = (sizes > 1) | (np.bitwise_or.reduceat(times, head) >> 15 > 0)
        frequent = np.add.reduceat((times & 0x7FFF).astype(np.int64), head) > hot
        keep = np.repeat(shared, sizes)
        number, source, frequent = number[keep], source[keep], np.repeat(frequent, sizes)[keep]
        order = np.argsort(source, kind="stable")
        number, source, frequent = number[order], source[order], frequent[order]
        cut = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])) if len(source) else source
        ends = np.append(cut[1:], len(source))
        spans = list(zip(cut.tolist(), ends.tolist(), strict=True)) if len(cut) else []
        return pa.table(
            {
                "chunk": table.column("chunk").combine_chunks().take(pa.array(source[cut], pa.int64())),
                "task": pa.array([table.column("task")[0].as_py()] * len(spans), pa.int64()),
                "n": pa.array([b - a for a, b in spans], pa.int64()),
                "numbers": pa.array([_short(number[a:b]) for a, b in spans], pa.binary()),
                "hot": pa.array([np.packbits(frequent[a:b]).tobytes() for a, b in spans], pa.binary()),
            }
        )

    sent = chunks.select("chunk", "keys", "sizes", "n_bytes", "data").mapInArrow(
        send, "task long, chunk long, numbers binary, times binary"
    )
    return sent.groupBy("task").applyInArrow(count, "chunk long, task long, n long, numbers binary, hot binary")


def _flagged(shared: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers (task included) of a chunk's shared buckets, and which are hot."""
    numbers, hot = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for row in _rows(shared):
        low = _long(row["numbers"].as_py())
        numbers.append(low | np.uint64(row["task"].as_py() << (8 * NUMBER_BYTES)))
        hot.append(np.unpackbits(np.frombuffer(row["hot"].as_py(), np.uint8), count=len(low)).astype(bool))
    number, frequent = np.concatenate(numbers), np.concatenate(hot)
    order = np.argsort(number)
    return number[order], frequent[order]


def _runs(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of stretches [start, end) per row, as maximal runs in order."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    reach = end.copy()
    base = row.astype(np.int64) << 40  # running maximum within a row
    reach = np.maximum.accumulate(reach + base) - base
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > reach[:-1])])
    head = np.flatnonzero(fresh)
    return row[head], start[head], reach[np.append(head[1:], len(row)) - 1]


def contexts(chunks: DataFrame, shared: DataFrame, length: int, buckets: int, tasks: int) -> DataFrame:
    """Rows (task, chunk, n, meta, data): stretches of text to refine, or (data null) repeats found here."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        out: dict[str, list] = {"task": [], "chunk": [], "n": [], "meta": [], "data": []}
        for row in _rows(left):
            flat, offsets, ranks = _opened(row)
            number, hot = _flagged(right)
            starts, sizes, marks, targets = [], [], [], []
            for begin, hashes, value, first, last in filed(flat, offsets, length) if len(number) else ():
                own = _numbers(value, buckets)
                at = np.minimum(np.searchsorted(number, own), len(number) - 1)
                hit = number[at] == own
                value, first, last, often = value[hit], first[hit], last[hit], hot[at[hit]]
                # hot buckets: every string on its own, dealt by its own hash
                many = (last - first + 1)[often]
                single = np.repeat(first[often] - np.cumsum(many) + many, many) + np.arange(many.sum())
                start = np.concatenate([first[~often], single])
                size = np.concatenate([(last - first)[~often] + length, np.full(len(single), length)])
                mark = mix(hashes.at(start - begin, size) + size.astype(np.uint64))
                target = value[~often]
                starts.append(start)
                sizes.append(size)
                marks.append(mark)
                targets.append(np.concatenate([target, mark[len(target) :]]))
            if not starts:
                continue
            start, size = np.concatenate(starts), np.concatenate(sizes)
            mark, target = np.concatenate(marks), np.concatenate(targets)
            doc = np.searchsorted(offsets, start, "right") - 1
            order = np.lexsort((ranks[doc], mark))
            start, size, mark, target, doc = start[order], size[order], mark[order], target[order], doc[order]
            if not len(start):
                continue
            head = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
            least = np.repeat(ranks[doc][head], np.diff(np.append(head, len(mark))))
            home = ranks[doc] != least
            runs = _runs(doc[home], start[home] - offsets[doc[home]], start[home] + size[home] - offsets[doc[home]])
            ship = ~home
            start, size, doc, task = start[ship], size[ship], doc[ship], mix(target[ship]) % np.uint64(tasks)
            order = np.lexsort((start, task))
            start, size, doc, task = start[order], size[order], doc[order], task[order].astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])) if len(task) else task
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(task)).tolist(), strict=True) if len(cut) else ():
                n, d = size[a:b], doc[a:b]
                ends = np.cumsum(n)
                places = np.arange(ends[-1]) + np.repeat(start[a:b] - (ends - n), n)
                out["task"].append(int(task[a]))
                out["chunk"].append(row["chunk"].as_py())
                out["n"].append(b - a)
                out["meta"].append(
                    _pack(
                        d.astype("<u4"),
                        ranks[d].astype("<i8"),
                        (start[a:b] - offsets[d]).astype("<u4"),
                        n.astype("<u2"),
                    )
                )
                out["data"].append(_pack(flat[places]))
            if len(runs[0]):
                out["task"].append(row["chunk"].as_py() % tasks)
                out["chunk"].append(row["chunk"].as_py())
                out["n"].append(len(runs[0]))
                out["meta"].append(_pack(*[r.astype("<u4") for r in runs]))
                out["data"].append(None)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    texts = chunks.select("chunk", "keys", "sizes", "n_bytes", "data").groupBy("chunk")
    return texts.cogroup(shared.groupBy("chunk")).applyInArrow(
        run, "task long, chunk long, n long, meta binary, data binary"
    )


def _buckets(keys: np.ndarray) -> np.ndarray:
    """Bucket pointer of each key: the place in sorted order where the run of equal keys begins."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
    pointers = np.empty(len(keys), np.int64)
    pointers[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
    return pointers


def _grams_at(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at each place (ascending)."""
    out = np.empty(len(place), np.uint64)
    for begin in range(0, len(text), SEGMENT):
        a, b = np.searchsorted(place, (begin, begin + SEGMENT))
        if a < b:
            out[a:b] = Bytes(text[begin : begin + SEGMENT + Q]).at(place[a:b] - begin, Q)
    return out


def _widths(length: int) -> list[int]:
    """Bytes that a bucket pointer stands for after each pass: doubled until the whole string is covered."""
    widths = [Q]
    while widths[-1] < length:
        widths.append(min(2 * widths[-1], length))
    return widths


def refine(text: np.ndarray, start: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings at `start` (ascending) also occur with a smaller rank.

    Each place that a string needs has a bucket pointer, at first that of its q-gram. A pass sorts places by
    their own pointer and the pointer found one refined width further on, and gives all of them their new
    pointers at once: these stand for the wider string, and the next pass looks them up wherever they are.
    Strings alone with their rank in their bucket drop out before each pass, and with them the places they need.
    """
    widths = _widths(length)
    steps = np.diff(widths)
    left, pointer, slot = np.arange(len(start)), np.zeros(0, np.int64), np.full(len(text) + 1, -1)
    for done in range(len(widths)):
        # the places that the strings still look up: their starts, moved by the steps of the passes to come
        need = np.zeros(len(text) + 1, bool)
        need[start[left]] = True
        for step in steps[done:][::-1]:
            need[step:] |= need[:-step].copy()
        place = np.flatnonzero(need)
        if done:
            further = pointer[slot[place + steps[done - 1]]]
            pointer = _buckets(pointer[slot[place]] * np.int64(len(pointer)) + further)
        else:
            pointer = _buckets(_grams_at(text, place))
        slot[place] = np.arange(len(place))
        own, r = pointer[slot[start[left]]], rank[left]
        least = np.full(len(pointer), LAST_KEY)
        most = np.full(len(pointer), np.iinfo(np.int64).min)
        np.minimum.at(least, own, r)
        np.maximum.at(most, own, r)
        keep = least[own] != most[own] if done < len(steps) else r != least[own]
        left = left[keep]
    out = np.zeros(len(start), bool)
    out[left] = True
    return out


def repeats(sent: DataFrame, length: int) -> DataFrame:
    """Rows (chunk, n, runs): repeated stretches of a chunk's documents."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        out: dict[str, list] = {"chunk": [], "n": [], "runs": []}
        chunk, doc, rank, place, size, data = [], [], [], [], [], []
        for row in _rows(table):
            n = row["n"].as_py()
            if row["data"].as_py() is None:
                for name in ("chunk", "n"):
                    out[name].append(row[name].as_py())
                out["runs"].append(row["meta"].as_py())
                continue
            d, r, p, s = _unpack(row["meta"].as_py(), n, "<u4", "<i8", "<u4", "<u2")
            chunk.append(np.full(n, row["chunk"].as_py()))
            doc.append(d.astype(np.int64))
            rank.append(r)
            place.append(p.astype(np.int64))
            size.append(s.astype(np.int64))
            data.append(_unpack(row["data"].as_py(), int(s.sum(dtype=np.int64)), "u1")[0])
        if chunk:
            chunk, doc, rank, place, size = map(np.concatenate, (chunk, doc, rank, place, size))
            many = size - length + 1  # strings of each stretch
            begin = np.cumsum(size) - size
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found = refine(np.concatenate(data), np.repeat(begin, many) + inside, np.repeat(rank, many), length)
            owner = np.repeat(np.arange(len(size)), many)[found]
            start = place[owner] + inside[found]
            numbers, number = np.unique(chunk[owner], return_inverse=True)
            for i, c in enumerate(numbers.tolist()):
                own = number == i
                runs = _runs(doc[owner[own]], start[own], start[own] + length)
                out["chunk"].append(c)
                out["n"].append(len(runs[0]))
                out["runs"].append(_pack(*[x.astype("<u4") for x in runs]))
        kinds = [pa.int64(), pa.int64(), pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return sent.groupBy("task").applyInArrow(run, "chunk long, n long, runs binary")


def _whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the characters that they cut in two."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, chars: bool = False, hot: int = HOT
) -> DataFrame:
    """One row per row of `docs`: key, n_bytes, n_removed, spans (removed runs, byte places) and kept
    (the remaining bytes).

    Keys are integers; a null key ranks after all others. Rows of one key do not repeat each other, so
    repeated rows lose the same bytes. Null text is empty; texts under `length` bytes lose nothing.
    With `chars` a character stays whole where only a part of it would go, and `kept` is text. An
    empty table gives no rows. Other columns of `docs`, whatever their names, are not read.
    """
    return _cut(docs, key, text, length, [key], chars, hot).select("carried.*", "n_bytes", "n_removed", "spans", "kept")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """The rows and columns of `docs`, texts without their repeats (see `remove_repeats`, with `chars`)."""
    others = [c for c in docs.columns if c != text]
    cut = _cut(docs, key, text, length, others, True, HOT)
    return cut.select(*[F.col("kept").alias(text) if c == text else F.col(f"carried.`{c}`") for c in docs.columns])


def _cut(
    docs: DataFrame, key: str, text: str, length: int, carry: list[str], chars: bool, hot: int
) -> DataFrame:
    """Rows (carried, n_bytes, n_removed, spans, kept); `carried` has the columns `carry`."""
    if length < Q + Q // 2 or length > 1000:
        raise ValueError(f"length must be from {Q + Q // 2} to 1000")
    chunks = settle(text_chunks(docs, key, text, carry))
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    density = 2 / (length - Q + 2)
    buckets = min(1 << 23, parts_for(int(size * density), BUCKETS_EACH, 8))
    shared = settle(shared_buckets(chunks, length, buckets, hot))
    found = shared.agg(F.sum("n")).first()[0] or 0
    tasks = parts_for(found * (length + (length - Q) // 2), CONTEXT_BYTES_EACH, 8)
    runs = settle(repeats(contexts(chunks, shared, length, buckets, tasks), length))
    drop_cut(shared)
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*carry).schema}

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        tables = []
        for row in _rows(left):
            flat, offsets, _ = _opened(row)
            rest = pa.ipc.open_stream(row["rest"].as_py()).read_all()
            parts = [_unpack(r["runs"].as_py(), r["n"].as_py(), "<u4", "<u4", "<u4") for r in _rows(right)]
            doc, start, end = _runs(
                *[np.concatenate([p[i].astype(np.int64) for p in parts] or [np.zeros(0, np.int64)]) for i in range(3)]
            )
            whole = flat.tobytes()
            cut = np.searchsorted(doc, np.arange(len(offsets)))
            spans, removed, kept = [], [], []
            for i in range(len(offsets) - 1):
                own = list(zip(start[cut[i] : cut[i + 1]].tolist(), end[cut[i] : cut[i + 1]].tolist(), strict=True))
                body = whole[offsets[i] : offsets[i + 1]]
                if own and chars:
                    own = _whole_characters(body, own)
                spans.append([{"start": a, "end": b} for a, b in own])
                removed.append(sum(b - a for a, b in own))
                edges = [0, *[x for span in own for x in span], len(body)]
                kept.append(b"".join([body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if own else body)
            if chars:
                kept = [k.decode() for k in kept]
            tables.append(
                pa.table(
                    {
                        "carried": pa.StructArray.from_arrays(
                            [rest.column(f"c_{c}").combine_chunks() for c in carry], carry
                        ),
                        "n_bytes": pa.array(np.diff(offsets)),
                        "n_removed": pa.array(removed, pa.int64()),
                        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        "kept": pa.array(kept, pa.string() if chars else pa.binary()),
                    }
                )
            )
        return pa.concat_tables(tables)

    columns = ", ".join(f"`{c}`: {k}" for c, k in kinds.items())
    return (
        chunks.groupBy("chunk")
        .cogroup(runs.groupBy("chunk"))
        .applyInArrow(
            remove,
            f"carried struct<{columns}>, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, "
            f"kept {'string' if chars else 'binary'}",
        )
    )
