"""WARC archives: a writer with revisit records, and a reader that goes on behind damaged bytes.

Writing. Pages with equal payloads share one response record, that of the largest key; the others
become revisit records that name it. Each record is a gzip member of its own. Archives are written by
Spark's text writer, so they can be in any store that Spark writes: a row holds a member but its last
byte, and the line separator is that byte. It is the top byte of the member's length field, which is 0
for members of under 16 MB; longer records are split into several members, as gzip allows.

Reading. A record counts only if its member unpacks with the right checksum, its header and length fit
and its digests agree. After a failed check the reader searches for the next gzip member or version line
that opens a valid record, goes on there, and logs the bytes between as a quarantined gap. Of a member that
unpacks only in part or with a wrong checksum, the records that their own digests confirm are kept and the
member is logged as a gap; a member of one whole record is not, as its damage may be in the record's header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm.common import settle, slices

RESPONSE, REVISIT = "response", "revisit"
MEMBER_BYTES = (1 << 24) - 1
#: Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_START = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.\d+\r?\n")
_VERSION = re.compile(rb"WARC/[01]\.\d+\r?\n")
_LENGTH = re.compile(rb"\d{1,18}\Z")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- writing


def record_bytes(key: object, url: str | None, payload: bytes, digest: str, size: int, refers_to: object) -> bytes:
    """One record; a revisit (with `refers_to`) has the HTTP head alone for its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        VERSION.decode(),
        f"WARC-Type: {RESPONSE if refers_to is None else REVISIT}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        f"WARC-Target-URI: {safe}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def gzip_members(record: bytes, most: int = MEMBER_BYTES) -> bytes:
    out = []
    for i in range(0, len(record), most):
        machine = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(machine.compress(record[i : i + most]) + machine.flush())
    return b"".join(out)


def revisit_plan(
    pages: DataFrame, key: str = "page_id", html: str = "html", least_bytes: int = 0
) -> DataFrame:
    """Distinct rows (key, digest, size, refers_to): the response that a page revisits, or null.

    Of pages with equal payloads of at least `least_bytes` bytes the largest key is the response; rows
    that share this key are all responses, and so are pages without any key that is not null.
    """
    narrow = settle(
        pages.select(
            F.col(key).alias("key"),
            F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary")).alias("digest"),
            F.octet_length(F.coalesce(F.col(html), F.lit(""))).cast("long").alias("size"),
        ).distinct()
    )
    winners = narrow.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("key").alias("_response"))
    # the narrow side may be skewed to one digest; AQE splits such a partition of a plain join
    return narrow.join(winners, "digest", "left").select(
        "key",
        "digest",
        "size",
        F.when(~F.col("_response").eqNullSafe(F.col("key")), F.col("_response")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0
) -> None:
    """Write one record per row of `pages` to gzipped archives in `folder`; null html is an empty payload."""
    plan = revisit_plan(pages, key, html, least_bytes)
    rows = pages.select(
        F.col(key).alias("_key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).withColumn("_digest", F.sha1(F.col("html").cast("binary")))
    same = F.col("_key").eqNullSafe(F.col("key")) & (F.col("_digest") == F.col("digest"))
    joined = rows.join(plan, same).select(
        "key", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "digest", "size", "refers_to"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 8 << 20):
                rows = [
                    gzip_members(
                        record_bytes(
                            r["key"],
                            r["url"],
                            (r["html"] or "").encode(),
                            base64.b32encode(bytes.fromhex(r["digest"])).decode(),
                            r["size"],
                            r["refers_to"],
                        )
                    )[:-1]
                    for r in batch.to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["data"])

    members = joined.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value"))
    members.write.option("lineSep", "\x00").text(folder)


# ---- reading


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Damage(Exception):
    """A failed check; `short` if more bytes might mend it. `found` are parts of a damaged member that can be
    kept, and `stop` is where its unpacking ended."""

    def __init__(self, reason: str, short: bool = False, content: bytes = b"", stop: int = 0) -> None:
        super().__init__(reason)
        self.short, self.content, self.stop = short, content, stop
        self.found: list[Record | Gap] = []


def _record_at(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """End, headers and payload of the valid record at `at`."""
    first = _VERSION.match(data, at)
    if not first:
        raise Damage("no version line", short=len(data) - at < 16)
    end = data.find(b"\r\n\r\n", first.end() - 2)
    if end < 0:
        raise Damage("header without end", short=True)
    headers: dict[str, str] = {}
    for line in data[first.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            raise Damage("broken header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "").encode()
    if not _LENGTH.match(length):
        raise Damage("no content length")
    begin, stop = end + 4, end + 4 + int(length)
    if stop + 4 > len(data):
        raise Damage("block beyond the end", short=True)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damage("no end of record where the length says")
    block = data[begin:stop]
    _agrees(headers.get("warc-block-digest"), block, "block digest")
    payload = block
    if "application/http" in headers.get("content-type", ""):
        payload = block.partition(b"\r\n\r\n")[2]
    if headers.get("warc-type") == RESPONSE:
        _agrees(headers.get("warc-payload-digest"), payload, "payload digest")
    return stop + 4, headers, payload


def _agrees(digest: str | None, data: bytes, what: str) -> None:
    if digest and digest.startswith("sha1:") and digest[5:] != sha1_base32(data):
        raise Damage(f"wrong {what}")


def _member_at(data: bytes, at: int, step: int = 1 << 16) -> tuple[int, bytes]:
    """End and content of the gzip member at `at`; it is fed in steps, so that no tail is copied. The Damage of a
    broken member has what could be unpacked."""
    machine, view, content, begin = zlib.decompressobj(wbits=31), memoryview(data), [], at
    try:
        while not machine.eof and at < len(data):
            content.append(machine.decompress(view[at : at + step]))
            at = min(at + step, len(data))
    except zlib.error as e:
        stop, content = _before_error(view, begin, at, step)
        if "incorrect data check" in str(e):  # the length field follows
            stop = min(stop + 4, len(data))
        raise Damage(f"gzip: {e}", content=content, stop=stop) from e
    if not machine.eof:
        raise Damage("gzip: member without end", content=b"".join(content), stop=at)
    return at - len(machine.unused_data), b"".join(content)


def _before_error(view: memoryview, begin: int, good: int, step: int) -> tuple[int, bytes]:
    """Where unpacking the member at `begin` fails and what comes before: the step that failed, from `good`
    on, is fed again byte by byte, as the library keeps back a failed step's output."""
    machine, content = zlib.decompressobj(wbits=31), []
    for i in range(begin, good, step):
        content.append(machine.decompress(view[i : i + step]))
    at = good
    try:
        while at < min(good + step, len(view)):
            content.append(machine.decompress(view[at : at + 1]))
            at += 1
    except zlib.error:
        at += 1
    return at, b"".join(content)


def _own_digest(record: Record) -> bool:
    h = record.headers
    return h.get("warc-block-digest", "").startswith("sha1:") or (
        h.get("warc-type") == RESPONSE and h.get("warc-payload-digest", "").startswith("sha1:")
    )


def _inside(parts: Iterator[Record | Gap], at: int, length: int, inner: int = 0) -> list[Record | Gap]:
    """Parts of a member's content (from `inner` on) as parts of the file."""
    return [
        Gap(at, length, f"in member at {inner + part.offset}, {part.length} bytes: {part.reason}")
        if isinstance(part, Gap)
        else Record(at, length, part.headers, part.payload)
        for part in parts
    ]


def _kept_of(damage: Damage, at: int) -> list[Record | Gap]:
    """What a damaged member at `at` still gives: records confirmed by their digests, its gaps, and a gap that
    tells the damage; nothing if there is no such record or the member is one whole record."""
    if VERSION[:5] not in damage.content:
        return []
    parts = list(salvage(damage.content))
    if len(parts) == 1:
        return []
    kept = [
        Gap(x.offset, x.length, "no digest to check") if isinstance(x, Record) and not _own_digest(x) else x for x in parts
    ]
    if not any(isinstance(x, Record) for x in kept):
        return []
    length = damage.stop - at
    return [*_inside(kept, at, length), Gap(at, length, f"{damage}; records kept by their digests")]


def _unit_at(data: bytes, at: int) -> tuple[int, list[Record | Gap]]:
    """The valid record at `at`, or the records of the gzip members there; raises Damage."""
    if data[at : at + 3] != MAGIC:
        end, headers, payload = _record_at(data, at)
        return end, [Record(at, end - at, headers, payload)]
    try:
        end, content = _member_at(data, at)
    except Damage as damage:
        damage.found = _kept_of(damage, at)
        raise
    while True:
        found, inner = [], 0
        try:
            while inner < len(content):
                inner, headers, payload = _record_at(content, inner)
                found.append(Record(at, end - at, headers, payload))
            return end, found
        except Damage as damage:
            if damage.short and data[end : end + 3] == MAGIC:  # a record may go on in the next member
                try:
                    end, more = _member_at(data, end)
                except Damage:
                    more = b""
                if more and not _VERSION.match(more):
                    content += more
                    continue
            # keep whole records before the damage, and salvage what is behind it
            found += _inside(salvage(content[inner:]), at, end - at, inner)
            if not any(isinstance(part, Record) for part in found):
                raise
            return end, found


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Valid records of an archive in order, and the gaps of bytes that belong to none."""
    at, size = 0, len(data)
    gap, reason = None, ""  # where an open gap begins
    while at < size:
        if gap is None and data[at : at + 2] == b"\r\n":  # more empty lines than the format asks for
            at += 2
            continue
        stop = None
        try:
            end, found = _unit_at(data, at)
        except Damage as damage:
            found, stop, why = damage.found, damage.stop, str(damage)
        if stop is None or found:
            if gap is not None and gap < at:
                yield Gap(gap, at - gap, reason)
            gap = None
            yield from found
        if stop is None:
            at = end
            continue
        if found:  # members that begin inside the damaged one may be whole; its plain records are found already
            gap, reason = stop, why
        elif gap is None:
            gap, reason = at, why
        inner = data.find(MAGIC, at + 1, gap) if at < gap else -1
        if inner >= 0:
            at = inner
            continue
        start = _START.search(data, max(at + 1, gap))
        at = start.start() if start else size
    if gap is not None and gap < size:
        yield Gap(gap, size - gap, reason)


RECORD_DDL = (
    "path string, offset long, length long, gap string, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all files in a folder; `gap` has the reason for a gap and is null for records.

    `payload_bytes` and `payload_digest` are those of the payload as read; a revisit, which has none,
    states them in its header. A file is read by one task as a whole, which Spark limits to 2 GB; an
    empty file has neither records nor gaps. `payloads=False` leaves the payload column null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD_DDL.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                rows, held = [], 0
                for x in salvage(content.as_py()):
                    if isinstance(x, Gap):
                        rows.append((path.as_py(), x.offset, x.length, x.reason, *[None] * 7))
                    else:
                        rows.append((path.as_py(), x.offset, x.length, None, *_fields(x, payloads)))
                        held += len(x.payload) if payloads else 100
                    if held > 8 << 20:
                        yield _batch(rows, names, kinds)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(folder)
    return files.select("path", "content").mapInArrow(run, RECORD_DDL)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
    )


def _fields(record: Record, payloads: bool) -> tuple:
    h = record.headers
    kind = h.get("warc-type")
    if kind == REVISIT:
        size = h.get("x-payload-length", "")
        size, digest = int(size) if size.isdigit() else None, h.get("warc-payload-digest", "").removeprefix("sha1:")
    else:
        size, digest = len(record.payload), sha1_base32(record.payload)
    bare = lambda name: h[name].strip("<>").removeprefix("urn:page:") if name in h else None
    return (
        kind,
        bare("warc-record-id"),
        h.get("warc-target-uri"),
        bare("warc-refers-to"),
        size,
        digest,
        record.payload if payloads and kind != REVISIT else None,
    )
