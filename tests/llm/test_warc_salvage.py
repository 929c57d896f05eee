import gzip
import os
import random

import pytest

from paperloom.llm import warc_salvage as W
from paperloom.llm.warc_salvage import Gap, Record, gzip_members, read_archives, record_bytes, salvage, write_archives

SCHEMA = "page_id long, url string, html string, digest string, size string, payload string, path string"


def member(i, payload=b"<p>hello</p>", refers_to=None):
    raw = record_bytes(i, f"http://a/{i}", payload, W.sha1_base32(payload), len(payload), refers_to)
    return raw, gzip_members(raw)


def ids(parts):
    return [int(p.headers["warc-record-id"][10:-1]) for p in parts if isinstance(p, Record)]


def gaps(parts):
    return [(p.offset, p.length) for p in parts if isinstance(p, Gap)]


@pytest.mark.parametrize("packed", [False, True])
def test_whole_archive(packed):
    data = b"".join(member(i)[packed] for i in range(5))
    parts = list(salvage(data))
    assert ids(parts) == list(range(5)) and not gaps(parts)


@pytest.mark.parametrize("packed", [False, True])
def test_damage_costs_one_record(packed):
    units = [member(i, os.urandom(200) + b"x" * i)[packed] for i in range(6)]
    begin = len(units[0]) + len(units[1])
    broken = bytearray(units[2])
    broken[-100] ^= 0xFF  # in the payload: a plain header has no checksum
    parts = list(salvage(b"".join(units[:2]) + bytes(broken) + b"".join(units[3:])))
    assert ids(parts) == [0, 1, 3, 4, 5]
    assert gaps(parts) == [(begin, len(broken))]


@pytest.mark.parametrize("packed", [False, True])
def test_cut_end_and_garbage(packed):
    units = [member(i)[packed] for i in range(3)]
    parts = list(salvage(b"garbage" + units[0] + b"\x1f\x8b\x08nonsense" + units[1] + units[2][:-9]))
    assert ids(parts) == [0, 1]
    assert gaps(parts)[0] == (0, 7) and len(gaps(parts)) == 3
    assert sum(n for _, n in gaps(parts)) == 7 + 11 + len(units[2]) - 9


def test_every_single_byte_flip_keeps_the_others():
    units = [member(i, f"page {i}".encode() * 5)[1] for i in range(3)]
    rng = random.Random(5)
    for at in rng.sample(range(len(units[1])), 80):
        broken = bytearray(units[1])
        broken[at] ^= 1 << rng.randrange(8)
        parts = list(salvage(units[0] + bytes(broken) + units[2]))
        assert {0, 2} <= set(ids(parts))
        if ids(parts) == [0, 2]:
            assert gaps(parts) == [(len(units[0]), len(broken))]


def test_payload_that_looks_like_a_record():
    inner = member(77)[0]
    raw, _ = member(1, b"WARC/1.0\r\n" + inner + b"\x1f\x8b\x08")
    assert ids(salvage(raw + member(2)[0])) == [1, 2]


def test_one_gzip_stream_and_mixed_forms():
    data = gzip.compress(b"".join(member(i)[0] for i in range(3))) + member(3)[0] + member(4)[1]
    assert ids(salvage(data)) == [0, 1, 2, 3, 4]


def test_record_over_several_members():
    raw, _ = member(9, os.urandom(5000))
    data = gzip_members(raw, 700) + member(10)[1]
    assert ids(salvage(data)) == [9, 10] and not gaps(salvage(data))


def test_damage_inside_a_member():
    a, b, c = (bytearray(member(i)[0]) for i in range(3))
    b[-20] ^= 1
    parts = list(salvage(gzip.compress(bytes(a + b + c))))
    assert ids(parts) == [0, 2] and len(gaps(parts)) == 1


def test_damage_to_the_first_record_of_a_member():
    a, b, c = (bytearray(member(i)[0]) for i in range(3))
    a[-20] ^= 1
    parts = list(salvage(gzip.compress(bytes(a + b + c)) + member(3)[1]))
    assert ids(parts) == [1, 2, 3] and len(gaps(parts)) == 1


def test_one_stream_with_a_wrong_checksum():
    raw = [member(i, f"page {i}".encode() * 9)[0] for i in range(4)]
    data = bytearray(gzip.compress(b"".join(raw), 0))  # stored: one flipped byte stays one
    data[data.index(b"page 2page 2") + 3] ^= 1
    parts = list(salvage(bytes(data) + member(4)[1]))
    assert ids(parts) == [0, 1, 3, 4] and len(gaps(parts)) == 2


@pytest.mark.parametrize("cut", [True, False])
def test_one_stream_that_breaks_off(cut):
    whole = gzip.compress(b"".join(member(i, random.Random(i).randbytes(3000))[0] for i in range(8)))
    half = whole[: len(whole) // 2]
    parts = list(salvage(half if cut else half + member(9)[1]))
    assert ids(parts)[:3] == [0, 1, 2] and (cut or ids(parts)[-1] == 9)
    assert gaps(parts)


def test_empty_member_behind_damage():
    data = b"garbage" + gzip.compress(b"") + member(1)[1] + member(2)[0]
    parts = list(salvage(data))
    assert ids(parts) == [1, 2] and gaps(parts) == [(0, 7)]


def test_empty():
    assert list(salvage(b"")) == []


def rows_of(spark, rows, folder, **more):
    write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, **more)
    return read_archives(spark, folder).collect()


def test_round_trip(spark, tmp_path):
    texts = [None, "", "a", "é" * 1000, "same", "same", "WARC/1.0\r\n\x1f\x8b", "x" * 300_000]
    rows = [(i, f"http://h/{i}\r\nX: y" if i else None, t, "", "", "", "") for i, t in enumerate(texts)]
    rows.append((4, "http://h/4", "same", "", "", "", ""))
    rows.append((None, "http://n", "alone", "", "", "", ""))
    rows.append((None, "http://n", "same", "", "", "", ""))
    got = rows_of(spark, rows, str(tmp_path / "a"))
    assert len(got) == len(rows) and all(r["gap"] is None for r in got)
    best = {}
    for i, _, t, *_ in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    for r in got:
        if r["record_id"]:
            payload = texts[int(r["record_id"])] or ""
            largest = best[payload] == int(r["record_id"])
            assert r["record_type"] == ("response" if largest else "revisit")
            assert r["refers_to"] == (None if largest else str(best[payload]))
            assert r["payload_bytes"] == len(payload.encode()) and r["payload_digest"] == W.sha1_base32(payload.encode())
            assert r["payload"] == (payload.encode() if largest else None)
    nulls = sorted((r["record_type"], r["refers_to"]) for r in got if not r["record_id"])
    assert nulls == [("response", None), ("revisit", "5")]


def test_small_payloads_stay_responses(spark, tmp_path):
    rows = [(i, "u", "ab", "", "", "", "") for i in range(4)]
    got = rows_of(spark, rows, str(tmp_path / "b"), least_bytes=3)
    assert [r["record_type"] for r in got] == ["response"] * 4


def test_empty_table(spark, tmp_path):
    assert rows_of(spark, [], str(tmp_path / "c")) == []


def test_large_record_keeps_the_separator_byte():
    data = gzip_members(b"\x00" * (1 << 24) + os.urandom(10))
    assert data[-1] == 0 and len(gzip.decompress(data)) == (1 << 24) + 10
