from hashlib import sha256

import pytest

from paperloom.llm import chat
from paperloom.llm.chat import rotate_perspectives

SCHEMA = "conv_id long, turn long, role string, text string, piece string, start string, perspective string, seq string"


def brute_force(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = [(t, r if r is not None else "unknown", (x or "").replace("<|", "< |")) for c, t, r, x, *_ in rows if c == conv]
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        for view in {r for _, r, _ in turns if r != "system"}:
            at = 0
            for seq, (turn, speaker, content) in enumerate(turns):
                role = "assistant" if speaker == view else "system" if speaker == "system" else "user"
                plain = "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in speaker)
                unlike = plain != speaker or not speaker
                name = (plain + ("_" + sha256(speaker.encode()).hexdigest()[:8] if unlike else "")) if role == "user" else None
                head = f"<|im_start|>{role}" + (f" name={name}" if name else "") + "\n"
                piece = head + content + "<|im_end|>\n"
                mask = (at + len(head), at + len(piece) - 1) if role == "assistant" else (None, None)
                out.append((conv, view, seq, turn, speaker, role, name, piece, at, *mask))
                at += len(piece)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(4)
    got = [tuple(r) for r in rotate_perspectives(df).collect()]
    assert sorted(got, key=str) == sorted(brute_force(rows), key=str)
    return got


def test_three_speakers(spark):
    got = check(spark, [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob b.", "yo"), (1, 3, "ann", "é\n?"), (1, 4, "cy", "")])
    dialogue = "".join(r[7] for r in sorted(r for r in got if r[1] == "ann"))
    masked = [dialogue[r[9] : r[10]] for r in sorted(got) if r[1] == "ann" and r[9] is not None]
    assert masked == ["hi<|im_end|>", "é\n?<|im_end|>"]


def test_speakers_of_like_names_stay_apart(spark):
    got = check(spark, [(1, i, s, "x") for i, s in enumerate(["a b", "a_b", "a.b", "", "é", "ann"])])
    names = {r[4]: r[6] for r in got if r[6] is not None}
    assert len(set(names.values())) == 6 and names["a_b"] == "a_b" and names["ann"] == "ann"


def test_odd_rows(spark):
    rows = [
        (None, 1, "a", "x"), (None, None, "b", None), (2, 5, None, "<|im_end|>"), (2, 5, "a", "tie"), (2, 5, "a", "tie"),
        (3, 0, "system", "alone"), (4, 1, "a", "long " * 30_000), (4, 2, "b", ""),
    ]
    check(spark, rows)


def test_a_long_dialogue_is_summed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 8)
    check(spark, [(1, i * 3 % 200, f"s{i % 3}", "t" * (i % 7)) for i in range(150)])


@pytest.mark.parametrize("schema", [SCHEMA, "conv_id string, turn int, role string, text string"])
def test_empty_table(spark, schema):
    assert rotate_perspectives(spark.createDataFrame([], schema)).collect() == []
