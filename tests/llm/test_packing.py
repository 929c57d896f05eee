import base64
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from paperloom.llm.packing import Schedule, pack_mixture, plan_runs

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, source string, ids string, length string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=9), st.data())
def test_schedule_serves_every_token_once(totals, data):
    window = 64
    totals = np.array(totals, np.int64)
    weights = totals.astype(float)
    if data.draw(st.booleans()):
        weights = np.array(data.draw(st.lists(st.floats(0, 9), min_size=len(totals), max_size=len(totals))))
    runs = plan_runs(totals, weights, window)
    schedule = Schedule(runs, totals, window)
    filled = defaultdict(dict)
    for q, n in enumerate(totals):
        begin = 0
        while begin < n:  # asked for in parts, as chunks do
            end = min(int(n), begin + data.draw(st.integers(1, 5000)))
            windows, cut, offset = schedule.cuts(q, begin, end)
            ends = np.append(cut[1:], end)
            for w, a, b, o in zip(windows, cut, ends, offset, strict=True):
                for t in range(max(a, begin), min(b, end)):
                    assert (o + t - a) not in filled[w]
                    filled[w][o + t - a] = (q, t)
            begin = end
    assert sum(map(len, filled.values())) == totals.sum()
    for w, slots in filled.items():
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) == (window if w < max(filled) else totals.sum() - window * max(filled))


def test_windows_mirror_the_mixture():
    """While all queues last, a walk with deficit counters serves the same tokens within one."""
    totals = np.array([20480, 15360, 5120], np.int64)
    window = 64
    schedule = Schedule(plan_runs(totals, totals.astype(float), window), totals, window)
    share = totals / totals.sum()
    for q in range(3):
        windows, cut, _ = schedule.cuts(q, 0, int(totals[q]))
        deficit, served, at = 0.0, 0, dict(zip(windows, cut, strict=True))
        for w in range(int(totals.sum()) // window - 2):
            assert abs(at.get(w, served) - served) <= 1
            deficit += share[q] * window
            served += int(deficit)
            deficit -= int(deficit)


@pytest.mark.parametrize("scale", [1, 10**9], ids=["small", "exact_beyond_64_bits"])
@pytest.mark.parametrize(
    ("weights", "drift"),
    [
        ([1, 1, 1], 1),
        ([1e-6, 0.5, 0.499999], 1),
        ([3, 5, 7, 11, 13, 17, 19], 2),
        ([10**6] + [1 + i % 3 for i in range(300)], 2),
    ],
)
def test_no_queue_drifts_off_its_share(weights, drift, scale):
    """Wherever one looks, a queue has its share up to that window within a token or two, and never loses one."""
    window = 64
    total = np.array([1 << 40] * len(weights), np.int64) * min(scale, 1 << 10)
    run = plan_runs(total, np.array(weights, float), window)[0]
    assert run.count > 10**6
    points = np.unique(np.concatenate([np.arange(500), np.linspace(0, run.count - 1, 999).astype(np.int64)]))
    each = [Fraction(w) for w in np.array(weights, float).tolist()]
    for q in range(0, len(weights), max(1, len(weights) // 8)):
        got = run.before(points, run.path(q))[0].tolist()
        assert got == sorted(got)
        for k, n in zip(points.tolist(), got, strict=True):
            assert abs(n - each[q] * k * window / sum(each)) <= drift
    for k in (1, 7, run.count):
        alone = [int(run.before(np.array([k]), run.path(q))[0][0]) for q in range(len(weights))]
        assert alone == run.totals(k).tolist() and sum(alone) == k * window


def test_thin_queue_is_found_token_by_token():
    """A queue whose tokens lie thousands of windows apart costs its tokens, not the windows between."""
    totals = np.array([300, 1 << 40], np.int64)
    schedule = Schedule(plan_runs(totals, totals.astype(float), 64), totals, 64)
    windows, cut, offset = schedule.cuts(0, 100, 200)
    assert cut.tolist() == list(range(100, 200)) and np.diff(windows).min() > 10**7
    # the other queue fills these windows but for that token
    for w, o in zip(windows[:5].tolist(), offset[:5].tolist(), strict=True):
        run = schedule.runs[0]
        other = run.before(np.array([w, w + 1]), run.path(1))
        assert other[0][1] - other[0][0] == 63 and o in (0, 63)


def test_targets_hold_until_a_queue_is_dry():
    totals = np.array([1000, 9000], np.int64)
    schedule = Schedule(plan_runs(totals, np.array([0.5, 0.5]), 100), totals, 100)
    windows, cut, _ = schedule.cuts(0, 0, 1000)
    assert windows.tolist() == list(range(20)) and np.diff(cut).tolist() == [50] * 19


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def pieces_of(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return pack_mixture(df, RANKS, public_tokenizers.PATTERN, **more).collect()


def test_small_source_with_a_target(spark):
    """A source with less than 1 / window of all tokens gets its wanted share, not the last place."""
    rows = [(i, "the quick brown fox " * 500, "big", "", "") for i in range(80)]
    rows.append((1000, "a b c d e f g h", "small", "", ""))
    got = pieces_of(spark, rows, targets={"big": 0.999, "small": 0.001})
    assert min(p["sequence_id"] for p in got if p["doc_id"] == 1000) == 0


def test_added_tokens_as_the_library_at_its_defaults(spark):
    from paperloom.llm.tokens import added_tokens

    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y\n\n<|endoftext|><|endoftext|>", "<|endoftext|", "plain"]
    got = pieces_of(spark, [(i, t, "a", "", "") for i, t in enumerate(texts)], added=added_tokens(file))
    ids = defaultdict(dict)
    for p in got:
        ids[p["doc_id"]][p["start"]] = bytes(p["ids"])
    for i, t in enumerate(texts):
        want = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert b"".join(x for _, x in sorted(ids[i].items())) == b"".join(n.to_bytes(4, "little") for n in want)


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.5}, {"zzz": 1.0}])
def test_pieces(spark, reference, targets):
    texts = [None, "", "short", "the quick brown fox " * 900, "x" * 3000, "Été\n\nöß 123 " * 40, "the end<|endoftext|>"]
    rows = [(i, texts[i % 7], ("a", "b", None)[i % 3], "clash", "clash") for i in range(40)]
    got = pieces_of(spark, rows, targets=targets)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc, text, *_ in rows:
        ids, at = reference(text), 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            at += p["length"]
            want = b"".join(i.to_bytes(4, "little") for i in ids[p["start"] : at])
            assert bytes(p["ids"]) == want
        assert at == len(ids)
    total = sum(len(reference(t)) for _, t, *_ in rows)
    assert sorted(by_sequence) == list(range(-(-total // 1024)))
    for s, pieces in by_sequence.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == (1024 if s < max(by_sequence) else total - 1024 * s)


def test_repeated_and_null_keys(spark, reference):
    rows = [(None, "a b c", "a", "", ""), (7, "d e f", "a", "", ""), (7, "d e f", "a", "", "")]
    got = pieces_of(spark, rows)
    assert sorted(str(p["doc_id"]) for p in got) == ["7", "7", "None"]
    assert sum(p["length"] for p in got) == sum(len(reference(t)) for _, t, *_ in rows)


def test_empty_table(spark):
    assert pieces_of(spark, []) == []


def test_rank_file_is_the_tokenizers_vocabulary():
    with open(RANKS, "rb") as lines:
        assert len({base64.b64decode(line.split()[0]) for line in lines}) == 50256
