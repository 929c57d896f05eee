import base64
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from paperloom.llm.bpe import LONG_PIECE, codec, encode_documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, decoded string"


@pytest.fixture(scope="module")
def want():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    import numpy as np

    return np.frombuffer(codec(RANKS, public_tokenizers.PATTERN).encode([text])[0], "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text(want, text):
    assert ids_of(text) == want.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abethinrs .é", max_size=400))
def test_mergeable_text(want, text):
    assert ids_of(text) == want.encode_ordinary(text)


def test_long_pieces_agree_on_both_paths(want):
    rng = random.Random(3)
    for n in (LONG_PIECE - 1, LONG_PIECE, LONG_PIECE + 1, 5000):
        for alphabet in ("a", "ab", "theinrs", "abcdefghijklmnopqrstuvwxyz"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert ids_of(text) == want.encode_ordinary(text)


def test_heap_equals_matrix():
    own = codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(4)
    pieces = ["".join(rng.choice("aabeht ") for _ in range(rng.randint(1, 60))).encode() for _ in range(500)]
    for piece, ids in zip(pieces, own.encode_pieces(pieces), strict=True):
        assert ids.tolist() == own._by_heap(piece).tolist()


def test_documents(spark, want):
    texts = [None, "", " ", "a", "the the", "héllo\n\n  x" * 50, "the the", "<|endoftext|>", "x" * 40_000]
    rows = [(i if i else None, t, "clash", "clash") for i, t in enumerate(texts)]
    rows.append(rows[4])
    got = encode_documents(spark.createDataFrame(rows, SCHEMA), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    by_key = {r["doc_id"]: r for r in got}
    for key, text, *_ in rows:
        ids = want.encode_ordinary(text or "")
        assert by_key[key]["n_tokens"] == len(ids)
        assert bytes(by_key[key]["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert bytes(by_key[key]["decoded"]) == (text or "").encode()


def test_empty_table(spark):
    got = encode_documents(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN)
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert isinstance(got.schema["doc_id"].dataType, T.LongType)
