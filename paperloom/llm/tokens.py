"""Ids of whole texts by a rank file, for the operators that only need the ids."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Mapping

import numpy as np

_ENCODERS: dict[tuple[str, str], object] = {}


def encoder(rank_file: str, pattern: str):
    """The library's encoder for a rank file without special tokens; a worker builds it once."""
    if (rank_file, pattern) not in _ENCODERS:
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        _ENCODERS[rank_file, pattern] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODERS[rank_file, pattern]


def added_tokens(tokenizer_file: str) -> dict[str, int]:
    """Tokens that a tokenizers file adds to its vocabulary, with their ids."""
    with open(tokenizer_file, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens must match as they are")
    return {t["content"]: t["id"] for t in added}


def text_ids(text: str | None, rank_file: str, pattern: str, added: Mapping[str, int] | None = None) -> np.ndarray:
    """Ids of one text; null and empty texts have none. Each token in `added` has its own id wherever its
    text occurs; without `added`, such text is text like any other."""
    if not text:
        return np.zeros(0, np.uint32)
    if added and any(t in text for t in added):
        parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
        return np.concatenate(
            [np.array([added[x]], np.uint32) if x in added else text_ids(x, rank_file, pattern) for x in parts]
        )
    return np.array(encoder(rank_file, pattern).encode_ordinary(text), np.uint32)
