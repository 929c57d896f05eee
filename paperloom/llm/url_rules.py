"""URL filter: all glob rules at once, as one bit-parallel automaton.

Every pattern takes one bit per state; the bits of all patterns stand side by side in a row of 64-bit
words. One character moves all patterns of a URL on by a shift (with the carry between words), an AND
with the character's mask, and an OR with the states that a wildcard lets stay. A batch of URLs is
moved on together, one character position after the other, so the work per character is a few numpy
operations on an array (URLs, words), whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """`verdict` for a host with all its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        quoted = quote(self.host + self.path) + "**"
        return [quoted, "*." + quoted]


#: The rules of the query.
RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)
#: What is blocked where no rule fits: paths that are no pages of text.
BLOCKED_GLOBS = ("**.exe", "**.zip", "**/login/**", "**/cgi-bin/**", "*ads.*/**")


def quote(text: str) -> str:
    """`text` as a glob that matches only itself."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


@dataclass
class Automaton:
    """Globs packed into multiword Shift-And masks.

    `*` is any run of bytes but `/`, `**` any run of bytes, `?` one byte but `/`, a backslash takes the
    next character literally. Globs are matched against whole strings (UTF-8 bytes).
    """

    globs: Sequence[str]
    enter: np.ndarray = field(init=False)
    stay: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)
    final: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        parsed = [self._states(g.encode()) for g in self.globs]
        bits = sum(len(p) for p in parsed)
        words = max(1, -(-bits // 64))
        self.enter = np.zeros((256, words), np.uint64)
        self.stay = np.zeros((256, words), np.uint64)
        self.start = np.zeros(words, np.uint64)
        self.final = np.zeros(len(parsed), np.int64)
        at = 0
        for number, states in enumerate(parsed):
            for depth, (entry, loop) in enumerate(states):
                word, bit = divmod(at, 64)
                mask = np.uint64(1 << bit)
                if depth == 0:
                    self.start[word] |= mask
                else:
                    self.enter[entry, word] |= mask
                self.stay[loop, word] |= mask
                at += 1
            self.final[number] = at - 1

    @staticmethod
    def _states(glob: bytes) -> list[tuple[list[int], list[int]]]:
        """Per state the bytes that enter it and the bytes on which it stays."""
        any_byte, no_slash = list(range(256)), [b for b in range(256) if b != ord("/")]
        states: list[tuple[list[int], list[int]]] = [([], [])]
        i = 0
        while i < len(glob):
            c = glob[i : i + 1]
            if c == b"*":
                wide = glob[i : i + 2] == b"**"
                entry, loop = states[-1]
                states[-1] = (entry, any_byte if wide or len(loop) == 256 else no_slash)
                i += 2 if wide else 1
                continue
            if c == b"?":
                states.append((no_slash, []))
            else:
                i += c == b"\\" and i + 1 < len(glob)
                states.append(([glob[i]], []))
            i += 1
        return states

    def match(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Boolean (strings, globs): which whole strings each glob matches."""
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")  # longest first: those still running are a prefix
        begin, left = offsets[:-1][order], lengths[order]
        state = np.repeat(self.start[None, :], n, axis=0)
        one, top = np.uint64(1), np.uint64(63)
        running, position = n, 0
        while True:
            running = int(np.searchsorted(-left[:running], -position, "left"))
            if not running:
                break
            byte = flat[begin[:running] + position]
            now = state[:running]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:running] = (moved & self.enter[byte]) | (now & self.stay[byte])
            position += 1
        found = np.empty((n, len(self.globs)), bool)
        words, bits = self.final // 64, (self.final % 64).astype(np.uint64)
        found[order] = (state[:, words] >> bits) & one
        return found


def host_and_path(df: DataFrame, url: str) -> DataFrame:
    """Add `host` and `path`; both are empty for a null URL or one without `://`."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")
    lower = F.translate(
        F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return df.withColumn("path", F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")).withColumn(
        "host", F.when(has, lower).otherwise("")
    )


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    key: str = "page_id",
    rules: Sequence[Rule] = RULES,
    blocked_globs: Sequence[str] = BLOCKED_GLOBS,
) -> DataFrame:
    """One row per row of `pages`: key, host, path, the longest rule that fits (or null) and the verdict.

    Without a rule a URL is blocked where one of `blocked_globs` matches host + path, else allowed. Null,
    empty and broken URLs have an empty host and path, which no rule fits, and are allowed. Repeated rows
    give repeated rows; other columns of `pages`, whatever their names, are not read. Rules of equal
    length cannot both fit one URL unless they are equal; the first then wins.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = [g for r in ranked for g in r.globs()]
    machine = Automaton([*globs, *blocked_globs])
    names = np.array([r.name for r in ranked] + [None], object)
    verdicts = np.array([r.verdict for r in ranked] + [ALLOW], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from paperloom.llm.common import slices, text_bytes

        for whole in batches:
            for batch in slices(whole, "_canonical", 4 << 20):
                found = machine.match(*text_bytes(batch.column("_canonical")))
                fits = found[:, : len(globs)].reshape(len(found), len(ranked), 2).any(2)
                fits = np.concatenate([fits, np.ones((len(found), 1), bool)], 1)
                best = fits.argmax(1)
                blocked = (best == len(ranked)) & found[:, len(globs) :].any(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"),
                        batch.column("host"),
                        batch.column("path"),
                        pa.array(names[best], pa.string()),
                        pa.array(np.where(blocked, BLOCK, verdicts[best]), pa.string()),
                    ],
                    ["key", "host", "path", "rule", "verdict"],
                )

    parts = host_and_path(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), "url").select(
        "key", "host", "path", F.concat("host", "path").alias("_canonical")
    )
    kind = parts.schema["key"].dataType.simpleString()
    out = parts.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("key", key)
