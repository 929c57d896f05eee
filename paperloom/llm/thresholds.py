"""Quality rules whose cutoffs are chosen on labelled documents with a bounded risk.

Every rule has a statistic (larger is worse) and a grid of cutoffs. Documents labelled clean are the
holdout. Per stratum and rule the cutoffs are tested from the laxest to the strictest; an exact binomial
test must reject "more than `risk / rules` of the clean documents lie above it", and the first failure
ends the sequence. Tests in a fixed sequence need no correction among themselves; the level of each is
`level` divided by the number of sequences (strata x rules), so with probability 1 - level no stratum
loses more than `risk` of its clean documents to the rules together. Where labels are too few to show
that, a rule rejects nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.common import give_back, settle, slices

_WORDS = re.compile("[^\x20\x09-\x0d]+").findall
_WORD_IN = re.compile("[^\x20\x09-\x0d]").search
_SYMBOLS = re.compile(r"[#*$%&|<>]").findall

#: Cutoffs of up to so many strata are constants of the plan; those of more are a joined table.
STRATA = 64
NO_STRATUM = "(null)"


@dataclass(frozen=True)
class QualityRule:
    """Reject where 1000 * numerator > cutoff * denominator."""

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[int, ...]


#: Cutoffs in thousandths, strictest first.
RULES = (
    QualityRule("symbols_per_word", "n_symbols", "n_words", (20, 35, 50, 75, 100, 150, 200, 300, 500, 1000)),
    QualityRule("duplicate_lines", "n_dup_lines", "n_lines", (50, 75, 100, 150, 200, 300, 400, 500, 700, 900)),
    QualityRule("repeated_words", "n_repeat_words", "n_words", (50, 75, 100, 150, 200, 250, 300, 350, 400, 450)),
    QualityRule("word_length", "word_chars", "n_words", (6000, 7000, 8000, 9000, 10000, 12000, 15000, 20000, 30000)),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _repeated(words: list[str]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if k == n:
        return 0
    if k < 2_000_000:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # the product of three would not fit
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def text_statistics(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    words = _WORDS(text)
    lines = [x for x in text.split("\n") if _WORD_IN(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(_SYMBOLS(text)),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
    )


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def document_statistics(docs: DataFrame, key: str, text: str, stratum: str) -> DataFrame:
    """Rows (key, stratum, digest, statistics) of whole texts; null text has no words. Equal texts have equal
    digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            give_back()
            for batch in slices(whole, "text", 2 << 20):
                found = [text_statistics(t or "") for t in batch.column("text").to_pylist()]
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in carried], *[pa.array(c, pa.int64()) for c in columns]],
                    [*carried, *STATISTICS],
                )

    carried = ["key", "stratum", "digest"]
    rows = docs.select(
        F.col(key).alias("key"),
        _group(stratum).alias("stratum"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
        F.col(text).alias("text"),
    )
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, stratum string, digest long, " + ", ".join(f"{c} long" for c in STATISTICS))


def _group(stratum: str) -> Column:
    """The stratum as text; Spark's cast wherever strata are compared."""
    return F.coalesce(F.col(stratum).cast("string"), F.lit(NO_STRATUM))


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p), exactly: terms are added downward from k until they vanish.

    Meant for k at or below the mean, where terms fall off geometrically.
    """
    if k < 0:
        return -math.inf
    if k >= n:
        return 0.0
    top = (
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    total, term, i = 1.0, 1.0, k
    while i > 0:
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        if term < total * 1e-17:
            break
        i -= 1
    return min(0.0, top + math.log(total))


def certified(rejected: int, clean: int, risk: float, level: float) -> bool:
    """Whether `rejected` of `clean` documents shows a rejection rate below `risk` at this level."""
    if not clean or rejected >= clean * risk:
        return False
    return log_binomial_tail(rejected, clean, risk) <= math.log(level)


def exceeds(rule: QualityRule, cutoff: Column | int) -> Column:
    limit = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    return F.lit(1000) * F.col(rule.numerator) > limit * F.col(rule.denominator)


def choose_cutoffs(
    labelled: DataFrame, rules: Sequence[QualityRule] = RULES, risk: float = 0.02, level: float = 0.05
) -> dict[str, dict[str, int]]:
    """Cutoff per stratum and rule from clean documents (rows with `_stratum` and the statistics).

    One aggregation counts, per stratum, the clean documents above every cutoff. Strata are tested where
    their counts are; only cutoffs reach the driver, and strata that have one number at most the labels
    over the labels that a certificate needs.
    """
    names = {(r.name, c): f"{r.name}_{c}" for r in rules for c in r.cutoffs}
    counts = labelled.groupBy("_stratum").agg(
        F.count(F.lit(1)).alias("clean"),
        *[F.count_if(exceeds(r, c)).alias(names[r.name, c]) for r in rules for c in r.cutoffs],
    )
    counts = settle(counts)
    sequences = max(1, counts.count() * len(rules))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strata, found, cutoffs = [], [], []
            for row in batch.to_pylist():
                for rule in rules:
                    passed = None
                    for cutoff in sorted(rule.cutoffs, reverse=True):
                        above = row[names[rule.name, cutoff]]
                        if not certified(above, row["clean"], risk / len(rules), level / sequences):
                            break
                        passed = cutoff
                    if passed is not None:
                        strata.append(row["_stratum"]), found.append(rule.name), cutoffs.append(passed)
            columns = [pa.array(strata, pa.string()), pa.array(found, pa.string()), pa.array(cutoffs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["stratum", "rule", "cutoff"])

    chosen: dict[str, dict[str, int]] = {}
    for row in counts.mapInArrow(test, "stratum string, rule string, cutoff long").collect():
        chosen.setdefault(row["stratum"], {})[row["rule"]] = row["cutoff"]
    order = [r.name for r in rules]
    return {s: {name: chosen[s][name] for name in order if name in chosen[s]} for s in sorted(chosen)}


def certified_cutoffs(
    stats: DataFrame,
    labels: DataFrame,
    key: str,
    rules: Sequence[QualityRule],
    risk: float,
    level: float,
) -> tuple[dict[str, dict[str, int]], list[str]]:
    """Cutoffs by stratum and rule, and the strata that have some. A text is evidence once per stratum, however
    many rows repeat it under whatever keys; it is clean if all labels of all its rows are."""
    by_key = (
        labels.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
    )
    texts = (
        stats.filter(~F.col("base_failed"))
        .join(by_key, "key")
        .groupBy("stratum", "digest")
        .agg(F.min("_quality").alias("_quality"), F.max("_toxic").alias("_toxic"), *[F.max(c).alias(c) for c in STATISTICS])
    )
    holdout = texts.filter((F.col("_quality") == 1) & (F.coalesce("_toxic", F.lit(0)) == 0))
    chosen = choose_cutoffs(holdout.withColumn("_stratum", F.col("stratum")), rules, risk, level)
    return chosen, list(chosen)


def _rejections(stats: DataFrame, chosen: dict[str, dict[str, int]], rules: Sequence[QualityRule]) -> DataFrame:
    """`stats` with a column rejected_by: names of the rules whose cutoff of the row's own stratum it exceeds."""
    if not chosen:
        return stats.withColumn("rejected_by", F.array().cast("array<string>"))
    if len(chosen) <= STRATA:
        by_name = {r.name: r for r in rules}
        rejections = [
            F.when((F.col("stratum") == s) & exceeds(by_name[name], cutoff), F.lit(name))
            for s, cutoffs in chosen.items()
            for name, cutoff in cutoffs.items()
        ]
        return stats.withColumn("rejected_by", F.array_compact(F.array(*rejections)))
    limits = [f"_limit{i}" for i in range(len(rules))]
    rows = [(s, *[cutoffs.get(r.name) for r in rules]) for s, cutoffs in chosen.items()]
    schema = ", ".join(["stratum string", *[f"{x} long" for x in limits]])
    joined = stats.join(F.broadcast(stats.sparkSession.createDataFrame(rows, schema)), "stratum", "left")
    rejections = [F.when(exceeds(r, F.col(x)), F.lit(r.name)) for r, x in zip(rules, limits, strict=True)]
    return joined.withColumn("rejected_by", F.array_compact(F.array(*rejections))).drop(*limits)


def _statistics(docs: DataFrame, key: str, text: str, stratum: str) -> DataFrame:
    found = document_statistics(docs, key, text, stratum)
    few = F.col("n_words") < MIN_WORDS
    repetitive = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return settle(found.withColumn("base_failed", few | repetitive))


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    rules: Sequence[QualityRule] = RULES,
    risk: float = 0.02,
    level: float = 0.05,
) -> DataFrame:
    """One row per row of `docs`: key, statistics, base_failed, rejected_by (rule names), kept.

    A text counts as clean if all labels of its rows say quality 1 and none says toxic 1, and is counted once
    per stratum; null labels, null keys and labels of unknown documents are passed over. Null text has no words and fails the base
    rules. A null stratum is a stratum of its own. Repeated rows give repeated rows. Without labels no
    cutoff is certified and only the base rules reject. Only the named columns of `docs` are read.
    """
    stats = _statistics(docs, key, text, stratum)
    chosen, _ = certified_cutoffs(stats, labels, key, rules, risk, level)
    return (
        _rejections(stats, chosen, rules)
        .select(*stats.columns, "rejected_by")
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop("stratum", "digest")
        .withColumnRenamed("key", key)
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    rules: Sequence[QualityRule] = RULES,
    risk: float = 0.02,
    level: float = 0.05,
) -> DataFrame:
    """The rows and columns of `docs` that `judge_quality` keeps.

    Cutoffs are chosen on all documents first; then each text is judged again where it is, so that no
    text is shuffled and rows need no key.
    """
    chosen, _ = certified_cutoffs(_statistics(docs, key, text, stratum), labels, key, rules, risk, level)

    def good(values: tuple[int, ...], group: str) -> bool:
        of = dict(zip(STATISTICS, values, strict=True))
        if of["n_words"] < MIN_WORDS or 100 * of["n_repeat_words"] > MAX_REPEAT_PERCENT * of["n_words"]:
            return False
        limits = chosen.get(group, {})
        return not any(
            r.name in limits and 1000 * of[r.numerator] > limits[r.name] * of[r.denominator] for r in rules
        )

    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            give_back()
            for batch in slices(whole, text, 2 << 20):
                groups = batch.column(len(names)).to_pylist()
                texts = batch.column(at).to_pylist()
                mask = [good(text_statistics(t or ""), g) for t, g in zip(texts, groups, strict=True)]
                yield batch.select(list(range(len(names)))).filter(pa.array(mask, pa.bool_()))

    return docs.withColumn("__stratum", _group(stratum)).mapInArrow(run, docs.schema)
