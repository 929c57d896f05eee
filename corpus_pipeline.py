"""From raw documents to packed sequences: quality rules, near-dedup, removal of repeats, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`docs`. `run` writes each stage's result to the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm.common import settle
from paperloom.llm.lsh_forest import drop_near_duplicates
from paperloom.llm.packing import pack_mixture
from paperloom.llm.registry import query
from paperloom.llm.suffix_dedup import without_repeats
from paperloom.llm.thresholds import keep_good
from paperloom.llm.tokens import added_tokens

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Five words a shingle; documents as like as this, in percent, are copies of each other.
NEAR_PERCENT = 80
#: Bytes of a string that may not repeat across documents.
REPEATED_BYTES = 50
WINDOW = 1024


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs certified on the labels."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id."""
    return drop_near_duplicates(docs, percent=NEAR_PERCENT)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that a document of smaller id has too; `n_chars` counts what is left."""
    cut = without_repeats(docs, length=REPEATED_BYTES)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows that mirror the mixture of sources."""
    pieces = pack_mixture(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, window=WINDOW,
        added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")),
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", repeats),
    ("packing", packing),
]

#: No stage but the quality rules' statistics can be said in SQL; the stages are tested by brute force.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
