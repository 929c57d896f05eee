"""Token counts from flat token files that have no index.

A token file is a stream of ids, big-endian unsigned 16-bit integers, with an end-of-document id after
every document. Counting cuts a file into blocks, finds the end ids of a block in one vectorised search,
and keeps per block only their places. A document that runs over a block's edge begins after the last
end id of any block before: a prefix scan over the blocks (running maximum of end ids, running count of
documents) stitches the edges.

Files are written by Spark's text writer, so they can be in any store that Spark writes: a row holds a
document's bytes but the last, and the line separator is that last byte, the low byte of the end id.
The end id must therefore end in an ASCII byte. Files may be compressed by the writer's own codec.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from paperloom.llm.common import slices
from paperloom.llm.tokens import text_ids

ID = np.dtype(">u2")
BLOCK_TOKENS = 1 << 20


def write_token_files(
    docs: DataFrame,
    path: str,
    rank_file: str,
    pattern: str,
    end_id: int,
    shard: str = "shard",
    position: str = "position",
    text: str = "text",
    compression: str = "gzip",
) -> None:
    """Write one folder of token files per shard, its documents in order of `position`.

    All documents of a shard must be in one partition of `docs` (as those of one block of an input file
    are); then a shard is one file. Null text is an empty document: just an end id.
    """
    if end_id >> 16 or not 0 < end_id & 0xFF < 0x80:
        raise ValueError("the end id must fit 16 bits and end in an ASCII byte")
    end = np.array([end_id], ID).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                rows = []
                for t in batch.column("text").to_pylist():
                    ids = text_ids(t, rank_file, pattern)
                    if len(ids) and (ids.max() >= 1 << 16 or (ids == end_id).any()):
                        raise ValueError("the vocabulary does not fit 16 bits beside the end id")
                    rows.append(ids.astype(ID).tobytes() + end[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard"), batch.column("position"), pa.array(rows, pa.binary())],
                    ["shard", "position", "data"],
                )

    rows = docs.select(F.col(shard).alias("shard"), F.col(position).alias("position"), F.col(text).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    tokens = rows.mapInArrow(run, f"shard {kinds['shard']}, position {kinds['position']}, data binary")
    (
        tokens.sortWithinPartitions("shard", "position")
        .select("shard", F.col("data").cast("string").alias("value"))
        .write.partitionBy("shard")
        .option("lineSep", end[-1:].decode())
        .option("compression", compression)
        .text(path)
    )


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Token files as rows (shard, path, content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("shard", "path", "content")


def _blocks(content: memoryview, packed: bool, size: int) -> Iterator[bytes]:
    """Pieces of `size` bytes of a file, unpacked step by step."""
    if not packed:
        for i in range(0, len(content), size):
            yield bytes(content[i : i + size])
        return
    held, feed = bytearray(), content
    machine = zlib.decompressobj(wbits=31)
    while feed:
        held += machine.decompress(feed, size)
        feed = machine.unconsumed_tail
        if machine.eof:  # a gzip file may have several members
            feed, machine = machine.unused_data, zlib.decompressobj(wbits=31)
        while len(held) >= size:
            yield bytes(held[:size])
            del held[:size]
    if held:
        yield bytes(held)


def scan_separators(files: DataFrame, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per block of a file: shard, path, block, first token, number of end ids, their places in the file.

    A file of no bytes has no blocks. An odd last byte is no token and is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, content in zip(*batch.columns, strict=True):
                packed = path.as_py().endswith(".gz")
                begin, rows = 0, []
                for number, raw in enumerate(_blocks(memoryview(content.as_buffer()), packed, 2 * block_tokens)):
                    tokens = np.frombuffer(raw, ID, len(raw) // 2)
                    ends = np.flatnonzero(tokens == end_id) + begin
                    rows.append((number, begin, ends.tolist()))
                    begin += len(tokens)
                numbers, begins, ends = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard.as_py()] * len(rows), shard.type),
                        pa.array([path.as_py()] * len(rows), pa.string()),
                        pa.array(numbers, pa.int64()),
                        pa.array(begins, pa.int64()),
                        pa.array(ends, pa.list_(pa.int64())),
                    ],
                    ["shard", "path", "block", "begin", "ends"],
                )

    kind = files.schema["shard"].dataType.simpleString()
    return files.mapInArrow(run, f"shard {kind}, path string, block long, begin long, ends array<long>")


def documents_of(blocks: DataFrame) -> DataFrame:
    """Rows (shard, path, ordinal, start, n_tokens): every document that an end id closes.

    The prefix scan: over the blocks of a file, how many documents ended before, and where the last did.
    Tokens after a file's last end id belong to no finished document and give no row.
    """
    before = Window.partitionBy("shard", "path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = blocks.withColumns(
        {
            "_done": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
            "_last": F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1)),
        }
    ).filter(F.size("ends") > 0)
    starts = F.concat(F.array(F.col("_last") + 1), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda e: e + 1))
    spans = F.arrays_zip(starts.alias("start"), F.col("ends").alias("end"))
    return stitched.select("shard", "path", "_done", F.posexplode(spans).alias("_i", "_d")).select(
        "shard",
        "path",
        (F.col("_done") + F.col("_i")).cast("long").alias("ordinal"),
        F.col("_d.start").alias("start"),
        (F.col("_d.end") - F.col("_d.start")).alias("n_tokens"),
    )


def sharded(docs: DataFrame, rows_per_file: int = 16384) -> DataFrame:
    """Documents read from Parquet files, with their shard and the position that a rerun finds again: the
    file's row number.

    A shard is a run of rows and the input block that holds them, as RUN-START. The run depends on the file
    and the row alone; a plan that cuts the file elsewhere gives other starts.
    """
    run = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows_per_file))
    shard = F.concat(F.lit("s"), F.hex(run), F.lit("-"), F.col("_metadata.file_block_start").cast("string"))
    return docs.withColumns({"shard": shard, "position": F.col("_metadata.row_index")})


def _run() -> Column:
    return F.substring_index("shard", "-", 1)


def count_document_tokens(
    docs: DataFrame,
    folder: str,
    rank_file: str,
    pattern: str,
    end_id: int,
    key: Column | str = "doc_id",
    text: str = "text",
    rows_per_file: int = 16384,
) -> DataFrame:
    """Write `docs` (as read from Parquet) to token files below `folder`, then count each document's
    tokens by scanning the files: rows (key, shard, ordinal, start, n_tokens).

    The end id is not counted. Null text has no tokens. Keys may be null or repeat: a document is known
    by its place. Other columns, whatever their names but `shard` and `position`, do no harm.

    Documents and counts are joined by run and place in the run. Both hold for any cut of the input into
    blocks: the blocks that the files were written by are told by the files, and put in order. A document
    without a count, or a count without a document, is an error.
    """
    placed = sharded(docs, rows_per_file)
    write_token_files(placed, folder, rank_file, pattern, end_id, text=text)
    spark = docs.sparkSession
    if placed.limit(1).count():
        counted = documents_of(scan_separators(read_blocks(spark, folder), end_id))
    else:
        counted = spark.createDataFrame([], "shard string, path string, ordinal long, start long, n_tokens long")
    order = Window.partitionBy("_run").orderBy("position")
    owners = placed.select(F.col(key).alias("_key"), _run().alias("_run"), "position").select(
        "_key", "_run", F.row_number().over(order).alias("_place"), F.lit(True).alias("_owned")
    )
    block = F.substring_index("shard", "-", -1).cast("long")
    counted = counted.withColumn("_run", _run()).withColumn(
        "_place", F.row_number().over(Window.partitionBy("_run").orderBy(block, "ordinal"))
    )
    lost = F.col("n_tokens").isNull() | F.col("_owned").isNull()
    n_tokens = F.when(lost, F.raise_error(F.lit("documents and counts differ")).cast("long")).otherwise(F.col("n_tokens"))
    joined = owners.join(counted, ["_run", "_place"], "full")
    return joined.select(F.col("_key").alias(key), "shard", "ordinal", "start", n_tokens.alias("n_tokens"))
