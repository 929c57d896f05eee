import gzip
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from paperloom.llm.token_files import ID, count_document_tokens, documents_of, read_blocks, scan_separators, write_token_files
from paperloom.llm.tokens import text_ids

RANKS, PATTERN, END = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256
SCHEMA = "doc_id long, text string, n_tokens string, start string, ordinal string, value string"


def counted(spark, rows, tmp_path, **more):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(k, t, "x", "x", "x", "x") for k, t in rows], SCHEMA).repartition(3).write.parquet(folder)
    docs = spark.read.parquet(folder)
    return count_document_tokens(docs, str(tmp_path / "tokens"), RANKS, PATTERN, END, **more).collect()


def test_every_document_is_counted(spark, tmp_path):
    texts = [None, "", "a", "the quick brown fox", "é" * 500, "x" * 20_000, "<|endoftext|>", "same", "same"]
    rows = list(enumerate(texts)) + [(None, "no key"), (3, "again the same key")]
    got = counted(spark, rows, tmp_path, rows_per_file=4)
    want = sorted((str(k), len(text_ids(t, RANKS, PATTERN))) for k, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == want


def test_input_cut_elsewhere_between_writing_and_counting(spark, tmp_path):
    """The table is planned twice; the second plan may cut its files into other blocks."""
    rows = pa.table({"doc_id": pa.array(range(3000)), "text": ["w " * (i % 7) + str(i) for i in range(3000)]})
    (tmp_path / "in").mkdir()
    pq.write_table(rows, tmp_path / "in" / "a.parquet", row_group_size=100, compression="none")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "9000")
        docs = spark.read.parquet(str(tmp_path / "in"))
        counts = count_document_tokens(docs, str(tmp_path / "tokens"), RANKS, PATTERN, END, rows_per_file=250)
        spark.conf.set(name, "100m")
        got = counts.collect()
    finally:
        spark.conf.set(name, before)
    want = {i: len(text_ids(t, RANKS, PATTERN)) for i, t in enumerate(rows.column("text").to_pylist())}
    assert len(got) == 3000 and {r["doc_id"]: r["n_tokens"] for r in got} == want


def test_empty_table(spark, tmp_path):
    assert counted(spark, [], tmp_path) == []


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("packed", [False, True])
def test_blocks_are_stitched(spark, tmp_path, block, packed):
    rng = random.Random(block)
    lengths = [rng.choice([0, 0, 1, 2, 5, 30]) for _ in range(60)]
    tokens = np.concatenate([np.append(np.arange(n) % 50, END) for n in lengths] + [np.arange(4)]).astype(ID)
    folder = tmp_path / "files" / "shard=s0"
    folder.mkdir(parents=True)
    data = tokens.tobytes() + b"\x00"  # an unfinished document and half a token
    name = "part-0.txt" + ".gz" * packed
    (folder / name).write_bytes((gzip.compress(data[:50]) + gzip.compress(data[50:])) if packed else data)
    (folder / "part-1.txt").write_bytes(b"")
    blocks = scan_separators(read_blocks(spark, str(tmp_path / "files")), END, block)
    got = sorted((r["ordinal"], r["start"], r["n_tokens"]) for r in documents_of(blocks).collect())
    starts = np.cumsum([0, *(n + 1 for n in lengths)])
    assert got == [(i, int(starts[i]), n) for i, n in enumerate(lengths)]


def test_files_hold_plain_tokens(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, "the cat"), ("s", 1, None)], "shard string, position long, text string").coalesce(1)
    write_token_files(df, str(tmp_path / "t"), RANKS, PATTERN, END, compression="none")
    [file] = (tmp_path / "t" / "shard=s").glob("part-*")
    assert np.frombuffer(file.read_bytes(), ID).tolist() == [*text_ids("the cat", RANKS, PATTERN).tolist(), END, END]


def test_end_id_must_fit(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, "a")], "shard string, position long, text string")
    with pytest.raises(ValueError, match="ASCII"):
        write_token_files(df, str(tmp_path / "t"), RANKS, PATTERN, 0xC480)
