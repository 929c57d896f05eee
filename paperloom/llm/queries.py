"""One query per operator, over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperloom.llm.bpe import encode_documents
from paperloom.llm.chat import rotate_perspectives
from paperloom.llm.collocations import collocations
from paperloom.llm.fill_in_middle import fill_in_middle, restore
from paperloom.llm.fingerprints import fingerprint_edits
from paperloom.llm.lsh_forest import near_duplicates
from paperloom.llm.multi_index import simhash_components
from paperloom.llm.packing import pack_mixture
from paperloom.llm.registry import ORACLES, QUERIES, query, table
from paperloom.llm.suffix_dedup import remove_repeats
from paperloom.llm.thresholds import judge_quality
from paperloom.llm.token_files import count_document_tokens
from paperloom.llm.tokens import added_tokens
from paperloom.llm.url_rules import judge_urls
from paperloom.llm.warc_salvage import read_archives, write_archives
from paperloom.session import checkpoint_dir

__all__ = ["ORACLES", "QUERIES"]

#: An id that the vocabulary leaves free.
END_OF_DOCUMENT = 50256
RANKS_50K = public_tokenizers.path("byte_bpe_50k.tiktoken")

OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
v AS (
  SELECT t.*, perspective, speaker = perspective AS own,
         CASE WHEN regexp_matches(speaker, '^[A-Za-z0-9_-]+$') THEN speaker
              ELSE regexp_replace(speaker, '[^A-Za-z0-9_-]', '_', 'g') || '_' || left(sha256(speaker), 8) END AS nm
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), r AS (
  SELECT *, CASE WHEN own THEN '<|im_start|>assistant' || chr(10)
                 WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
                 ELSE '<|im_start|>user name=' || nm || chr(10) END || content || '<|im_end|>' || chr(10) AS piece
  FROM v
), w AS (
  SELECT *, CAST(row_number() OVER o - 1 AS BIGINT) AS seq,
         CAST(coalesce(sum(length(piece)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM r WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content)
)
SELECT conv_id, perspective, seq, turn, speaker,
       CASE WHEN own THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
       CASE WHEN NOT own AND speaker <> 'system' THEN nm END AS name,
       piece, start,
       CASE WHEN own THEN start + 22 END AS mask_start,
       CASE WHEN own THEN start + length(piece) - 1 END AS mask_end
FROM w
"""


@query("op1_chat_perspectives", OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


@query("op2_bucket_pointers")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op3_packed_mixture")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pack_mixture(table(spark, sf_dir, "documents"), RANKS_50K, public_tokenizers.PATTERN, added=added)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op4_quality_thresholds")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rejected_by", "n_lines")


@query("op5_bpe_matrices")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), RANKS_50K, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op6_warc_salvage")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    records = read_archives(spark, folder, payloads=False).filter(F.col("gap").isNull())
    return records.select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op7_one_permutation")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op8_separator_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    counted = count_document_tokens(docs, folder, RANKS_50K, public_tokenizers.PATTERN, END_OF_DOCUMENT)
    return counted.select("doc_id", "n_tokens")


@query("op9_lsh_forest")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10 = r"""
WITH u AS (
  SELECT page_id, coalesce(contains(url, '://'), false) AS has, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), h AS (
  SELECT page_id,
         CASE WHEN has THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), best AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(verdict, length(rhost || rpath)) AS rv
  FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY ALL
)
SELECT page_id, host, path, rule,
       coalesce(rv, CASE WHEN ends_with(host || path, '.exe') OR ends_with(host || path, '.zip')
                           OR contains(host || path, '/login/') OR contains(host || path, '/cgi-bin/')
                           OR regexp_matches(host || path, '^[^/]*ads\.[^/]*/') THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""


@query("op10_url_automaton", OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


OP11 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p
), s AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS (
  SELECT lang, ws[i:i + k - 1] AS gram, count(*) AS f
  FROM s, range(1, 6) AS r(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM g WHERE len(gram) = 1 GROUP BY lang
), c AS (
  SELECT * FROM g WHERE len(gram) > 1 AND f >= 100
), inside AS (
  SELECT lang, part, max(f) AS longer
  FROM (SELECT lang, f, unnest([gram[1:len(gram) - 1], gram[2:]]) AS part FROM c WHERE len(gram) > 2) GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN inside i ON c.lang = i.lang AND c.gram = i.part
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.f
), cuts AS (
  SELECT lang, gram, f, unnest(range(1, len(gram))) AS k FROM kept
), scored AS (
  SELECT q.lang, q.gram, q.f, k, a.f AS l, b.f AS r, n,
         (CAST(1000 AS HUGEINT) * q.f * n) // (CAST(a.f AS HUGEINT) * b.f) AS score
  FROM cuts q JOIN g a ON a.lang = q.lang AND a.gram = q.gram[1:k]
  JOIN g b ON b.lang = q.lang AND b.gram = q.gram[k + 1:] JOIN totals t ON t.lang = q.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1
), named AS (
  SELECT *, array_to_string(gram, ' ') AS phrase FROM best
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase,
       CAST(f AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM named QUALIFY rank <= 2000
"""


@query("op11_count_transducers", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query("op12_multi_index")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || doc_id) AS d FROM documents
), h AS (
  SELECT *, len(units) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
         CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
              THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
         array_to_string(units[b + 1:], '') AS suf FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query("op13_counted_regex", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    restored = restore(F.col("output"), F.col("form"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"),
    )
