"""Container, lineage and source queries (C, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import containers as c
from paperloom.session import new_folder
from paperloom.sources import corpus, results
from paperloom.streaming import jobs
from workload import inputs
from workload.oracle_inputs import oracle
from workload.registry import query

TREE = {
    "nodes": """
SELECT 'doc:' || doc_id AS document_id, 'src:' || source AS root_id, 'box1:' || source || '/' || (doc_id // 2) AS parent_id,
       doc_id || '.txt' AS name, sha256(text) AS file_hash FROM documents
UNION ALL
SELECT DISTINCT 'box' || lv || ':' || source || '/' || (doc_id // (1 << lv)), 'src:' || source,
       CASE WHEN lv = 7 THEN 'src:' || source ELSE 'box' || (lv + 1) || ':' || source || '/' || (doc_id // (1 << (lv + 1))) END,
       (doc_id // (1 << lv)) || '.zip', NULL FROM documents, range(1, 8) AS t(lv)
UNION ALL
SELECT DISTINCT 'src:' || source, 'src:' || source, NULL, source || '.tar', NULL FROM documents""",
    "walk": """
SELECT document_id, document_id AS chain, name AS tree_path, 1 AS length FROM nodes WHERE parent_id IS NULL
UNION ALL
SELECT n.document_id, w.chain || '>' || n.document_id, w.tree_path || '/' || n.name, w.length + 1
FROM nodes n JOIN walk w ON n.parent_id = w.document_id""",
}


@query("lineage_chain", oracle("SELECT document_id, chain, length FROM walk", extra=TREE, recursive=True))
def lineage_chain(spark, sf_dir):
    out = c.lineage_chain(inputs.lineage_rows(spark, sf_dir))
    return out.select("document_id", F.array_join("chain", ">").alias("chain"), "length")


@query("document_tree", oracle("SELECT document_id, tree_path, length AS level FROM walk", extra=TREE, recursive=True))
def document_tree(spark, sf_dir):
    return c.document_tree(inputs.lineage_rows(spark, sf_dir), "file_name").select("document_id", "tree_path", "level")


@query(
    "lineage_children",
    oracle(
        """
SELECT parent_id, count(*) AS n_children, min(document_id) AS first_child, max(document_id) AS last_child
FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id""",
        extra=TREE,
        recursive=True,
    ),
)
def lineage_children(spark, sf_dir):
    return c.children_counts(inputs.lineage_rows(spark, sf_dir))


def _leaves(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("root_id"), F.sha2("text", 256).alias("file_hash"), "n_chars"
    )


@query(
    "hash_dedup",
    oracle("SELECT min(doc_id) AS document_id, source AS root_id, sha256(text) AS file_hash FROM documents GROUP BY source, sha256(text)"),
)
def hash_dedup(spark, sf_dir):
    """Copies inside one source are kept once; the same text under two sources stays twice."""
    return c.dedup_by_hash(_leaves(spark, sf_dir), order=("document_id",)).drop("n_chars")


@query(
    "dedup_replicate",
    oracle(
        """
SELECT doc_id AS document_id, first_id AS computed_from, n_words FROM documents
JOIN (SELECT sha256(text) AS h, min(doc_id) AS first_id, any_value(len(regexp_split_to_array(text, ' '))) AS n_words
      FROM documents GROUP BY 1) ON h = sha256(text)"""
    ),
)
def dedup_replicate(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("file_hash"), "text"
    )
    out = c.dedup_and_replicate(
        docs,
        lambda d: d.select(
            "file_hash", F.col("document_id").alias("computed_from"), F.size(F.split("text", " ")).alias("n_words")
        ),
    )
    return out.select("document_id", "computed_from", "n_words")


@query(
    "unique_names",
    oracle(
        """
SELECT parent_id, ordinal,
       CASE WHEN k = 0 THEN clean WHEN contains(clean, '.') THEN regexp_replace(clean, '\\.pdf$', '') || '_' || k || '.pdf'
            ELSE clean || '_' || k END AS unique_name
FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, clean ORDER BY ordinal) - 1 AS k FROM (
        SELECT CAST(o_orderkey // 50 AS VARCHAR) AS parent_id, o_orderkey % 50 AS ordinal,
               CASE o_orderkey % 50 % 3 WHEN 0 THEN 'scan' || (o_orderkey % 50 % 4) || '.pdf'
                    WHEN 1 THEN 'in_voice_' || (o_orderkey % 50 % 2) || '.pdf' ELSE 'readme' END AS clean
        FROM orders))
UNION ALL
SELECT 'numbered', o_orderkey, 'n_' || o_orderkey || '.pdf' FROM orders
UNION ALL
SELECT 'numbered', ordinal, CASE WHEN k = 0 THEN 'n.pdf' ELSE 'n_' || n || '.pdf' END
FROM (SELECT 1000000000 + o_orderkey AS ordinal, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders WHERE o_orderkey % 10 = 0)
LEFT JOIN (SELECT n, row_number() OVER (ORDER BY n) AS rk FROM range(1, 10000000) AS r(n)
           WHERE n NOT IN (SELECT o_orderkey FROM orders)) ON rk = k"""
    ),
)
def unique_names(spark, sf_dir):
    return c.unique_names(inputs.member_names(spark, sf_dir)).select("parent_id", "ordinal", "unique_name")


@query(
    "container_types",
    oracle(
        """
SELECT path, CASE WHEN regexp_matches(lower(path), '\\.(zip|rar|7z|tar|gz|tgz)$') THEN 'archive'
                  WHEN regexp_matches(lower(path), '\\.(eml|msg)$') THEN 'email' END AS container_type FROM paths""",
        "paths",
    ),
)
def container_types(spark, sf_dir):
    return inputs.paths(spark, sf_dir).select("path", c.container_type(F.col("path")).alias("container_type"))


UNPACKED = {
    "members": """
SELECT 'box/' || doc_id || '.zip/text.txt' AS path, 1 AS depth, sha256(text) AS file_hash, octet_length(encode(text)) AS file_size FROM documents
UNION ALL
SELECT 'box/' || doc_id || '.zip/inner.zip/lang.txt', 2, sha256(doc_id || ' ' || lang), octet_length(encode(doc_id || ' ' || lang)) FROM documents"""
}


@query("decomposed_documents", oracle("SELECT path, depth, file_hash, file_size FROM members", extra=UNPACKED))
def decomposed_documents(spark, sf_dir):
    """Unpack real nested ZIP files; the copy of a text and the nested copy are dropped by content."""
    docs = c.decompose(inputs.zipped_documents(spark, sf_dir))["documents"]
    return docs.select("path", "depth", F.sha2("content", 256).alias("file_hash"), F.octet_length("content").alias("file_size"))


@query(
    "decomposed_lineage",
    oracle(
        """
SELECT extraction_depth, container_type, count(*) AS n FROM (
  SELECT 0 AS extraction_depth, 'archive' AS container_type FROM documents UNION ALL SELECT 1, 'document' FROM documents
  UNION ALL SELECT 1, 'archive' FROM documents UNION ALL SELECT 2, 'document' FROM documents) GROUP BY ALL"""
    ),
)
def decomposed_lineage(spark, sf_dir):
    lineage = c.decompose(inputs.zipped_documents(spark, sf_dir))["lineage"]
    return lineage.groupBy("extraction_depth", "container_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "preprocess_summary",
    oracle("SELECT 2 * count(*) AS total_extracted, count(*) AS original_count, 0 AS error_count FROM documents"),
)
def preprocess_summary(spark, sf_dir):
    roots = inputs.zipped_documents(spark, sf_dir)
    got = c.decompose(roots)
    return c.preprocess_summary(got["documents"], got["errors"], inputs.table(spark, sf_dir, "documents"))


ODD = {
    "odd_docs": """
SELECT CASE doc_id % 4 WHEN 0 THEN 'odd/' || doc_id || '.zip' WHEN 1 THEN 'odd/' || doc_id || '.rar'
            WHEN 2 THEN 'odd/' || doc_id || '.zip/z3.zip/z2.zip/z1.zip/z0.zip' ELSE 'odd/' || doc_id || '.zip/m.eml/lang.txt' END AS path,
       CASE doc_id % 4 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 0 END AS depth,
       CASE doc_id % 4 WHEN 2 THEN 'max_depth_reached' WHEN 3 THEN NULL ELSE 'container_unreadable' END AS note FROM documents"""
}


@query("odd_documents", oracle("SELECT path, depth, note FROM odd_docs", extra=ODD))
def odd_documents(spark, sf_dir):
    """Broken and unsupported containers stay as documents, nesting stops at its limit, mail in an archive is opened."""
    return c.decompose(inputs.odd_containers(spark, sf_dir))["documents"].select("path", "depth", "note")


@query(
    "container_errors",
    oracle(
        """
SELECT 'odd/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.zip' ELSE '.rar' END AS path, 'archive' AS container_type, 0 AS depth,
       CASE doc_id % 4 WHEN 0 THEN 'BadZipFile: File is not a zip file' ELSE 'ValueError: unsupported container: rar' END AS error
FROM documents WHERE doc_id % 4 < 2"""
    ),
)
def container_errors(spark, sf_dir):
    return c.decompose(inputs.odd_containers(spark, sf_dir))["errors"].select("path", "container_type", "depth", "error")


@query(
    "odd_summary",
    oracle(
        """
SELECT count(*) AS total_extracted, count(*) AS original_count, count(*) FILTER (doc_id % 4 < 2) AS error_count FROM documents"""
    ),
)
def odd_summary(spark, sf_dir):
    got = c.decompose(inputs.odd_containers(spark, sf_dir))
    return c.preprocess_summary(got["documents"], got["errors"], inputs.table(spark, sf_dir, "documents"))


@query(
    "unpack_in_sql",
    oracle(
        """
SELECT 'box/' || doc_id || '.zip' AS path, unnest(['text.txt', 'copy.txt', 'inner.zip', '__MACOSX/text.txt']) AS name,
       unnest([0, 1, 2, 3]) AS ordinal FROM documents"""
    ),
)
def unpack_in_sql(spark, sf_dir):
    """The unpacker as a table function of SQL."""
    c.register_unpack(spark)
    inputs.zipped_documents(spark, sf_dir).createOrReplaceTempView("packed_files")
    return spark.sql("SELECT p.path, m.name, m.ordinal FROM packed_files p, LATERAL unpack(p.path, p.content) m WHERE m.error IS NULL")


@query(
    "email_messages",
    oracle(
        """
SELECT conv_id || '-' || turn AS container_id, 'turn ' || conv_id || '-' || turn AS subject, role || '@example.org' AS sender,
       md5(text) AS body_md5, 2 AS attachment_count, 0 AS inline_image_count FROM conversations"""
    ),
)
def email_messages(spark, sf_dir):
    messages, _ = c.explode_emails(inputs.mails(spark, sf_dir))
    return messages.select("container_id", "subject", "sender", F.md5("body").alias("body_md5"), "attachment_count", "inline_image_count")


@query(
    "email_attachments",
    oracle(
        """
SELECT conv_id || '-' || turn AS container_id, 0 AS ordinal, 'no_te.txt' AS name, 'first ' || conv_id || '-' || turn AS content FROM conversations
UNION ALL SELECT conv_id || '-' || turn, 1, 'no_te_1.txt', 'second ' || conv_id || '-' || turn FROM conversations"""
    ),
)
def email_attachments(spark, sf_dir):
    _, attachments = c.explode_emails(inputs.mails(spark, sf_dir))
    return attachments.select("container_id", "ordinal", "name", F.col("content").cast("string").alias("content"))


# --- sources -----------------------------------------------------------------------------------

ENTITIES = "&lt;=< &gt;=> &quot;=\" &#39;='' &nbsp;=\\x20 &amp;=&"


def _decoded(expr: str) -> str:
    for entity, char in corpus.ENTITIES.items():
        char = char.replace("'", "''")
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


HTML_SQL = _decoded(
    f"regexp_replace(regexp_replace(html, '{corpus.HIDDEN_PATTERN}', ' ', 'g'), '<[^>]+>', ' ', 'g')"
)


@query(
    "html_text",
    oracle(
        f"""
SELECT page_id, md5(trim(regexp_replace({HTML_SQL}, '[ \\t\\r\\n]+', ' ', 'g'))) AS text_md5,
       nullif(trim({_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), '') AS title,
       nullif(regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1), '') AS lang
FROM pages"""
    ),
)
def html_text(spark, sf_dir):
    out = corpus.html_extract(inputs.table(spark, sf_dir, "pages"))
    return out.select("page_id", F.md5("text").alias("text_md5"), "title", "lang")


@query(
    "html_links",
    oracle(
        """
SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1)) AS link FROM pages"""
    ),
)
def html_links(spark, sf_dir):
    return inputs.table(spark, sf_dir, "pages").select("page_id", F.explode(corpus.html_links(F.col("html"))).alias("link"))


@query(
    "typed_results",
    oracle(
        """
SELECT path, 'invoice' AS document_type, vendor, CAST(total_amount AS DOUBLE) AS total_amount, CAST(invoice_date AS VARCHAR) AS invoice_date,
       NULL AS agreement_id, NULL AS n_parties FROM inv
UNION ALL
SELECT path, 'agreement', NULL, NULL, NULL, agreement_id, CASE WHEN single_party THEN 1 ELSE 2 END FROM agr""",
        "inv",
        "agr",
    ),
)
def typed_results(spark, sf_dir):
    """Stored JSON of two types, read back into one typed table."""
    inv = inputs.invoices(spark, sf_dir).select("path", F.to_json(F.struct("document_type", "metadata", "vendor", "financial")).alias("json"))
    agr = inputs.agreements(spark, sf_dir).select("path", F.to_json(F.struct("document_type", "metadata", "parties")).alias("json"))
    out = results.parse_results(inv.unionByName(agr), "json", "path")
    return out.select(
        "path",
        "document_type",
        F.col("invoice.vendor.name").alias("vendor"),
        F.col("invoice.financial.total_amount").cast("double").alias("total_amount"),
        F.col("invoice.metadata.invoice_date").cast("string").alias("invoice_date"),
        "agreement.metadata.agreement_id",
        F.when(F.col("agreement").isNotNull(), F.size("agreement.parties")).alias("n_parties"),
    )


@query(
    "json_documents",
    oracle(
        """
SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
       CASE WHEN event_id % 11 = 0 THEN 'not valid JSON' END AS error
FROM events"""
    ),
)
def json_documents(spark, sf_dir):
    """Untyped JSON read through VARIANT; every eleventh text is cut off and gives an error."""
    key = F.col("event_id")
    text = F.when(key % 11 == 0, F.concat(F.lit("["), F.col("props"))).otherwise(F.col("props"))
    docs = inputs.table(spark, sf_dir, "events").select(key.alias("path"), text.alias("text"), F.lit(None).cast("string").alias("error"))
    out = corpus.parse_json_docs(docs)
    return out.select(F.col("path").alias("event_id"), F.try_variant_get("data", "$.k", "bigint").alias("k"), "error")


@query(
    "selected_output",
    oracle("SELECT invoice_number, vendor, CAST(total_amount AS DOUBLE) AS total_amount FROM inv", "inv"),
)
def selected_output(spark, sf_dir):
    """Output without confidences and source references."""
    docs = inputs.invoices(spark, sf_dir).select("path", "metadata", "vendor", "financial")
    out = results.select_output(docs, confidence=False, source_references=False)
    flat = results.flatten(out)
    assert not [name for name in flat.columns if "confidence" in name or name == "path"]
    return flat.select(
        F.col("`metadata.invoice_number`").alias("invoice_number"),
        F.col("`vendor.name`").alias("vendor"),
        F.col("`financial.total_amount`").cast("double").alias("total_amount"),
    )


# --- files written from the tables, read back by the readers ------------------------------------


def _folder(spark, name):
    return new_folder(spark, f"files-{name}")


def _key(column="path"):
    return F.regexp_extract(column, "key=([0-9]+)", 1).cast("bigint").alias("key")


def _write_files(spark, rows, folder):
    """A folder with a text file per key, written by all cores: a table of few bytes makes very many files. All rows
    of a key stay in one task, so in one file."""
    rows.repartition(spark.sparkContext.defaultParallelism, "key").write.partitionBy("key").text(folder)


def _text_files(spark, sf_dir):
    """A folder with one text file per supplier; every seventh is not UTF-8."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("Supplier "), F.col("s_name"), F.lit("\nBalance "), k.cast("string"))
    raw = F.when(k % 7 == 0, F.concat(F.unhex(F.lit("C328")), text.cast("binary"))).otherwise(text.cast("binary"))
    folder = _folder(spark, "text")
    rows = inputs.table(spark, sf_dir, "supplier").select(k.alias("key"), raw.cast("string").alias("value"))
    _write_files(spark, rows, folder)
    return folder


SUPPLIER_TEXT = {
    "texts": """
SELECT s_suppkey AS key, 'Supplier ' || s_name || chr(10) || 'Balance ' || s_suppkey || chr(10) AS text, s_suppkey % 7 = 0 AS broken FROM supplier"""
}


@query(
    "corpus_files",
    oracle("SELECT key, octet_length(encode(text)) + CASE WHEN broken THEN 2 ELSE 0 END AS length FROM texts", extra=SUPPLIER_TEXT),
)
def corpus_files(spark, sf_dir):
    """A recursive scan of a folder by pattern."""
    return corpus.read_corpus(spark, _text_files(spark, sf_dir), ["*.txt"]).select(_key(), "length")


@query(
    "text_files",
    oracle(
        """
SELECT key, CASE WHEN broken THEN '' ELSE text END AS text, CASE WHEN broken THEN 'invalid UTF-8' END AS error FROM texts""",
        extra=SUPPLIER_TEXT,
    ),
)
def text_files(spark, sf_dir):
    return corpus.read_text_docs(spark, _text_files(spark, sf_dir)).select(_key(), "text", "error")


@query(
    "watched_files",
    oracle("SELECT key, octet_length(encode(text)) + CASE WHEN broken THEN 2 ELSE 0 END AS length FROM texts", extra=SUPPLIER_TEXT),
)
def watched_files(spark, sf_dir):
    """The same folder as a stream of arriving files."""
    stream = corpus.stream_corpus(spark, _text_files(spark, sf_dir), ["*.txt"]).select("path", "length")
    base = _folder(spark, "watch")
    return jobs.run_available(stream, f"{base}/out", f"{base}/state").select(_key(), "length")


@query(
    "json_files",
    oracle(
        """
SELECT s_suppkey AS key, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS name,
       CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 THEN s_suppkey END AS number,
       CASE WHEN s_suppkey % 7 = 0 THEN 'not valid JSON' WHEN s_suppkey % 5 = 0 THEN 'does not fit the schema' END AS error FROM supplier"""
    ),
)
def json_files(spark, sf_dir):
    """One JSON file per supplier; some are cut off, some have text where a number belongs."""
    k = F.col("s_suppkey")
    number = F.when(k % 5 == 0, F.lit('"many"')).otherwise(k.cast("string"))
    whole = F.concat(F.lit('{"name": "'), F.col("s_name"), F.lit('", "number": '), number, F.lit("}"))
    rows = inputs.table(spark, sf_dir, "supplier").select(
        k.alias("key"), F.when(k % 7 == 0, F.substr(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("value")
    )
    folder = _folder(spark, "json")
    _write_files(spark, rows, folder)
    docs = corpus.read_json_docs(spark, folder, "name STRING, number BIGINT", ["*.txt"])
    return docs.select(_key(), "data.name", "data.number", "error")


@query("csv_files", oracle("SELECT s_suppkey AS k, s_name || ', \"Ltd\"' AS name, s_nationkey AS nation FROM supplier"))
def csv_files(spark, sf_dir):
    """One CSV folder per nation, with quotes and commas inside values."""
    folder = _folder(spark, "csv")
    rows = inputs.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), F.concat("s_name", F.lit(', "Ltd"')).alias("name"), F.col("s_nationkey").alias("key")
    )
    rows.write.partitionBy("key").option("header", "true").option("escape", '"').csv(folder)
    docs = corpus.read_csv_docs(spark, folder, "k BIGINT, name STRING", escape='"')
    return docs.select("k", "name", _key().alias("nation"))


@query("xml_files", oracle("SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance FROM supplier"))
def xml_files(spark, sf_dir):
    folder = _folder(spark, "xml")
    rows = inputs.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    rows.write.option("rowTag", "supplier").option("rootTag", "suppliers").xml(folder)
    return corpus.read_xml_docs(spark, folder, "supplier", "k BIGINT, name STRING, balance DOUBLE").select("k", "name", "balance")


@query(
    "written_results",
    oracle(
        """
SELECT path, 'invoice' AS document_type, vendor, CAST(total_amount AS DOUBLE) AS total_amount FROM inv""",
        "inv",
    ),
)
def written_results(spark, sf_dir):
    """Results written as JSON, read back as typed tables; as flat CSV, with the same rows."""
    docs = inputs.invoices(spark, sf_dir).select("document_type", F.col("path").alias("document_path"), "metadata", "vendor", "financial")
    folder, flat = _folder(spark, "results"), _folder(spark, "flat")
    results.write_results(docs, folder, compression="gzip")
    results.write_results(docs, flat, "csv", compression="gzip")
    back = results.read_results(spark, folder).select("document_type", "invoice.*").drop("document_type")
    lines = spark.read.option("header", "true").csv(flat).select(F.col("document_path").alias("path"), "document_type")
    typed = back.select(F.col("document_path").alias("path"), F.col("vendor.name").alias("vendor"), F.col("financial.total_amount").cast("double").alias("total_amount"))
    return lines.join(typed, "path").select("path", "document_type", "vendor", "total_amount")
