"""Classification, routing and MIME queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import classify as k
from workload import inputs
from workload.oracle_inputs import oracle, sql_list
from workload.registry import query

STEM = r"regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\.[^.]+$', '\1')"
SUFFIX = r"regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1)"


def _keyword_case(text: str, prefix: str) -> str:
    whens = [
        f"WHEN contains({text}, '{w}') THEN '{kind}/{prefix}:{w}'" for kind, words in k.KEYWORDS.items() for w in words
    ]
    return "CASE " + " ".join(whens) + " END"


CASCADE = {
    "facts": f"SELECT *, lower({SUFFIX}) AS ext, lower({STEM}) AS stem FROM paths",
    "steps": f"""
SELECT *, CASE WHEN ext IN ('.zip', '.rar', '.tar', '.7z', '.gz') THEN 'archive' WHEN ext IN ('.eml', '.msg') THEN 'email' END
         AS by_ext,
       {_keyword_case("stem", "filename")} AS by_name, {_keyword_case("lower(hint)", "hint")} AS by_hint
FROM facts""",
    "classified": """
SELECT o_orderkey, path,
       coalesce(by_ext, split_part(by_name, '/', 1), split_part(by_hint, '/', 1), 'document') AS type,
       CASE WHEN by_ext IS NOT NULL THEN 1.0 WHEN by_name IS NOT NULL THEN 0.8 WHEN by_hint IS NOT NULL THEN 0.7 ELSE 0.5 END::DOUBLE
         AS confidence,
       CASE WHEN by_ext IS NOT NULL THEN 'extension' WHEN by_name IS NOT NULL THEN 'filename_keyword'
            WHEN by_hint IS NOT NULL THEN 'content_hint' ELSE 'default' END AS method,
       CASE WHEN by_ext IS NOT NULL THEN 'extension:' || ext ELSE coalesce(split_part(by_name, '/', 2), split_part(by_hint, '/', 2), '') END
         AS features
FROM steps""",
}


def _classified(spark, sf_dir):
    return k.classify(inputs.paths(spark, sf_dir), hint="hint")


@query("classify_cascade", oracle("SELECT * FROM classified", "paths", extra=CASCADE))
def classify_cascade(spark, sf_dir):
    out = _classified(spark, sf_dir).select("o_orderkey", "path", "classification.*")
    return out.withColumn("features", F.array_join("features", ","))


@query(
    "confidence_gate",
    oracle(
        "SELECT o_orderkey, CASE WHEN confidence < 0.7 THEN 'custom' ELSE type END AS handler FROM classified",
        "paths",
        extra=CASCADE,
    ),
)
def confidence_gate(spark, sf_dir):
    c = F.col("classification")
    return _classified(spark, sf_dir).select("o_orderkey", k.gate(c["type"], c["confidence"]).alias("handler"))


TYPE_NAMES = ["po", "license", "id", "invoice", "bill", "receipt", "purchase_order", "nda", "lease", "kyc", "visa", "archive", "report", None]


@query(
    "route_lookup",
    oracle(
        f"""
SELECT o_orderkey, t AS type,
       CASE WHEN t IN ('invoice', 'bill', 'receipt', 'purchase_order', 'po') THEN 'invoice'
            WHEN t IN ('agreement', 'contract', 'nda', 'msa', 'sow', 'mou', 'lease') THEN 'agreement'
            WHEN t IN ('kyc', 'passport', 'drivers_license', 'id_card', 'residence_permit', 'visa', 'license', 'id') THEN 'kyc' END
         AS handler,
       CASE WHEN t IN ('archive', 'email', 'pdf_portfolio') THEN 'container'
            WHEN t IN ('invoice', 'bill', 'receipt', 'purchase_order') THEN 'invoice'
            WHEN t IN ('agreement', 'contract', 'nda', 'msa', 'sow', 'mou', 'lease') THEN 'agreement'
            WHEN t IN ('passport', 'drivers_license', 'id_card', 'residence_permit', 'visa') THEN 'kyc'
            WHEN t IN ('document', 'form', 'letter', 'report') THEN 'document' END AS family
FROM (SELECT o_orderkey, ({sql_list(TYPE_NAMES)})[CAST(o_orderkey % {len(TYPE_NAMES)} + 1 AS INTEGER)] AS t FROM orders)"""
    ),
)
def route_lookup(spark, sf_dir):
    names = F.array(*[F.lit(t) for t in TYPE_NAMES])
    kind = F.element_at(names, (F.col("o_orderkey") % len(TYPE_NAMES) + 1).cast("int"))
    rows = inputs.table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("type"))
    return rows.select("o_orderkey", "type", k.route(F.col("type")).alias("handler"), k.type_family(F.col("type")).alias("family"))


@query(
    "type_counts_by_route",
    oracle(
        """
SELECT type, method, count(*) AS n FROM classified GROUP BY type, method""",
        "paths",
        extra=CASCADE,
    ),
)
def type_counts_by_route(spark, sf_dir):
    c = F.col("classification")
    return _classified(spark, sf_dir).groupBy(c["type"].alias("type"), c["method"].alias("method")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "model_responses",
    oracle(
        """
SELECT conv_id, turn, CASE WHEN m IN (0, 1) THEN role END AS type, CASE WHEN m IN (0, 1) THEN (turn % 10) / 10.0::DOUBLE END AS confidence,
       CASE WHEN m = 0 THEN 'f' || turn ELSE '' END AS features
FROM (SELECT *, (conv_id + turn) % 5 AS m FROM conversations)"""
    ),
)
def model_responses(spark, sf_dir):
    """Stored answers: plain JSON, fenced JSON, prose (the whole turn), broken JSON, no confidence."""
    m = (F.col("conv_id") + F.col("turn")) % 5
    turn = F.col("turn").cast("string")
    confidence = ((F.col("turn") % 10) / F.lit(10.0)).cast("string")
    start = F.concat(F.lit('{"type": "'), F.col("role"), F.lit('", "confidence": '), confidence)
    answer = (
        F.when(m == 0, F.concat(F.lit("```json\n"), start, F.lit(', "features": ["f'), turn, F.lit('"]}\n```')))
        .when(m == 1, F.concat(F.lit("  "), start, F.lit("}\n")))
        .when(m == 2, F.col("text"))
        .when(m == 3, F.concat(start, F.lit(', "features": [')))
        .otherwise(F.concat(F.lit('{"type": "'), F.col("role"), F.lit('"}')))
    )
    rows = inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", k.parse_model_response(answer).alias("c"))
    return rows.select(
        "conv_id", "turn", "c.type", "c.confidence", F.coalesce(F.array_join("c.features", ","), F.lit("")).alias("features")
    )


@query(
    "mime_map",
    oracle(
        f"""
SELECT o_orderkey, path, extension, mime_type,
       CASE mime_type WHEN 'application/pdf' THEN 'handle_pdf'
            WHEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' THEN 'handle_docx'
            WHEN 'application/zip' THEN 'handle_zip' WHEN 'message/rfc822' THEN 'handle_email'
            WHEN 'text/html' THEN 'handle_html' WHEN 'application/json' THEN 'handle_json' ELSE 'handle_generic' END AS handler
FROM (SELECT *, CASE lower(extension) WHEN '.pdf' THEN 'application/pdf' WHEN '.zip' THEN 'application/zip'
                WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
                WHEN '.eml' THEN 'message/rfc822' WHEN '.msg' THEN 'application/vnd.ms-outlook'
                WHEN '.json' THEN 'application/json' WHEN '.html' THEN 'text/html' ELSE 'application/octet-stream' END AS mime_type
      FROM (SELECT o_orderkey, path, {SUFFIX} AS extension FROM paths))""",
        "paths",
    ),
)
def mime_map(spark, sf_dir):
    return k.detect_mime(inputs.paths(spark, sf_dir)).drop("hint")


@query(
    "content_samples",
    oracle(
        r"""
SELECT doc_id, CASE WHEN length(regexp_replace(substr(text, 1, 3000), '^\s+|\s+$', '', 'g')) >= 20
                    THEN md5(substr(text, 1, 3000)) END AS sample_md5
FROM documents"""
    ),
)
def content_samples(spark, sf_dir):
    """The sample a classifier is shown (K10): the 3000-character cut is this operator's feature."""
    return inputs.table(spark, sf_dir, "documents").select("doc_id", F.md5(k.content_sample(F.col("text"))).alias("sample_md5"))


@query(
    "extraction_status",
    oracle(
        """
SELECT page_id, md5(CASE WHEN page_id % 3 <> 0 THEN html WHEN page_id % 2 = 0 AND page_id % 5 <> 0 THEN url ELSE '' END) AS text_md5,
       page_id % 3 <> 0 AS processing_success,
       CASE WHEN page_id % 3 <> 0 THEN 'primary' WHEN page_id % 2 = 0 AND page_id % 5 <> 0 THEN 'fallback_ocr' ELSE 'metadata_only' END
         AS extraction_method,
       CASE WHEN page_id % 3 = 0 AND NOT (page_id % 2 = 0 AND page_id % 5 <> 0) THEN 'partial_failure' END AS status,
       CASE WHEN page_id % 3 = 0 THEN 'unreadable ' || page_id END AS primary_error
FROM pages"""
    ),
)
def extraction_status(spark, sf_dir):
    key = F.col("page_id")
    rows = inputs.table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(key % 2 == 0, "application/pdf").otherwise("text/html").alias("mime_type"),
        F.when(key % 3 != 0, F.col("html")).alias("primary"),
        F.when(key % 5 != 0, F.col("url")).alias("ocr"),
        F.concat(F.lit("unreadable "), key.cast("string")).alias("error"),
    )
    out = k.extraction_status(rows, "primary", "ocr", "error")
    return out.select("page_id", F.md5("text").alias("text_md5"), "processing_success", "extraction_method", "status", "primary_error")
