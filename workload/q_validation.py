"""Validation, scoring and aggregate queries (V, G1-G5, G11-G13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from paperloom import schemas
from paperloom.operators import aggregate, scoring, validate
from workload import inputs
from workload.oracle_inputs import oracle
from workload.registry import query

def as_of():
    return F.lit("1998-01-01").cast("date")


def _num(col: str, alias: str | None = None):
    return F.col(col).cast("double").alias(alias or col.split(".")[-1])


def _joined(col: str, alias: str):
    return F.array_join(col, "; ").alias(alias)


def _report_columns(df: DataFrame, *keep) -> DataFrame:
    return df.select(
        *keep,
        "validation.is_valid",
        _joined("validation.errors", "errors"),
        _joined("validation.warnings", "warnings"),
    )


VALIDATED = {
    "checked": """
SELECT *, concat_ws('; ', CASE WHEN invoice_number IS NULL THEN 'Missing invoice number' END,
                          CASE WHEN due_date < invoice_date THEN 'Due date is before invoice date' END) AS errors,
       CASE WHEN subtotal <> 0 AND abs(line_total - subtotal) > 0.01
            THEN 'Line items total (' || regexp_replace(CAST(line_total AS VARCHAR), '0$', '')
                 || ') does not match declared subtotal (' || regexp_replace(CAST(subtotal AS VARCHAR), '0$', '') || ')'
            ELSE '' END AS warnings
FROM inv"""
}


def validated_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate_invoice(inputs.invoices(spark, sf_dir), F.col("line_total"), F.col("n_lines"))


@query(
    "invoice_validation",
    oracle("SELECT path, errors = '' AS is_valid, errors, warnings FROM checked", "inv", extra=VALIDATED),
)
def invoice_validation(spark, sf_dir):
    return _report_columns(validated_invoices(spark, sf_dir), "path")


@query(
    "top_vendors_valid",
    oracle(
        """
SELECT vendor, CAST(sum(total_amount) AS DOUBLE) AS total_amount, count(*) AS n_invoices
FROM checked WHERE errors = '' GROUP BY vendor ORDER BY sum(total_amount) DESC, vendor LIMIT 10""",
        "inv",
        extra=VALIDATED,
    ),
)
def top_vendors_valid(spark, sf_dir):
    """Flagship: validate every invoice, then the ten vendors with the highest valid total."""
    valid = validated_invoices(spark, sf_dir).filter("validation.is_valid")
    return aggregate.top_vendors(valid, 10).select("vendor", _num("total_amount"), "n_invoices")


@query(
    "agreement_validation",
    oracle(
        """
SELECT path, errors = '' AS is_valid, errors, warnings FROM (
  SELECT path, concat_ws('; ', CASE WHEN single_party THEN 'Less than 2 parties identified' END,
                               CASE WHEN expiry_date < effective_date THEN 'Expiry date is before effective date' END)
           AS errors,
         CASE WHEN agreement_type IS NULL THEN 'Agreement type not identified' ELSE '' END AS warnings
  FROM agr)""",
        "agr",
    ),
)
def agreement_validation(spark, sf_dir):
    return _report_columns(validate.validate_agreement(inputs.agreements(spark, sf_dir)), "path")


INVOICE_RULES = [
    {"rule": "line_items_sum_equals_subtotal", "tolerance": "0.02", "error_level": "warning"},
    {"rule": "subtotal_plus_tax_equals_total", "tolerance": "0.01"},
]


@query(
    "rule_checks",
    oracle(
        """
SELECT path, abs(subtotal + tax - total_amount) <= 0.01 AS is_valid,
       CASE WHEN abs(subtotal + tax - total_amount) > 0.01 THEN 'subtotal_plus_tax_equals_total' ELSE '' END AS errors,
       CASE WHEN abs(line_total - subtotal) > 0.02 THEN 'line_items_sum_equals_subtotal' ELSE '' END AS warnings
FROM inv""",
        "inv",
    ),
)
def rule_checks(spark, sf_dir):
    docs = inputs.invoices(spark, sf_dir)
    return _report_columns(
        validate.check_rules(docs, INVOICE_RULES, "invoice", items_total=F.col("line_total")), "path"
    )


def _json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreements as JSON text, with schema faults planted by key."""
    docs = inputs.agreements(spark, sf_dir)
    k = F.col("ord")
    metadata = F.struct(
        F.when(k % 5 == 0, "Lease").otherwise(F.col("metadata.agreement_type")).alias("agreement_type"),
        F.col("metadata.agreement_id").alias("agreement_id"),
        F.when(k % 7 == 0, 1.5).otherwise(0.5).alias("confidence"),
    )
    name = F.transform("parties", lambda p: F.struct(F.when(k % 4 != 0, p["role"]).alias("role"), p["name"].alias("name")))
    body = F.struct(
        F.when(k % 3 == 0, "contract").otherwise("agreement").alias("document_type"),
        F.when(k % 11 != 0, metadata).alias("metadata"),
        name.alias("parties"),
        F.when(k % 13 == 0, F.lit(7)).alias("document_path"),
    )
    return docs.select("path", F.to_json(body).alias("json"))


@query(
    "schema_violations",
    oracle(
        """
SELECT path, errors = '' AND warnings = '' AS is_valid, errors, warnings FROM (
  SELECT path,
    concat_ws('; ', CASE WHEN ord % 11 = 0 THEN '''metadata'' is a required property' END,
                    CASE WHEN ord % 13 = 0 THEN '7 is not of type ''string''' END,
                    CASE WHEN ord % 11 <> 0 AND ord % 5 <> 0 AND agreement_type IS NULL
                         THEN '''agreement_type'' is a required property' END,
                    CASE WHEN ord % 4 = 0 THEN '''role'' is a required property' END,
                    CASE WHEN ord % 4 = 0 AND NOT single_party THEN '''role'' is a required property' END) AS errors,
    concat_ws('; ', CASE WHEN ord % 3 = 0 THEN '''agreement'' was expected' END,
                    CASE WHEN ord % 11 <> 0 AND ord % 5 = 0 THEN '''Lease'' is not one of [''NDA'', ''MSA'', ''SOW'', '
                         || '''SLA'', ''License'', ''Partnership'', ''Employment'', ''Other'']' END,
                    CASE WHEN ord % 11 <> 0 AND ord % 7 = 0 THEN '1.5 is greater than the maximum of 1' END,
                    CASE WHEN single_party THEN '[{"name":"' || vendor || '"'
                         || CASE WHEN ord % 4 <> 0 THEN ',"role":"vendor"' ELSE '' END || '}] is too short' END)
      AS warnings
  FROM agr)""",
        "agr",
    ),
)
def schema_violations(spark, sf_dir):
    return _report_columns(validate.validate_schema(_json_documents(spark, sf_dir), "agreement"), "path")


@query(
    "schema_compliance",
    oracle(
        """
SELECT "group", grouping("group") = 1 AS is_total, count(*) AS documents,
       count(*) FILTER (ok) AS compliant, round(avg(ok::INT), 6) AS schema_compliance
FROM (SELECT CASE WHEN ord % 2 = 0 THEN 'even' ELSE 'odd' END AS "group",
             NOT (ord % 11 = 0 OR ord % 13 = 0 OR (ord % 11 <> 0 AND ord % 5 <> 0 AND agreement_type IS NULL) OR ord % 4 = 0
                       OR ord % 3 = 0 OR (ord % 11 <> 0 AND ord % 5 = 0) OR (ord % 11 <> 0 AND ord % 7 = 0) OR single_party) AS ok FROM agr)
GROUP BY ROLLUP ("group")""",
        "agr",
    ),
)
def schema_compliance(spark, sf_dir):
    checked = validate.validate_schema(_json_documents(spark, sf_dir), "agreement")
    docs = checked.join(inputs.agreements(spark, sf_dir).select("path", (F.col("ord") % 2 == 0).alias("even")), "path")
    named = docs.withColumn("parity", F.when(F.col("even"), "even").otherwise("odd"))
    out = scoring.schema_compliance(named, "parity")
    return out.withColumn("schema_compliance", F.round("schema_compliance", 6))


@query(
    "combined_types",
    oracle(
        """
SELECT p.path, CASE WHEN p.order_key % 2 = 0 THEN 'ZZZ' ELSE p.currency END AS currency, p.vendor,
       CASE WHEN p.order_key % 2 = 0 THEN 'PO-REF-' || p.order_key END AS po_reference,
       'document_type,metadata,vendor,financial,po_reference' AS required
FROM inv p""",
        "inv",
    ),
)
def combined_types(spark, sf_dir):
    parent = inputs.invoices(spark, sf_dir).select(
        "path", "order_key", F.col("financial.currency").alias("currency"), F.col("vendor.name").alias("vendor")
    )
    child = (
        parent.filter("order_key % 2 = 0")
        .select("path", F.concat(F.lit("PO-REF-"), F.col("order_key").cast("string")).alias("po_reference"))
        .withColumn("currency", F.lit("ZZZ"))
    )
    extra = T.StructType().add("po_reference", "string")
    merged, constraints = validate.combine_types(
        parent.drop("order_key"), child, "path", "invoice", (extra, [("", "required", ["po_reference"])])
    )
    required = next(arg for path, kind, arg in constraints if path == "" and kind == "required")
    return merged.select("path", "currency", "vendor", "po_reference").withColumn("required", F.lit(",".join(required)))


@query(
    "total_by_vendor",
    oracle(
        """
SELECT vendor, grouping(vendor) = 1 AS is_total, CAST(sum(total_amount) AS DOUBLE) AS total_amount,
       count(*) AS n_invoices
FROM inv GROUP BY ROLLUP (vendor)""",
        "inv",
    ),
)
def total_by_vendor(spark, sf_dir):
    totals = aggregate.total_by_vendor(inputs.invoices(spark, sf_dir))
    return totals.select("vendor", "is_total", _num("total_amount"), "n_invoices")


@query(
    "top_vendors",
    oracle(
        """
SELECT vendor, CAST(sum(total_amount) AS DOUBLE) AS total_amount, count(*) AS n_invoices
FROM inv GROUP BY vendor ORDER BY sum(total_amount) DESC, vendor LIMIT 5""",
        "inv",
    ),
)
def top_vendors(spark, sf_dir):
    top = aggregate.top_vendors(inputs.invoices(spark, sf_dir), 5)
    return top.select("vendor", _num("total_amount"), "n_invoices")


@query(
    "expiring_contracts",
    oracle(
        """
SELECT path, agreement_id, CAST(expiry_date AS VARCHAR) AS expiry_date FROM agr
WHERE expiry_date BETWEEN DATE '1998-01-01' AND DATE '1998-01-01' + 90""",
        "agr",
    ),
)
def expiring_contracts(spark, sf_dir):
    found = aggregate.expiring(inputs.agreements(spark, sf_dir), as_of())
    return found.select("path", "metadata.agreement_id", F.col("metadata.expiry_date").cast("string").alias("expiry_date"))


@query(
    "batch_summary",
    oracle(
        """
SELECT document_type, grouping(document_type) = 1 AS is_total, count(*) AS total_documents,
       count(*) FILTER (confidence > 0.7) AS successful_extractions
FROM (SELECT coalesce(document_type, 'unknown') AS document_type, confidence FROM scored)
GROUP BY ROLLUP (document_type)""",
        "scored",
    ),
)
def batch_summary(spark, sf_dir):
    return aggregate.summarize(inputs.scored_results(spark, sf_dir))


@query(
    "batch_status",
    oracle(
        """
SELECT count(*) AS processed, count(*) FILTER (confidence > 0.7) AS successful,
       count(*) - count(*) FILTER (confidence > 0.7) AS failed FROM scored""",
        "scored",
    ),
)
def batch_status(spark, sf_dir):
    return aggregate.batch_status(inputs.scored_results(spark, sf_dir))


@query(
    "confidence_histogram",
    oracle(
        """
SELECT CAST(least(floor((doc_id % 101) / 10), 9) AS INTEGER) AS bucket, count(*) AS documents
FROM documents GROUP BY 1"""
    ),
)
def confidence_histogram(spark, sf_dir):
    return aggregate.confidence_histogram(inputs.scored_results(spark, sf_dir))


@query(
    "ops_metrics",
    oracle(
        """
SELECT count(*) AS documents, round(avg(duration_ms), 6) AS mean_duration_ms,
       CAST(quantile_disc(duration_ms, 0.95) AS BIGINT) AS p95_duration_ms, round(avg(confidence), 6) AS mean_confidence,
       round(avg(CAST(failed AS INTEGER)), 6) AS error_rate, round(avg(CAST(cache_hit AS INTEGER)), 6) AS cache_hit_rate
FROM scored""",
        "scored",
    ),
)
def ops_metrics(spark, sf_dir):
    m = aggregate.ops_metrics(inputs.scored_results(spark, sf_dir))
    rounded = ["mean_duration_ms", "mean_confidence", "error_rate", "cache_hit_rate"]
    return m.select("documents", "p95_duration_ms", *[F.round(c, 6).alias(c) for c in rounded])


@query(
    "best_attempt",
    oracle(
        """
SELECT doc_id, attempt, confidence, value FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, attempt) AS rn FROM attempts)
WHERE rn = 1""",
        "attempts",
    ),
)
def best_attempt(spark, sf_dir):
    return aggregate.best_attempt(inputs.attempts(spark, sf_dir)).select("doc_id", "attempt", "confidence", "value")


@query(
    "merge_partial",
    oracle(
        """
SELECT doc_id, max(CASE WHEN field = 'number' THEN value END) AS number,
       max(CASE WHEN field = 'vendor' THEN value END) AS vendor, max(CASE WHEN field = 'total' THEN value END) AS total,
       count(value) < 3 AS partial
FROM (SELECT doc_id, NULL AS field, NULL AS value FROM documents
      UNION ALL
      SELECT doc_id, field, value FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, attempt) AS rn
        FROM attempt_fields WHERE confidence >= 0.3 AND value IS NOT NULL) WHERE rn = 1)
GROUP BY doc_id""",
        "attempt_fields",
    ),
)
def merge_partial(spark, sf_dir):
    merged = aggregate.merge_partial(inputs.attempt_fields(spark, sf_dir), inputs.FIELDS)
    return merged.select("doc_id", *[F.col("fields")[f].alias(f) for f in inputs.FIELDS], "partial")


@query(
    "quality_score",
    oracle(
        """
SELECT path, round(completeness, 6) AS completeness, round(consistency, 6) AS consistency,
       round(0.3 * completeness + 0.3 * consistency + 0.4 * confidence, 6) AS quality,
       round(0.3 * completeness + 0.3 * consistency + 0.4 * confidence, 6) < 0.5 AS alert FROM (
  SELECT path, confidence,
    ((invoice_number IS NOT NULL)::INT + 1 + 1 + 1 + (currency IS NOT NULL)::INT + (po_number IS NOT NULL)::INT) / 6.0::DOUBLE
      AS completeness,
    ((abs(line_total - subtotal) <= 0.01)::INT + (due_date >= invoice_date)::INT
      + (abs(subtotal + tax - total_amount) <= 0.01)::INT) / 3.0::DOUBLE AS consistency
  FROM inv)""",
        "inv",
    ),
)
def quality_score(spark, sf_dir):
    docs = inputs.invoices(spark, sf_dir)
    required = ["metadata.invoice_number", "metadata.invoice_date", "vendor.name", "financial.total_amount",
                "financial.currency", "metadata.po_number"]
    checks = [
        F.abs(validate.rule_gap("line_items_sum_equals_subtotal", "invoice", F.col("line_total"))) <= F.lit("0.01").cast("decimal(18,2)"),
        F.col("metadata.due_date") >= F.col("metadata.invoice_date"),
        F.abs(validate.rule_gap("subtotal_plus_tax_equals_total", "invoice")) <= F.lit("0.01").cast("decimal(18,2)"),
    ]
    scored = docs.select(
        "path",
        scoring.completeness([F.col(c) for c in required]).alias("completeness"),
        scoring.consistency(checks).alias("consistency"),
        F.col("metadata.confidence").alias("confidence"),
    )
    out = scoring.quality(scored)
    return out.select(
        "path", F.round("completeness", 6).alias("completeness"), F.round("consistency", 6).alias("consistency"),
        "quality", "alert",
    )


@query(
    "field_confidence",
    oracle(
        """
SELECT doc_id, attempt, round((2 * max(CASE WHEN field = 'number' THEN confidence END) +
                      max(CASE WHEN field = 'vendor' THEN confidence END) +
                      max(CASE WHEN field = 'total' THEN confidence END)) / 4, 6) AS confidence
FROM attempt_fields GROUP BY doc_id, attempt""",
        "attempt_fields",
    ),
)
def field_confidence(spark, sf_dir):
    fields = inputs.attempt_fields(spark, sf_dir)
    maps = fields.groupBy("doc_id", "attempt").agg(F.map_from_entries(F.collect_list(F.struct("field", "confidence"))).alias("m"))
    return maps.select("doc_id", "attempt", F.round(scoring.confidence(F.col("m"), {"number": 2.0}), 6).alias("confidence"))


@query(
    "accuracy",
    oracle(
        """
SELECT field, grouping(field) = 1 AS is_total, count(*) AS n, sum(hit) AS n_correct, round(avg(hit), 6) AS accuracy
FROM (
  SELECT 'quality' AS field, (quality IS NOT DISTINCT FROM CASE WHEN n_chars % 7 <> 0 THEN (n_chars > 1000)::INT END)::INT AS hit
  FROM labels LEFT JOIN documents USING (doc_id)
  UNION ALL
  SELECT 'toxic', (toxic IS NOT DISTINCT FROM (n_chars % 5 = 0)::INT)::INT FROM labels LEFT JOIN documents USING (doc_id))
GROUP BY ROLLUP (field)"""
    ),
)
def accuracy(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    predicted = docs.select(
        "doc_id",
        F.when(F.col("n_chars") % 7 != 0, (F.col("n_chars") > 1000).cast("int")).alias("quality"),
        (F.col("n_chars") % 5 == 0).cast("int").alias("toxic"),
    )
    out = scoring.evaluate(predicted, inputs.table(spark, sf_dir, "labels"), ["quality", "toxic"])
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "kyc_expiry",
    oracle(
        """
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'unknown'
                       WHEN DATE '1990-01-01' + CAST(c_custkey * 53 % 6000 AS INTEGER) < DATE '1998-01-01' THEN 'expired'
                       ELSE 'valid' END AS expiry_status
FROM customer"""
    ),
)
def kyc_expiry(spark, sf_dir):
    key = F.col("c_custkey")
    expiry = F.date_add(F.lit("1990-01-01").cast("date"), (key * 53 % 6000).cast("int"))
    docs = inputs.table(spark, sf_dir, "customer").select(
        "c_custkey", F.struct(F.when(key % 9 != 0, expiry).alias("expiry_date")).alias("metadata")
    )
    return scoring.kyc_expiry(docs, as_of()).select("c_custkey", "expiry_status")


@query(
    "tax_id_validator",
    oracle(
        r"""
SELECT c_custkey, regexp_full_match(raw, '[0-9]{2}-?[0-9]{7}') AS tax_id_valid,
       CASE WHEN regexp_full_match(raw, '[0-9]{2}-?[0-9]{7}')
            THEN substr(replace(raw, '-', ''), 1, 2) || '-' || substr(replace(raw, '-', ''), 3) END AS tax_id_formatted
FROM (SELECT c_custkey, lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE '' END
             || lpad(CAST(c_custkey % 10000000 AS VARCHAR), CASE WHEN c_custkey % 8 = 0 THEN 6 ELSE 7 END, '0') AS raw
      FROM customer)"""
    ),
)
def tax_id_validator(spark, sf_dir):
    """A user validator written as SQL functions, which Catalyst inlines into the projection."""
    validate.register_validator(spark, "tax_id_ok", "x STRING", "BOOLEAN", "x RLIKE '^[0-9]{2}-?[0-9]{7}$'")
    text = "CASE WHEN tax_id_ok(x) THEN concat(left(replace(x, '-', ''), 2), '-', substr(replace(x, '-', ''), 3)) END"
    validate.register_validator(spark, "tax_id_text", "x STRING", "STRING", text)
    key = F.col("c_custkey")
    raw = F.concat(
        F.lpad((key % 100).cast("string"), 2, "0"),
        F.when(key % 3 == 0, "-").otherwise(""),
        F.when(key % 8 == 0, F.lpad((key % 10_000_000).cast("string"), 6, "0")).otherwise(
            F.lpad((key % 10_000_000).cast("string"), 7, "0")
        ),
    )
    docs = inputs.table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    checked = validate.apply_validator(docs, "tax_id", F.expr("tax_id_ok(raw)"), F.expr("tax_id_text(raw)"))
    return checked.drop("raw")


@query("known_types", oracle("SELECT t AS document_type FROM (SELECT DISTINCT document_type AS t FROM scored UNION SELECT unnest(['invoice', 'agreement', 'kyc', 'receipt'])) WHERE t IS NOT NULL ORDER BY 1", "scored"))
def known_types(spark, sf_dir):
    """Sorted distinct types: those with a schema and those seen in results (O1)."""
    seen = inputs.scored_results(spark, sf_dir).select("document_type").distinct()
    named = seen.select(F.explode(F.array(*[F.lit(t) for t in schemas.known_types()])).alias("document_type"))
    return seen.unionByName(named).filter("document_type IS NOT NULL").distinct().orderBy("document_type")
