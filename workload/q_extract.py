"""Extraction and layout queries (X1-X25). Oracles take the values from the tables, not from the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import extract, layout
from workload import inputs
from workload.oracle_inputs import oracle
from workload.registry import query

LINE = {
    "li": """
SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_shipdate AS DATE) AS d,
       CASE l_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS cur
FROM lineitem"""
}
ID = "'INV-' || k || '-' || n || '-' || s"


def _num(c):
    return c.cast("double")


def _texts(spark, sf_dir):
    docs = inputs.invoice_texts(spark, sf_dir)
    return docs.withColumn("id", F.concat_ws("-", F.lit("INV"), F.col("k").cast("string"), F.col("n").cast("string"), F.col("s").cast("string")))


@query(
    "invoice_fields",
    oracle(
        f"""
SELECT {ID} AS invoice_number, CAST(d AS VARCHAR) AS invoice_date, CAST(d + 30 AS VARCHAR) AS due_date,
       CASE WHEN k % 5 <> 0 THEN 'PO-' || k END AS po_number, 'Supplier#' || lpad(CAST(s AS VARCHAR), 9, '0') AS vendor,
       '12-' || lpad(CAST(s AS VARCHAR), 7, '0') AS tax_id, CASE WHEN k % 11 <> 0 THEN 'Customer of order ' || k END AS customer,
       (c + 1250) / 100.0::DOUBLE AS subtotal, (c * 7 // 100) / 100.0::DOUBLE AS tax, (k % 90)::DOUBLE AS shipping,
       (c + 1250 + c * 7 // 100 + k % 90 * 100) / 100.0::DOUBLE AS total_amount, cur AS currency,
       CASE k % 4 WHEN 0 THEN '2% 10 net 30' WHEN 1 THEN 'Net 45' END AS terms,
       CASE WHEN k % 4 = 0 THEN 2.0::DOUBLE END AS discount_percentage, CASE WHEN k % 4 = 0 THEN 10.0::DOUBLE END AS discount_days,
       2 AS n_items, (c + 1250) / 100.0::DOUBLE AS items_total, CASE WHEN k % 9 < 2 THEN -3.0::DOUBLE END AS discount,
       CASE WHEN k % 11 <> 0 THEN 1.0::DOUBLE ELSE 5 / 6.0::DOUBLE END AS confidence
FROM li""",
        extra=LINE,
    ),
)
def invoice_fields(spark, sf_dir):
    out = extract.extract_invoice(_texts(spark, sf_dir)).select("invoice.*")
    money = {c: _num(F.col(f"financial.{c}")) for c in ("subtotal", "tax", "shipping", "total_amount", "discount")}
    return out.select(
        "metadata.invoice_number",
        F.col("metadata.invoice_date").cast("string").alias("invoice_date"),
        F.col("metadata.due_date").cast("string").alias("due_date"),
        "metadata.po_number",
        "metadata.confidence",
        F.col("vendor.name").alias("vendor"),
        "vendor.tax_id",
        F.col("customer.name").alias("customer"),
        *[c.alias(n) for n, c in money.items()],
        "financial.currency",
        "payment_terms.terms",
        F.col("payment_terms.early_payment_discount.percentage").alias("discount_percentage"),
        F.col("payment_terms.early_payment_discount.days").alias("discount_days"),
        F.size("line_items").alias("n_items"),
        _num(F.aggregate("line_items", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["amount"]).cast("decimal(28,2)"))).alias("items_total"),
    )


@query(
    "line_items",
    oracle(
        f"""
SELECT {ID} AS id, 1 AS position, '1' AS item_number, 'Part ' || p AS description, q::DOUBLE AS quantity,
       (c // q) / 100.0::DOUBLE AS unit_price, c / 100.0::DOUBLE AS amount, CASE WHEN k % 2 = 0 THEN 7.0::DOUBLE END AS tax_rate FROM li
UNION ALL SELECT {ID}, 2, '2', 'Handling', 1.0, 12.5, 12.5, CASE WHEN k % 2 = 0 THEN 7.0 END FROM li""",
        extra=LINE,
    ),
)
def line_items(spark, sf_dir):
    out = extract.extract_line_items(_texts(spark, sf_dir), "text", "id")
    return out.select("id", "position", "item_number", "description", "quantity", _num(F.col("unit_price")).alias("unit_price"), _num(F.col("amount")).alias("amount"), "tax_rate")


@query(
    "iso_dates",
    oracle(f"SELECT {ID} AS id, CAST(d AS VARCHAR) || ',' || CAST(d + 30 AS VARCHAR) AS dates FROM li", extra=LINE),
)
def iso_dates(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", F.array_join(tx.iso_dates(F.col("text")), ",").alias("dates"))


@query(
    "payment_terms",
    oracle(
        f"""
SELECT {ID} AS id, CASE WHEN k % 4 = 0 THEN 2.0::DOUBLE END AS percentage, CASE WHEN k % 4 = 0 THEN 10 END AS days,
       CASE k % 4 WHEN 0 THEN 30 WHEN 1 THEN 45 END AS net_days FROM li""",
        extra=LINE,
    ),
)
def payment_terms(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", tx.payment_terms(F.col("text")).alias("t")).select("id", "t.*")


@query(
    "tax_and_charges",
    oracle(
        f"SELECT {ID} AS id, 7.0::DOUBLE AS tax_rate, (k % 90)::DOUBLE AS shipping, CASE WHEN k % 6 = 0 THEN 5.0::DOUBLE END AS credit FROM li",
        extra=LINE,
    ),
)
def tax_and_charges(spark, sf_dir):
    t = F.col("text")
    return _texts(spark, sf_dir).select(
        "id",
        F.get(tx.tax_rates(t), F.lit(0)).alias("tax_rate"),
        _num(F.get(tx.shipping_charges(t), F.lit(0))).alias("shipping"),
        _num(F.get(tx.credit_adjustments(t), F.lit(0))).alias("credit"),
    )


@query(
    "money_mentions",
    oracle(
        f"""
SELECT id, pos, cur AS currency, v / 100.0::DOUBLE AS amount FROM (
  SELECT {ID} AS id, cur, unnest(vs) AS v, unnest(range(1, len(vs) + 1)) AS pos FROM (
    SELECT *, list_filter([c + 1250, c * 7 // 100, k % 90 * 100, CASE WHEN k % 6 = 0 THEN 500 END,
                           c + 1250 + c * 7 // 100 + k % 90 * 100], lambda x: x IS NOT NULL) AS vs FROM li))""",
        extra=LINE,
    ),
)
def money_mentions(spark, sf_dir):
    out = _texts(spark, sf_dir).select("id", F.posexplode(tx.money_mentions(F.col("text"))).alias("i", "m"))
    return out.select("id", (F.col("i") + 1).alias("pos"), "m.currency", _num(F.col("m.amount")).alias("amount"))


@query(
    "signed_money",
    oracle(
        """
SELECT doc_id, pos, currency, amount FROM (
  SELECT doc_id, unnest(range(1, 11)) AS pos,
         unnest(['USD', 'USD', 'EUR', 'EUR', 'GBP', 'USD', 'EUR', 'USD', 'USD', 'GBP']) AS currency,
         unnest([-v, -v, v, -v, -v, v, 10000 * v, 3, -v, v]) AS amount
  FROM (SELECT doc_id, (doc_id % 900 + 100) / 1.0::DOUBLE + 0.25 AS v FROM documents))"""
    ),
)
def signed_money(spark, sf_dir):
    """Amounts with a sign, in brackets, or with the currency behind them, after each document's own text."""
    docs = inputs.table(spark, sf_dir, "documents")
    v = F.concat((F.col("doc_id") % 900 + 100).cast("string"), F.lit(".25"))
    comma = F.translate(v, ".", ",")
    said = F.concat(
        F.lit("\nRefund -$"), v, F.lit(", credit USD "), v, F.lit("-; paid "), comma, F.lit(" EUR\nand -"), comma, F.lit(" €, lost ("),
        F.lit("£"), v, F.lit("), (see $"), v, F.lit("), up to "),
        F.concat(F.translate(F.format_number((F.col("doc_id") % 900 + 100) * 10000 + 2500, 0), ",", "."), F.lit(",00 EUR")),
        F.lit("; a range $3-9; lot 7 USD -"), v, F.lit(" net; a-GBP"), v, F.lit("."),
    )
    own = F.size(tx.money_mentions(F.col("text")))
    found = docs.select("doc_id", own.alias("own"), tx.money_mentions(F.concat("text", said)).alias("m"))
    rows = found.select("doc_id", "own", F.posexplode("m").alias("i", "m")).filter("i >= own")
    return rows.select("doc_id", (F.col("i") - F.col("own") + 1).alias("pos"), "m.currency", _num(F.col("m.amount")).alias("amount"))


@query("compliance", oracle(f"SELECT {ID} AS id, CASE WHEN k % 7 = 0 THEN 'GDPR,SOX' ELSE '' END AS mentions FROM li", extra=LINE))
def compliance(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", F.array_join(tx.compliance_mentions(F.col("text")), ",").alias("mentions"))


@query(
    "extended_fields",
    oracle(
        f"""
SELECT {ID} AS id, CASE WHEN k % 5 <> 0 THEN 'PO-' || k END AS po_reference,
       CASE WHEN k % 4 = 0 THEN '2% 10 net 30' END AS early_payment_discount, (k % 90) || CASE WHEN k % 5 = 1 THEN ',00' ELSE '.00' END AS shipping_charges,
       CASE WHEN k % 6 = 0 THEN CASE WHEN k % 5 = 1 THEN '5,00' ELSE '5.00' END END AS credit_adjustments FROM li""",
        extra=LINE,
    ),
)
def extended_fields(spark, sf_dir):
    names = [r["name"] for r in extract.INVOICE_EXTENSION]
    out = extract.extend_type(_texts(spark, sf_dir), extract.INVOICE_EXTENSION, names)
    return out.select("id", *[F.col("custom_extractions")[n].alias(n) for n in names])


@query(
    "finalized_receipts",
    oracle("SELECT o_orderkey AS k, 'USD' AS currency FROM orders"),
)
def finalized_receipts(spark, sf_dir):
    """Receipts whose total names no currency get the default."""
    texts = inputs.receipt_texts(spark, sf_dir).withColumn("text", F.replace("text", F.lit("$"), F.lit("")))
    out = extract.finalize(extract.extract_receipt(texts).select("k", "receipt.*"))
    return out.select("k", "totals.currency")


@query(
    "finalized_invoices",
    oracle("SELECT path, coalesce(currency, 'USD') AS currency, '2024-01-31' AS stamped FROM inv", "inv"),
)
def finalized_invoices(spark, sf_dir):
    out = extract.finalize(inputs.invoices(spark, sf_dir), F.lit("2024-01-31").cast("timestamp"))
    return out.select("path", "financial.currency", F.date_format("extraction_timestamp", "yyyy-MM-dd").alias("stamped"))


RULES = [
    {"name": "email", "scope": "global", "pattern": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z]+"},
    {"name": "number", "scope": "global", "pattern": r"[0-9]{6,}"},
    {"name": "number", "scope": "fr", "pattern": r"[0-9]{1,5}"},
    {"name": "number", "scope": "de", "level": "field", "pattern": r"[0-9]+\.[0-9]+"},
    {"name": "license", "scope": "en", "pattern": r"(?i)licensed? [a-z]+ "},
]


@query(
    "custom_rules",
    oracle(
        r"""
SELECT doc_id, array_to_string(list_sort(list_distinct(email)), '; ') AS email,
       array_to_string(list_sort(list_distinct(CASE WHEN len(special) > 0 THEN special ELSE general END)), '; ') AS number,
       array_to_string(list_sort(list_distinct(lic)), '; ') AS license
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z]+') AS email,
             regexp_extract_all(text, '[0-9]{6,}') AS general,
             CASE lang WHEN 'fr' THEN regexp_extract_all(text, '[0-9]{1,5}') WHEN 'de' THEN regexp_extract_all(text, '[0-9]+\.[0-9]+')
                       ELSE [] END AS special,
             CASE WHEN lang = 'en' THEN regexp_extract_all(text, '(?i)licensed? [a-z]+ ') ELSE [] END AS lic
      FROM documents)"""
    ),
)
def custom_rules(spark, sf_dir):
    """Global and per-type rules over the real texts, with the language in the role of the type."""
    docs = inputs.spread(inputs.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("document_type")))
    out = extract.apply_rules(docs, RULES)
    shown = lambda n: F.coalesce(F.array_join(F.array_sort(F.split(F.col("custom_extractions")[n], "; ")), "; "), F.lit(""))
    return out.select("doc_id", *[shown(n).alias(n) for n in ("email", "number", "license")])


# --- agreements --------------------------------------------------------------------------------


@query(
    "agreement_fields",
    oracle(
        """
SELECT path, agreement_type, agreement_id, CAST(effective_date AS VARCHAR) AS effective_date,
       CAST(expiry_date AS VARCHAR) AS expiry_date, (1 + ord % 3) || ' years' AS term_duration,
       365 * (1 + ord % 3) AS term_days,
       CASE WHEN single_party THEN 'vendor=' || vendor ELSE 'vendor=' || vendor || ';client=' || client END AS parties,
       'supply of lot ' || ord AS scope, 'deliver lot ' || ord || '|the fifth of each month' AS obligation,
       'Agent of ' || vendor || '|' || CAST(effective_date AS VARCHAR) AS signature, ord % 5 = 0 AS auto_renewal,
       CASE WHEN ord % 5 = 0 THEN '12 months' END AS renewal_period,
       CASE ord % 5 WHEN 0 THEN (30 + ord % 60) || ' days' WHEN 1 THEN '2 months' END AS renewal_notice_period,
       CASE WHEN ord % 2 = 0 THEN 'late delivery' WHEN ord % 3 = 0 THEN 'breach' END AS penalty_condition,
       ord || ' Dock Road|R. Agent|Director' AS vendor_contact
FROM agr""",
        "agr",
    ),
)
def agreement_fields(spark, sf_dir):
    out = extract.extract_agreement(inputs.agreement_texts(spark, sf_dir)).select("path", "agreement.*")
    return out.select(
        "path",
        "metadata.agreement_type",
        "metadata.agreement_id",
        F.col("metadata.effective_date").cast("string").alias("effective_date"),
        F.col("metadata.expiry_date").cast("string").alias("expiry_date"),
        "metadata.term_duration",
        tx.duration_days(F.col("metadata.term_duration")).alias("term_days"),
        F.array_join(F.transform("parties", lambda p: F.concat(p["role"], F.lit("="), p["name"])), ";").alias("parties"),
        "key_terms.scope",
        F.concat_ws("|", F.col("obligations")[0]["obligation"], F.col("obligations")[0]["deadline"]).alias("obligation"),
        F.concat_ws("|", F.col("signatures")[0]["signatory"], F.col("signatures")[0]["date"].cast("string")).alias("signature"),
        "renewal_terms.auto_renewal",
        "renewal_terms.renewal_period",
        "renewal_terms.renewal_notice_period",
        F.get("penalties", F.lit(0))["condition"].alias("penalty_condition"),
        F.concat_ws("|", *[F.col("parties")[0][c] for c in ("address", "representative", "title")]).alias("vendor_contact"),
    )


CLAUSES = {
    "present": """
SELECT path, ord, unnest([1, CASE WHEN ord % 2 = 0 THEN 2 END, CASE WHEN ord % 3 = 0 THEN 3 END,
                          CASE WHEN ord % 5 IN (0, 1) THEN 4 END, CASE WHEN ord % 4 = 0 THEN 5 END,
                          CASE WHEN ord % 6 = 0 THEN 6 END, 7]) AS slot FROM agr""",
    "numbered": "SELECT path, ord, slot, row_number() OVER (PARTITION BY path ORDER BY slot) AS paragraph FROM present WHERE slot IS NOT NULL",
    "clause_rows": """
SELECT path, ord, paragraph, unnest(CASE WHEN slot = 2 THEN ['penalty'] WHEN slot = 3 THEN ['penalty', 'liquidated_damages']
    WHEN slot = 4 AND ord % 5 = 0 THEN ['renewal', 'auto-renewal'] WHEN slot = 4 THEN ['renewal']
    WHEN slot = 5 THEN ['termination', 'liability'] ELSE [] END) AS clause_type
FROM numbered""",
}


@query("clauses", oracle("SELECT path, paragraph, clause_type FROM clause_rows", "agr", extra=CLAUSES))
def clauses(spark, sf_dir):
    return extract.extract_clauses(inputs.agreement_texts(spark, sf_dir), extract.CLAUSE_RULES, "text", "path").drop("clause")


@query(
    "penalty_clauses",
    oracle(
        """
SELECT path, paragraph, clause_type,
       CASE WHEN ord % 2 = 0 AND paragraph = 2 THEN 'A penalty of ' || (ord % 10) || '% applies to late delivery.'
            ELSE 'Liquidated damages are payable on breach and count as a penalty.' END AS clause
FROM clause_rows WHERE clause_type IN ('penalty', 'liquidated_damages')""",
        "agr",
        extra=CLAUSES,
    ),
)
def penalty_clauses(spark, sf_dir):
    return extract.penalty_clauses(inputs.agreement_texts(spark, sf_dir), "text", "path")


@query(
    "renewal_terms",
    oracle(
        """
SELECT path, ord % 5 IN (0, 1) AS has_renewal, ord % 5 = 0 AS auto_renewal,
       CASE ord % 5 WHEN 0 THEN 30 + ord % 60 WHEN 1 THEN 60 END AS notice_days FROM agr""",
        "agr",
    ),
)
def renewal_terms(spark, sf_dir):
    return extract.renewal_terms(inputs.agreement_texts(spark, sf_dir)).select("path", "renewal.*")


# --- identity documents, receipts, medical codes -------------------------------------------------

PERSON = {
    "person": """
SELECT c_custkey AS k, 'NAME' || translate(CAST(c_custkey % 1000 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS surname,
       'GIVEN' || translate(CAST(c_nationkey AS VARCHAR), '0123456789', 'KLMNOPQRST') AS given,
       'P' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS number,
       DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INTEGER) AS born,
       DATE '2024-01-01' + CAST(c_custkey * 11 % 4000 AS INTEGER) AS expires,
       CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END AS sex
FROM customer"""
}


@query(
    "kyc_fields",
    oracle(
        """
SELECT number AS document_id, 'passport' AS document_subtype, CAST(expires AS VARCHAR) AS expiry_date,
       upper(given[1]) || lower(given[2:]) || ' B ' || upper(surname[1]) || lower(surname[2:]) AS full_name,
       upper(surname[1]) || lower(surname[2:]) AS last_name, CAST(born AS VARCHAR) AS date_of_birth, sex AS gender,
       'Utopia' AS issuing_country, number AS zone_number, 'B' AS middle_name,
       (k % 200) || ' Long Street, Port' || CASE WHEN k % 2 = 0 THEN ', UT 12345, Utopia' ELSE '' END AS full_address,
       (k % 200) || ' Long Street' AS street, 'Port' AS city, CASE WHEN k % 2 = 0 THEN 'UT' END AS state,
       CASE WHEN k % 2 = 0 THEN '12345' END AS postal_code, CASE WHEN k % 2 = 0 THEN 'Utopia' END AS country,
       CASE WHEN k % 3 = 0 THEN 'crew|diplomat' ELSE '' END AS endorsements, 0 AS n_restrictions,
       CASE WHEN k % 5 = 0 THEN true END AS signed, 1.0::DOUBLE AS confidence
FROM person""",
        extra=PERSON,
    ),
)
def kyc_fields(spark, sf_dir):
    out = extract.extract_kyc(inputs.identity_texts(spark, sf_dir)).select("kyc.*")
    return out.select(
        "metadata.document_id",
        "metadata.document_subtype",
        F.col("metadata.expiry_date").cast("string").alias("expiry_date"),
        "personal_info.full_name",
        "personal_info.last_name",
        F.col("personal_info.date_of_birth").cast("string").alias("date_of_birth"),
        "personal_info.gender",
        "metadata.issuing_country",
        F.col("verification.mrz_data.document_number").alias("zone_number"),
        "personal_info.middle_name",
        *[f"address.{c}" for c in ("full_address", "street", "city", "state", "postal_code", "country")],
        F.coalesce(F.array_join("additional_info.endorsements", "|"), F.lit("")).alias("endorsements"),
        F.size("additional_info.restrictions").alias("n_restrictions"),
        F.col("additional_info.document_holder_signature").alias("signed"),
        "metadata.confidence",
    )


@query(
    "mrz_fields",
    oracle(
        """
SELECT 'P' AS document_type, 'UTO' AS issuing_country, surname, given || ' B' AS given_names, number AS document_number,
       'UTO' AS nationality,
       CASE WHEN year(born) % 100 > 30 THEN '19' ELSE '20' END || strftime(born, '%y-%m-%d') AS date_of_birth,
       CASE WHEN sex <> 'X' THEN sex END AS sex, '20' || strftime(expires, '%y-%m-%d') AS expiry_date,
       CAST(k % 5000 AS VARCHAR) AS personal_number
FROM person""",
        extra=PERSON,
    ),
)
def mrz_fields(spark, sf_dir):
    return extract.extract_kyc(inputs.identity_texts(spark, sf_dir)).select("kyc.verification.mrz_data.*")


@query(
    "receipt_fields",
    oracle(
        """
SELECT 'R-' || k AS receipt_number, 'Shop ' || (k % 50) AS store, 'S' || (k % 50) AS store_id, CAST(d AS VARCHAR) AS date,
       lpad(CAST((k % 12 + 1) % 12 + CASE WHEN k % 2 = 0 THEN 12 ELSE 0 END AS VARCHAR), 2, '0') || ':' ||
         lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ':00' AS time,
       'C' || (k % 9) AS cashier, 'SKU' || (k % 300) AS sku, c / 100.0::DOUBLE AS subtotal, (c // 10) / 100.0::DOUBLE AS tax,
       (c + c // 10) / 100.0::DOUBLE AS total, 'USD' AS currency, CASE WHEN k % 2 = 0 THEN 'credit' ELSE 'cash' END AS method,
       CASE WHEN k % 2 = 0 THEN lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS card_last_four, 'M' || m AS member_id,
       (k % 77)::DOUBLE AS points_earned, CASE WHEN k % 3 = 0 THEN 'State 6.0 6.0;City 4.5 4.5;' ELSE '' END || 'Tax 10.0 ' || (c // 10) / 100.0::DOUBLE AS tax_breakdown,
       CASE k % 5 WHEN 0 THEN 'SAVE5/spring offer/5.0' WHEN 1 THEN 'a bag for free' END AS promotion,
       CASE WHEN k % 4 = 0 THEN 0.5::DOUBLE END AS line_discount, 1.0::DOUBLE AS confidence
FROM (SELECT o_orderkey AS k, o_custkey AS m, CAST(o_orderdate AS DATE) AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)"""
    ),
)
def receipt_fields(spark, sf_dir):
    out = extract.extract_receipt(inputs.receipt_texts(spark, sf_dir)).select("receipt.*")
    return out.select(
        "transaction.receipt_number",
        F.col("store.name").alias("store"),
        "store.store_id",
        F.col("transaction.date").cast("string").alias("date"),
        "transaction.time",
        "transaction.cashier",
        F.col("line_items")[0]["sku"].alias("sku"),
        *[_num(F.col(f"totals.{c}")).alias(c) for c in ("subtotal", "tax", "total")],
        "totals.currency",
        "payment.method",
        "payment.card_last_four",
        "loyalty.member_id",
        "loyalty.points_earned",
        F.array_join(
            F.transform("totals.tax_breakdown", lambda x: F.concat_ws(" ", x["type"], x["rate"].cast("string"), _num(x["amount"]).cast("string"))), ";"
        ).alias("tax_breakdown"),
        F.array_join(
            F.transform("promotions", lambda p: F.concat_ws("/", p["code"], p["description"], _num(p["discount"]).cast("string"))), ";"
        ).alias("_offers"),
        _num(F.col("line_items")[0]["discount"]).alias("line_discount"),
        "metadata.confidence",
    ).withColumn("promotion", F.nullif("_offers", F.lit(""))).drop("_offers")


@query(
    "medical_codes",
    oracle(
        """
SELECT doc_id, system, code, mentions, p_name AS description FROM (
  SELECT o_orderkey AS doc_id, 'ICD-10' AS system, 'E' || (o_orderkey % 90 + 10) || '.9' AS code, 1 AS mentions FROM orders
  UNION ALL SELECT o_orderkey, 'ICD-10', 'I10', 1 FROM orders
  UNION ALL SELECT o_orderkey, 'CPT', CAST(10000 + o_orderkey % 2500 AS VARCHAR), 2 FROM orders
  UNION ALL SELECT o_orderkey, 'CPT', CAST(10000 + (o_orderkey + 7) % 2500 AS VARCHAR), 1 FROM orders)
LEFT JOIN part ON system = 'CPT' AND code = CAST(10000 + p_partkey AS VARCHAR)"""
    ),
)
def medical_codes(spark, sf_dir):
    return extract.medical_code_counts(inputs.medical_texts(spark, sf_dir), inputs.medical_codes(spark, sf_dir))


# --- layout --------------------------------------------------------------------------------------


@query(
    "page_rollup",
    oracle(
        r"""
SELECT doc_id, md5(text || chr(10)) AS text_md5, len(lines) AS page_count,
       len(list_filter(range(0, len(lines)), lambda i: (doc_id + i) % 10 = 0)) > 0 AS has_images,
       length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 100 AS has_embedded_text,
       CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 100 THEN 'native_text' ELSE 'ocr_required' END AS extraction_method
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)"""
    ),
)
def page_rollup(spark, sf_dir):
    docs = layout.scanned_flag(layout.rollup_pages(inputs.text_pages(spark, sf_dir)))
    return docs.select("doc_id", F.md5("text").alias("text_md5"), "page_count", "has_images", "has_embedded_text", "extraction_method")


TOKENS = {
    "tok": r"""
SELECT doc_id, unnest(w) AS token, unnest(range(0, len(w))) AS position
FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]') AS w FROM documents)"""
}


@query(
    "ocr_rollup",
    oracle(
        """
SELECT doc_id, round(coalesce(avg(CASE WHEN position % 101 - 1 > 0 THEN position % 101 - 1 END) / 100, 0.0), 6) AS confidence,
       count(*) FILTER (trim(token) <> '') AS block_count
FROM tok GROUP BY doc_id""",
        extra=TOKENS,
    ),
)
def ocr_rollup(spark, sf_dir):
    return layout.rollup_ocr(inputs.ocr_tokens(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(
    "ocr_blocks",
    oracle(
        """
SELECT doc_id, position, token AS text, (position % 101 - 1) / 100.0::DOUBLE AS confidence, position % 20 * 50 AS x
FROM tok WHERE trim(token) <> ''""",
        extra=TOKENS,
    ),
)
def ocr_blocks(spark, sf_dir):
    out = layout.ocr_blocks(inputs.ocr_tokens(spark, sf_dir))
    return out.select("doc_id", "position", "text", "confidence", "box.x")


GRID = {
    "grid": """
SELECT o_orderkey AS table_id, r AS row, c AS column, h AS header,
       CASE c WHEN 0 THEN o_orderkey || '/' || r WHEN 1 THEN o_orderstatus ELSE o_orderpriority END AS value
FROM orders CROSS JOIN (VALUES (1), (2)) AS rr(r) CROSS JOIN (VALUES (0, 'key'), (1, 'status'), (2, 'priority')) AS cc(c, h)"""
}


@query("grid_records", oracle("SELECT * FROM grid", extra=GRID))
def grid_records(spark, sf_dir):
    return layout.grid_to_records(inputs.table_cells(spark, sf_dir))


@query(
    "grid_maps",
    oracle(
        """
SELECT o_orderkey AS table_id, r AS row, o_orderkey || '/' || r AS key, o_orderstatus AS status, o_orderpriority AS priority, 3 AS fields
FROM orders CROSS JOIN (VALUES (1), (2)) AS rr(r)"""
    ),
)
def grid_maps(spark, sf_dir):
    out = layout.records_as_maps(layout.grid_to_records(inputs.table_cells(spark, sf_dir)))
    return out.select("table_id", "row", *[F.col("record")[h].alias(h) for h in ("key", "status", "priority")], F.size("record").alias("fields"))


TABLES = {
    "found": """
SELECT doc_id, i, (doc_id + i) % 5 AS rows, (doc_id + 2 * i) % 4 AS columns, CASE WHEN doc_id % 13 <> 0 THEN (doc_id + i) % 3 END AS data_rows,
       (50 + (doc_id * 3 + i) % 50)::DOUBLE AS accuracy
FROM documents CROSS JOIN (VALUES (0), (1)) AS t(i)"""
}


@query("valid_tables", oracle("SELECT doc_id, i FROM found WHERE rows >= 2 AND columns >= 2 AND data_rows > 0", extra=TABLES))
def valid_tables(spark, sf_dir):
    return layout.valid_tables(inputs.found_tables(spark, sf_dir)).select("doc_id", "i")


@query(
    "table_confidence",
    oracle("SELECT doc_id, round(avg(accuracy) / 100, 6) AS confidence, count(*) AS table_count FROM found GROUP BY doc_id", extra=TABLES),
)
def table_confidence(spark, sf_dir):
    return layout.table_confidence(inputs.found_tables(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(
    "method_fallback",
    oracle(
        """
SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'failed' WHEN doc_id % 2 <> 0 THEN 'camelot' WHEN (doc_id + 1) % 3 <> 0 THEN 'pdfplumber'
                    WHEN (doc_id + 2) % 4 <> 0 THEN 'tabula' ELSE 'failed' END AS extraction_method,
       CASE WHEN doc_id % 10 = 3 THEN 0 WHEN doc_id % 2 <> 0 THEN doc_id % 4 WHEN (doc_id + 1) % 3 <> 0 THEN doc_id % 4 + 1
            WHEN (doc_id + 2) % 4 <> 0 THEN doc_id % 4 + 2 ELSE 0 END AS table_count
FROM documents"""
    ),
)
def method_fallback(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id")
    return layout.pick_method(inputs.method_attempts(spark, sf_dir), docs)
