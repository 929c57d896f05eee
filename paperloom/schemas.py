"""Result types per document type and their constraints.

Every document type is a Spark DDL string plus a list of constraints `(path, kind, argument)`.
`[]` in a path means "each element of this array". V5 generates its checks from these two.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Field names, enumerations, ranges and patterns of the four document types.
INVOICE_DDL = """
document_type STRING, document_path STRING,
metadata STRUCT<invoice_number STRING, invoice_date DATE, due_date DATE, po_number STRING, confidence DOUBLE>,
vendor STRUCT<name STRING, address STRING, tax_id STRING, contact STRING>,
customer STRUCT<name STRING, address STRING, tax_id STRING>,
line_items ARRAY<STRUCT<item_number STRING, description STRING, quantity DOUBLE, unit_price DECIMAL(18,2),
                        amount DECIMAL(18,2), tax_rate DOUBLE>>,
financial STRUCT<subtotal DECIMAL(18,2), tax DECIMAL(18,2), shipping DECIMAL(18,2), discount DECIMAL(18,2),
                 total_amount DECIMAL(18,2), currency STRING>,
payment_terms STRUCT<terms STRING, method STRING,
                     bank_details STRUCT<bank_name STRING, account_number STRING, routing_number STRING,
                                         swift_code STRING>,
                     early_payment_discount STRUCT<percentage DOUBLE, days DOUBLE>>,
custom_extractions MAP<STRING, STRING>, extraction_timestamp TIMESTAMP
"""
AGREEMENT_DDL = """
document_type STRING, document_path STRING,
metadata STRUCT<agreement_type STRING, agreement_id STRING, effective_date DATE, expiry_date DATE,
                term_duration STRING, confidence DOUBLE>,
parties ARRAY<STRUCT<role STRING, name STRING, address STRING, representative STRING, title STRING>>,
key_terms STRUCT<scope STRING, payment_terms STRING, termination_clause STRING, notice_period STRING,
                 liability_cap STRING, indemnification STRING, confidentiality STRING, governing_law STRING,
                 dispute_resolution STRING>,
obligations ARRAY<STRUCT<party STRING, obligation STRING, deadline STRING, deliverable STRING>>,
penalties ARRAY<STRUCT<condition STRING, penalty STRING, amount STRING>>,
renewal_terms STRUCT<auto_renewal BOOLEAN, renewal_period STRING, renewal_notice_period STRING,
                     renewal_terms_change STRING>,
signatures ARRAY<STRUCT<party STRING, signatory STRING, title STRING, date DATE, detected BOOLEAN>>,
custom_extractions MAP<STRING, STRING>, extraction_timestamp TIMESTAMP
"""
KYC_DDL = """
document_type STRING, document_path STRING,
metadata STRUCT<document_id STRING, document_subtype STRING, issue_date DATE, expiry_date DATE,
                issuing_authority STRING, issuing_country STRING, confidence DOUBLE>,
personal_info STRUCT<full_name STRING, first_name STRING, last_name STRING, middle_name STRING,
                     date_of_birth DATE, place_of_birth STRING, nationality STRING, gender STRING>,
address STRUCT<street STRING, city STRING, state STRING, postal_code STRING, country STRING, full_address STRING>,
verification STRUCT<photo_present BOOLEAN, photo_extracted BOOLEAN,
                    mrz_data STRUCT<document_type STRING, issuing_country STRING, surname STRING,
                                    given_names STRING, document_number STRING, nationality STRING,
                                    date_of_birth STRING, sex STRING, expiry_date STRING, personal_number STRING>,
                    security_features_detected ARRAY<STRING>, document_authentic BOOLEAN,
                    verification_confidence DOUBLE,
                    tamper_detection STRUCT<tampered BOOLEAN, evidence STRING>>,
additional_info STRUCT<document_holder_signature BOOLEAN, endorsements ARRAY<STRING>, restrictions ARRAY<STRING>>,
utility_bill_specific STRUCT<utility_type STRING, account_number STRING, billing_period STRING,
                             amount_due DECIMAL(18,2), due_date DATE>,
custom_extractions MAP<STRING, STRING>, extraction_timestamp TIMESTAMP
"""
RECEIPT_DDL = """
store STRUCT<name STRING, address STRING, phone STRING, store_id STRING>,
transaction STRUCT<receipt_number STRING, date DATE, time STRING, cashier STRING, register STRING>,
line_items ARRAY<STRUCT<description STRING, sku STRING, quantity DOUBLE, unit_price DECIMAL(18,2),
                        amount DECIMAL(18,2), discount DECIMAL(18,2)>>,
totals STRUCT<subtotal DECIMAL(18,2), tax DECIMAL(18,2),
              tax_breakdown ARRAY<STRUCT<type STRING, rate DOUBLE, amount DECIMAL(18,2)>>,
              total DECIMAL(18,2), currency STRING>,
payment STRUCT<method STRING, card_last_four STRING, amount_tendered DECIMAL(18,2), change DECIMAL(18,2)>,
promotions ARRAY<STRUCT<code STRING, description STRING, discount DECIMAL(18,2)>>,
loyalty STRUCT<member_id STRING, points_earned DOUBLE, points_redeemed DOUBLE, points_balance DOUBLE>,
metadata STRUCT<confidence DOUBLE, extraction_timestamp TIMESTAMP>
"""

DDL = {"invoice": INVOICE_DDL, "agreement": AGREEMENT_DDL, "kyc": KYC_DDL, "receipt": RECEIPT_DDL}

CONSTRAINTS = {
    "invoice": [
        ("", "required", ["document_type", "metadata", "vendor", "financial"]),
        ("document_type", "const", "invoice"),
        ("metadata", "required", ["invoice_number", "invoice_date"]),
        ("metadata.confidence", "range", (0, 1)),
        ("vendor", "required", ["name"]),
        ("customer", "required", ["name"]),
        ("line_items[]", "required", ["description", "amount"]),
        ("financial", "required", ["total_amount", "currency"]),
    ],
    "agreement": [
        ("", "required", ["document_type", "metadata", "parties"]),
        ("document_type", "const", "agreement"),
        ("metadata", "required", ["agreement_type"]),
        (
            "metadata.agreement_type",
            "enum",
            ["NDA", "MSA", "SOW", "SLA", "License", "Partnership", "Employment", "Other"],
        ),
        ("metadata.confidence", "range", (0, 1)),
        ("parties", "min_items", 2),
        ("parties[]", "required", ["role", "name"]),
        ("obligations[]", "required", ["party", "obligation"]),
        ("signatures[]", "required", ["party"]),
    ],
    "kyc": [
        ("", "required", ["document_type", "metadata", "personal_info"]),
        ("document_type", "const", "kyc"),
        ("metadata", "required", ["document_id", "document_subtype"]),
        (
            "metadata.document_subtype",
            "enum",
            ["passport", "driver_license", "national_id", "utility_bill", "bank_statement", "other"],
        ),
        ("metadata.confidence", "range", (0, 1)),
        ("personal_info", "required", ["full_name"]),
        ("personal_info.gender", "enum", ["M", "F", "X", "Other"]),
        ("verification.verification_confidence", "range", (0, 1)),
        (
            "utility_bill_specific.utility_type",
            "enum",
            ["electricity", "water", "gas", "internet", "phone", "other"],
        ),
    ],
    "receipt": [
        ("", "required", ["store", "transaction", "line_items", "totals"]),
        ("transaction", "required", ["receipt_number", "date"]),
        ("line_items[]", "required", ["description", "quantity", "amount"]),
        ("totals", "required", ["total"]),
        (
            "payment.method",
            "enum",
            ["cash", "credit", "debit", "check", "gift_card", "mobile", "other"],
        ),
        ("payment.card_last_four", "pattern", "^[0-9]{4}$"),
        ("metadata.confidence", "range", (0, 1)),
    ],
}

DEFAULT_CURRENCY = "USD"


def struct_type(document_type: str) -> T.StructType:
    """Spark type of one document type's result."""
    return T.StructType.fromDDL(DDL[document_type])


def known_types(*extra: str) -> list[str]:
    """Sorted names of all types with a schema."""
    return sorted({*DDL, *extra})


def merge_constraints(parent: list[tuple], child: list[tuple]) -> list[tuple]:
    """Child constraints win per (path, kind); required sets are united."""
    merged = {(path, kind): arg for path, kind, arg in parent}
    for path, kind, arg in child:
        if kind == "required" and (path, kind) in merged:
            arg = list(dict.fromkeys([*merged[(path, kind)], *arg]))
        merged[(path, kind)] = arg
    return [(path, kind, arg) for (path, kind), arg in merged.items()]


def merge_types(parent: T.StructType, child: T.StructType) -> T.StructType:
    """Parent fields with the child's definitions on top; structs are replaced, not merged."""
    fields = {f.name: f for f in parent.fields}
    fields.update({f.name: f for f in child.fields})
    return T.StructType(list(fields.values()))
