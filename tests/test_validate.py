"""Business checks at their boundaries."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from paperloom import schemas
from paperloom.operators import aggregate, scoring, validate

DDL = (
    "path STRING, metadata STRUCT<invoice_number STRING, invoice_date DATE, due_date DATE>, "
    "line_items ARRAY<STRUCT<amount DECIMAL(18,2)>>, financial STRUCT<subtotal DECIMAL(18,2)>"
)


def invoice(spark, number="N1", day="2024-01-10", due="2024-02-10", amounts=("60.00", "40.00"), subtotal="100.00"):
    import datetime
    from decimal import Decimal as D

    date = lambda x: x and datetime.date.fromisoformat(x)
    items = None if amounts is None else [(None if a is None else D(a),) for a in amounts]
    row = ("p", (number, date(day), date(due)), items, (subtotal and D(subtotal),))
    df = spark.createDataFrame([row], DDL)
    return validate.validate_invoice(df).select("validation.*").first()


def test_good_invoice(spark):
    assert tuple(invoice(spark)) == (True, [], [])


@pytest.mark.parametrize("number", [None, ""])
def test_missing_number_is_an_error(spark, number):
    r = invoice(spark, number=number)
    assert (r["is_valid"], r["errors"]) == (False, ["Missing invoice number"])


def test_due_date(spark):
    assert invoice(spark, due="2024-01-09")["errors"] == ["Due date is before invoice date"]
    assert invoice(spark, due="2024-01-10")["is_valid"]
    assert invoice(spark, due=None)["is_valid"]


def test_subtotal_tolerance_and_message(spark):
    assert invoice(spark, subtotal="100.01")["warnings"] == []  # exactly the tolerance
    r = invoice(spark, subtotal="100.02")
    assert r["is_valid"] and r["warnings"] == ["Line items total (100.0) does not match declared subtotal (100.02)"]


def test_subtotal_is_only_checked_when_there_is_one(spark):
    assert invoice(spark, subtotal="0.00")["warnings"] == []
    assert invoice(spark, subtotal=None)["warnings"] == []
    assert invoice(spark, amounts=[])["warnings"] == []
    assert invoice(spark, amounts=None)["warnings"] == []
    assert invoice(spark, amounts=["100.00", None])["warnings"] == []  # a missing amount counts as zero


def test_agreement(spark):
    ddl = "metadata STRUCT<agreement_type STRING, effective_date DATE, expiry_date DATE>, parties ARRAY<STRUCT<name STRING>>"
    import datetime

    a, b = datetime.date(2024, 1, 1), datetime.date(2023, 1, 1)
    rows = [(("NDA", a, a), [("x",), ("y",)]), ((None, a, b), [("x",)]), (("", None, b), None)]
    got = [tuple(r[0]) for r in validate.validate_agreement(spark.createDataFrame(rows, ddl)).select("validation").collect()]
    assert got[0] == (True, [], [])
    assert got[1] == (
        False,
        ["Less than 2 parties identified", "Expiry date is before effective date"],
        ["Agreement type not identified"],
    )
    assert got[2] == (False, ["Less than 2 parties identified"], ["Agreement type not identified"])


def test_receipt_rules_and_levels(spark):
    df = spark.sql(
        "SELECT array(named_struct('amount', 10.00BD)) line_items, named_struct('subtotal', 10.02BD, 'tax', 1.00BD, 'total', 11.04BD) totals"
    )
    assert validate.check_rules(df).select("validation.errors").first()[0] == ["subtotal_plus_tax_equals_total"]
    rules = [{"rule": "line_items_sum_equals_subtotal", "tolerance": 0.01, "error_level": "warning"}]
    r = validate.check_rules(df, rules).select("validation.*").first()
    assert tuple(r) == (True, [], ["line_items_sum_equals_subtotal"])
    with pytest.raises(ValueError):
        validate.check_rules(df, [{"rule": "nope"}])


def schema_report(spark, doc, kind="receipt"):
    df = spark.createDataFrame([(doc if isinstance(doc, str) else json.dumps(doc),)], "json STRING")
    return validate.validate_schema(df, kind).select("validation.*").first()


def test_schema_accepts_a_full_receipt(spark):
    doc = {
        "store": {"name": "S"},
        "transaction": {"receipt_number": "1", "date": "2024-01-01"},
        "line_items": [{"description": "d", "quantity": 1, "amount": 2.5}],
        "totals": {"total": 2.5},
        "payment": {"method": "cash", "card_last_four": "1234"},
    }
    assert tuple(schema_report(spark, doc)) == (True, [], [])


def test_schema_errors_and_warnings(spark):
    doc = {
        "store": "S",
        "transaction": {"receipt_number": 1, "date": "2024-01-01"},
        "line_items": [{"description": "d", "quantity": "x", "amount": 2.5}, {"description": None, "quantity": 1}],
        "totals": {},
        "payment": {"method": "shells", "card_last_four": "12"},
        "metadata": {"confidence": -1},
    }
    r = schema_report(spark, doc)
    assert not r["is_valid"]
    assert sorted(r["errors"]) == sorted(
        [
            "'S' is not of type 'object'",
            "1 is not of type 'string'",
            "'x' is not of type 'number'",
            "None is not of type 'string'",
            "'amount' is a required property",
            "'total' is a required property",
        ]
    )
    assert sorted(r["warnings"]) == sorted(
        [
            "'shells' is not one of ['cash', 'credit', 'debit', 'check', 'gift_card', 'mobile', 'other']",
            "'12' does not match '^[0-9]{4}$'",
            "-1 is less than the minimum of 0",
        ]
    )


def test_a_warning_alone_makes_a_document_invalid(spark):
    doc = {"document_type": "agreement", "metadata": {"agreement_type": "NDA"}, "parties": [{"role": "a", "name": "b"}]}
    r = schema_report(spark, doc, "agreement")
    assert (r["is_valid"], r["errors"], len(r["warnings"])) == (False, [], 1)
    assert r["warnings"][0].endswith(" is too short")


def test_broken_json(spark):
    assert schema_report(spark, "{")["errors"] == ["document is not valid JSON"]


def test_merged_types():
    child = T.StructType().add("po_reference", "string").add("vendor", "string")
    merged = schemas.merge_types(schemas.struct_type("invoice"), child)
    assert merged["vendor"].dataType == T.StringType() and "po_reference" in merged.names
    rules = schemas.merge_constraints(schemas.CONSTRAINTS["invoice"], [("", "required", ["vendor", "po_reference"])])
    assert ("", "required", ["document_type", "metadata", "vendor", "financial", "po_reference"]) in rules


def test_success_is_strictly_above_the_limit(spark):
    df = spark.createDataFrame([("invoice", 0.7), ("invoice", 0.71), (None, None)], "document_type STRING, confidence DOUBLE")
    assert tuple(aggregate.batch_status(df).first()) == (3, 1, 2)
    got = {(r[0], r[1]): (r[2], r[3]) for r in aggregate.summarize(df).collect()}
    assert got == {(None, True): (3, 1), ("invoice", False): (2, 1), ("unknown", False): (1, 0)}


def test_scores(spark):
    df = spark.createDataFrame([("a", "", None, True, None)], "x STRING, y STRING, z STRING, p BOOLEAN, q BOOLEAN")
    row = df.select(
        scoring.completeness([F.col("x"), F.col("y"), F.col("z")]),
        scoring.consistency([F.col("p"), F.col("q")]),
        scoring.consistency([F.col("q")]),
        scoring.confidence(F.create_map(F.lit("n"), F.lit(1.0), F.lit("m"), F.lit(0.4)), {"n": 2.0}),
    ).first()
    assert [round(v, 6) for v in row] == [0.333333, 1.0, 1.0, 0.8]
    scored = spark.createDataFrame([(0.5, 0.5, 0.5), (0.5, 0.5, 0.49)], "completeness DOUBLE, consistency DOUBLE, confidence DOUBLE")
    assert [r["alert"] for r in scoring.quality(scored).collect()] == [False, True]


def test_merge_drops_weak_fields_and_flags_partial(spark):
    rows = [(1, 1, "a", "x", 0.3), (1, 2, "a", "y", 0.3), (1, 1, "b", "z", 0.29), (2, 1, "a", None, 0.9)]
    df = spark.createDataFrame(rows, "doc_id INT, attempt INT, field STRING, value STRING, confidence DOUBLE")
    got = {r["doc_id"]: (r["fields"], r["partial"]) for r in aggregate.merge_partial(df, ["a", "b"]).collect()}
    assert got == {1: ({"a": "x"}, True), 2: ({}, True)}
