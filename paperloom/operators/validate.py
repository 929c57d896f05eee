"""Validation reports as struct columns: `is_valid, errors[], warnings[]`."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from paperloom import schemas

# Tolerances and messages of the business checks.
SUBTOTAL_TOLERANCE = "0.01"
MISSING_NUMBER = "Missing invoice number"
DUE_BEFORE_INVOICE = "Due date is before invoice date"
NO_AGREEMENT_TYPE = "Agreement type not identified"
TOO_FEW_PARTIES = "Less than 2 parties identified"
EXPIRY_BEFORE_EFFECTIVE = "Expiry date is before effective date"

MONEY = T.DecimalType(38, 2)


def report(errors: Sequence[Column], warnings: Sequence[Column], strict: bool = False) -> Column:
    """Collect non-null messages. `strict` makes warnings count against validity too."""
    none = F.array().cast("array<string>")
    errs = F.array_compact(F.array(*errors)) if errors else none
    warns = F.array_compact(F.array(*warnings)) if warnings else none
    return _report_struct(errs, warns, strict)


def _report_struct(errs: Column, warns: Column, strict: bool) -> Column:
    valid = F.size(errs) == 0
    if strict:
        valid = valid & (F.size(warns) == 0)
    return F.struct(valid.alias("is_valid"), errs.alias("errors"), warns.alias("warnings"))


def plain_number(amount: Column) -> Column:
    """Two-decimal amount with at most one trailing zero: 100.0, 100.1, 100.11."""
    return F.regexp_replace(amount.cast(MONEY).cast("string"), "0$", "")


def items_sum(items: Column) -> Column:
    """Sum of `amount` over a line-item array; a missing amount counts as zero."""
    zero = F.lit(0).cast(MONEY)
    return F.aggregate(items, zero, lambda acc, x: (acc + F.coalesce(x["amount"].cast(MONEY), zero)).cast(MONEY))


def validate_invoice(
    df: DataFrame,
    items_total: Column | None = None,
    items_count: Column | None = None,
    into: str = "validation",
    inside: str | None = None,
) -> DataFrame:
    """Number present; line items add up to a non-zero declared subtotal; due date not before date.

    Line items are read from the `line_items` array unless their total and count are given as
    columns, which is how a corpus with a separate line table uses it (the total is then a plain
    map-side-combined sum and no array is ever built). `inside` names the struct that holds the invoice in
    a table of several types; rows without one get no report.
    """
    at = "" if inside is None else f"{inside}."
    items = F.col(f"{at}line_items")
    total = items_sum(items) if items_total is None else items_total.cast(MONEY)
    count = F.coalesce(F.size(items), F.lit(0)) if items_count is None else items_count
    declared = F.col(f"{at}financial.subtotal").cast(MONEY)
    number, issued, due = (F.col(f"{at}metadata.{c}") for c in ("invoice_number", "invoice_date", "due_date"))
    errors = [
        F.when(number.isNull() | (number == ""), MISSING_NUMBER),
        F.when(due < issued, DUE_BEFORE_INVOICE),
    ]
    mismatch = (count > 0) & (declared != 0) & (F.abs(total - declared) > F.lit(SUBTOTAL_TOLERANCE).cast(MONEY))
    message = F.concat(
        F.lit("Line items total ("),
        plain_number(total),
        F.lit(") does not match declared subtotal ("),
        plain_number(declared),
        F.lit(")"),
    )
    found = report(errors, [F.when(mismatch, message)])
    return df.withColumn(into, found if inside is None else F.when(F.col(inside).isNotNull(), found))


def validate_agreement(df: DataFrame, into: str = "validation") -> DataFrame:
    """At least two parties; expiry not before effective date; a missing type is only a warning."""
    kind = F.col("metadata.agreement_type")
    parties = F.coalesce(F.size("parties"), F.lit(0))
    errors = [
        F.when(parties < 2, TOO_FEW_PARTIES),
        F.when(F.col("metadata.expiry_date") < F.col("metadata.effective_date"), EXPIRY_BEFORE_EFFECTIVE),
    ]
    return df.withColumn(into, report(errors, [F.when(kind.isNull() | (kind == ""), NO_AGREEMENT_TYPE)]))


# --- rules (V3, V4) ---------------------------------------------------------------------------


def rule_gap(rule: str, document_type: str = "receipt", items_total: Column | None = None) -> Column:
    """Signed difference a rule looks at; null when the rule cannot be evaluated on the row."""
    side, total = ("financial", "total_amount") if document_type == "invoice" else ("totals", "total")
    amount = lambda name: F.col(f"{side}.{name}").cast(MONEY)
    if rule == "line_items_sum_equals_subtotal":
        items = items_sum(F.col("line_items")) if items_total is None else items_total.cast(MONEY)
        return items - amount("subtotal")
    if rule == "subtotal_plus_tax_equals_total":
        return amount("subtotal") + F.coalesce(amount("tax"), F.lit(0).cast(MONEY)) - amount(total)
    raise ValueError(f"unknown rule: {rule}")


# The rules the receipt type comes with.
RECEIPT_RULES = [
    {"rule": "line_items_sum_equals_subtotal", "tolerance": "0.02"},
    {"rule": "subtotal_plus_tax_equals_total", "tolerance": "0.01"},
]


def check_rules(
    df: DataFrame,
    rules: Iterable[dict] = RECEIPT_RULES,
    document_type: str = "receipt",
    items_total: Column | None = None,
    into: str = "validation",
) -> DataFrame:
    """Evaluate named rules with their tolerance; `error_level` is `error` (default) or `warning`."""
    errors, warnings = [], []
    for rule in rules:
        gap = rule_gap(rule["rule"], document_type, items_total)
        limit = F.lit(str(rule.get("tolerance", "0"))).cast(T.DecimalType(18, 6))
        level = rule.get("error_level", "error")
        if level not in ("error", "warning"):
            raise ValueError(f"unknown error_level: {level}")
        (errors if level == "error" else warnings).append(F.when(F.abs(gap) > limit, F.lit(rule["rule"])))
    return df.withColumn(into, report(errors, warnings))


# --- schema checks (V5) -----------------------------------------------------------------------

_JSON_KIND = {"string": "STRING", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN",
              "object": "OBJECT", "array": "ARRAY"}


def _json_type(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "number" if isinstance(dtype, T.NumericType) else "string"


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(values: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


class _SchemaChecks:
    """Walks a struct type once on the driver and writes one SQL expression per possible violation.

    A violation is null or a struct (value, text): the offending value, if the message shows it, and
    the rest of the message.
    """

    def __init__(self, constraints: Sequence[tuple]):
        self.rules: dict[str, list[tuple]] = {}
        for path, kind, arg in constraints:
            self.rules.setdefault(path, []).append((kind, arg))

    def walk(self, value: str, dtype: T.DataType, path: str) -> tuple[list[str], list[str]]:
        """(error arrays, warning arrays) for one value; nothing is reported for an absent value."""
        wanted = _json_type(dtype)
        fits = f"schema_of_variant({value}) RLIKE '^({_JSON_KIND[wanted]})'"
        errors = [self._when(f"NOT ({fits})", value, f" is not of type '{wanted}'")]
        warnings = []
        for rule, arg in self.rules.get(path, []):
            if rule == "required":
                for name in arg:
                    missing = f"{fits} AND try_variant_get({value}, '$.{name}', 'variant') IS NULL"
                    errors.append(self._when(missing, None, f"'{name}' is a required property"))
            else:
                warnings.append(self._soft(rule, arg, value, fits))
        errors, warnings = [f"array({e})" for e in errors], [f"array({w})" for w in warnings]
        if isinstance(dtype, T.StructType):
            for field in dtype.fields:
                inner = f"try_variant_get({value}, '$.{field.name}', 'variant')"
                e, w = self.walk(inner, field.dataType, f"{path}.{field.name}" if path else field.name)
                errors += e
                warnings += w
        elif isinstance(dtype, T.ArrayType):
            item = "item" + str(path.count("[]"))
            for found, target in zip(self.walk(item, dtype.elementType, path + "[]"), (errors, warnings)):
                if found:
                    each = f"transform(try_variant_get({value}, '$', 'array<variant>'), {item} -> concat({', '.join(found)}))"
                    target.append(f"coalesce(flatten({each}), array())")
        return errors, warnings

    @staticmethod
    def _when(condition: str, value: str | None, text: str) -> str:
        shown = value or "CAST(NULL AS VARIANT)"
        return f"CASE WHEN {condition} THEN named_struct('value', {shown}, 'text', {_sql_text(text)}) END"

    def _soft(self, rule: str, arg, value: str, fits: str) -> str:
        text = f"try_variant_get({value}, '$', 'string')"
        if rule == "const":
            return self._when(f"NOT ({fits} AND {text} = {_sql_text(arg)})", None, f"'{arg}' was expected")
        if rule == "enum":
            allowed = ", ".join(_sql_text(v) for v in arg)
            return self._when(f"NOT ({fits} AND {text} IN ({allowed}))", value, f" is not one of {_listed(arg)}")
        if rule == "pattern":
            return self._when(f"{fits} AND NOT {text} RLIKE {_sql_text(arg)}", value, f" does not match '{arg}'")
        if rule == "min_items":
            count = f"size(try_variant_get({value}, '$', 'array<variant>'))"
            return self._when(f"{fits} AND {count} < {arg}", value, " is too short")
        if rule == "range":
            number, (low, high) = f"try_variant_get({value}, '$', 'double')", arg
            below = self._when(f"{fits} AND {number} < {low}", value, f" is less than the minimum of {low}")
            above = self._when(f"{fits} AND {number} > {high}", value, f" is greater than the maximum of {high}")
            return f"coalesce({below}, {above})"
        raise ValueError(f"unknown constraint: {rule}")


def _messages(violations: Sequence[str]) -> Column:
    """Violations as text: values print as 'text', number, True / False, None or JSON."""
    if not violations:
        return F.array().cast("array<string>")

    def message(v: Column) -> Column:
        kind, text = F.schema_of_variant(v["value"]), F.try_variant_get(v["value"], F.lit("$"), "string")
        shown = (
            F.when(v["value"].isNull(), "")
            .when(kind == "STRING", F.concat(F.lit("'"), text, F.lit("'")))
            .when(kind == "VOID", "None")
            .when(kind == "BOOLEAN", F.initcap(text))
            .when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json(v["value"]))
            .otherwise(text)
        )
        return F.concat(shown, v["text"])

    return F.transform(F.array_compact(F.expr(f"concat({', '.join(violations)})")), message)


def validate_schema(
    df: DataFrame,
    document_type: str | T.StructType,
    json: str = "json",
    constraints: Sequence[tuple] | None = None,
    into: str = "validation",
) -> DataFrame:
    """Check a JSON string column against a type. Missing required fields and wrong types are
    errors, everything else is a warning; a document is valid only without either."""
    dtype = schemas.struct_type(document_type) if isinstance(document_type, str) else document_type
    if constraints is None:
        constraints = schemas.CONSTRAINTS[document_type] if isinstance(document_type, str) else []
    parsed = df.withColumn("_variant", F.try_parse_json(F.col(json)))
    errors, warnings = _SchemaChecks(constraints).walk("_variant", dtype, "")
    unreadable = F.array_compact(F.array(F.when(F.col("_variant").isNull(), "document is not valid JSON")))
    errs, warns = F.concat(unreadable, _messages(errors)), _messages(warnings)
    return parsed.withColumn(into, _report_struct(errs, warns, strict=True)).drop("_variant")


def combine_types(
    parent_df: DataFrame, child_df: DataFrame, key: str, parent_type: str, child: tuple[T.StructType, list]
) -> tuple[DataFrame, list[tuple]]:
    """Results of a derived type over those of its base type: child column wins where both hold a
    value, rows of either side are kept. Also returns the merged constraint list for `validate_schema`."""
    child_struct, child_constraints = child
    p, c = parent_df.alias("p"), child_df.alias("c")
    joined = p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}"), "full_outer")
    names = list(dict.fromkeys([*parent_df.columns, *child_df.columns]))
    cols = []
    for name in names:
        sides = [F.col(f"{a}.{name}") for a, d in (("c", child_df), ("p", parent_df)) if name in d.columns]
        cols.append(F.coalesce(*sides).alias(name))
    merged = schemas.merge_constraints(schemas.CONSTRAINTS[parent_type], child_constraints)
    return joined.select(*cols), merged


def register_validator(spark: SparkSession, name: str, argument: str, returns: str, expression: str) -> None:
    """A user rule as a SQL function, e.g. `register_validator(spark, "tax_id_ok", "x STRING", "BOOLEAN",
    "x RLIKE '^[0-9]{9}$'")` (U1). Catalyst inlines it, so it costs what the expression costs."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument}) RETURNS {returns} RETURN {expression}")


def apply_validator(df: DataFrame, name: str, valid: Column, formatted: Column) -> DataFrame:
    """Attach a user check as `<name>_valid` and `<name>_formatted`; both are ordinary columns, so a
    SQL function or a `pandas_udf` result fits as well as a built-in expression."""
    return df.withColumn(f"{name}_valid", valid).withColumn(f"{name}_formatted", formatted)
