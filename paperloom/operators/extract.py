"""Rule-based field extraction from whole texts into the typed results.

All operators are projections over one text column: no shuffle, no Python in the row path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from paperloom import schemas
from paperloom.functions import text as tx
from paperloom.operators.keys import join_skewed

NUMBER = r"[A-Za-z0-9][A-Za-z0-9/_-]*"

# Our own clause patterns for the named clause types.
CLAUSE_RULES = {
    "termination": r"(?i)\bterminat(?:e|es|ed|ion)\b",
    "liability": r"(?i)\bliab(?:le|ility)\b",
    "renewal": r"(?i)\brenew(?:s|al|ed)?\b",
    "auto-renewal": r"(?i)\b(?:renews? automatically|automatic(?:ally)? renew(?:s|al|ed)?|auto-renew(?:s|al)?)\b",
    "penalty": r"(?i)\bpenalt(?:y|ies)\b",
    "liquidated_damages": r"(?i)\bliquidated damages\b",
}
PENALTY_CONDITION = r"(?i)\b(?:appl(?:y|ies) (?:to|for|if|when)|payable (?:on|for|if|in case of)|in case of|if) ([^.\n]+?)(?: and count\b[^.\n]*)?$"
PENALTY_TYPES = ["penalty", "liquidated_damages"]
RENEWAL_TYPES = ["renewal", "auto-renewal"]


def _typed(result_type: str, **fields: Column) -> Column:
    """A full result struct; fields that no rule fills are null of their declared type. Its
    `metadata.confidence` is the share of the type's required fields that were found."""
    struct = F.struct(
        *[
            (fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.struct_type(result_type).fields
        ]
    )

    def scored(r: Column) -> Column:
        found = [c(r).cast("int") for c in _required(result_type)]
        share = reduce(lambda a, b: a + b, found) / len(found)
        meta = schemas.struct_type(result_type)["metadata"].dataType
        values = [(share if f.name == "confidence" else r["metadata"][f.name]).alias(f.name) for f in meta.fields]
        return r.withField("metadata", F.struct(*values).cast(meta))

    return tx.let(struct, scored)


def _required(result_type: str) -> list[Callable[[Column], Column]]:
    """Tests for the required fields: named leaves are not null, required lists are not empty."""
    struct = schemas.struct_type(result_type)
    tests: list[Callable[[Column], Column]] = []
    for path, kind, names in schemas.CONSTRAINTS[result_type]:
        if kind != "required" or "[]" in path:
            continue
        for name in names:
            if path:
                tests.append(lambda r, p=path, n=name: r[p][n].isNotNull())
            elif isinstance(struct[name].dataType, T.ArrayType):
                tests.append(lambda r, n=name: F.coalesce(F.size(r[n]) > 0, F.lit(False)))
    return tests


def _record(dtype_path: tuple[str, str], **values: Column) -> Column:
    """Nested struct of a type with the given fields set, the others null."""
    struct = schemas.struct_type(dtype_path[0])[dtype_path[1]].dataType
    return F.struct(
        *[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct.fields]
    )


def _path(df: DataFrame) -> Column | None:
    return F.col("path") if "path" in df.columns else None


# --- invoices (X8, X9) -------------------------------------------------------------------------


# `n, description, quantity, unit price, amount[, tax rate]` between bars, tabs or runs of blanks.
_BLANK_CELL = r" {2,}[^ \t\n|]+(?: [^ \t\n|]+)*"
LINE_ROW = (
    r"(?m)^ *[0-9]+(?: *(?:\|[^|\n]*){4,5}|(?:\t[^\t\n]*){4,5}|(?:" + _BLANK_CELL + r"){4,5} *)$"
)


def line_items(text: Column) -> Column:
    """All rows of numbered items, in text order (X9): cells between `|`, tabs, or two blanks and more."""
    rows = tx.all_matches(text, LINE_ROW)

    def item(cell: Column) -> Column:
        trimmed = lambda i: F.trim(cell[i])
        rate = lambda last: F.when(last.isNotNull(), F.regexp_extract(last, r"^([0-9]+(?:\.[0-9]+)?) ?%$", 1))
        return F.struct(
            trimmed(0).alias("item_number"),
            trimmed(1).alias("description"),
            trimmed(2).try_cast("double").alias("quantity"),
            tx.to_amount(trimmed(3)).alias("unit_price"),
            tx.to_amount(trimmed(4)).alias("amount"),
            rate(F.trim(F.get(cell, F.lit(5)))).try_cast("double").alias("tax_rate"),
        )

    def cells(row: Column) -> Column:
        bars = F.when(row.contains("|"), F.split(row, r"\|")).when(row.contains("\t"), F.split(row, "\t"))
        return F.coalesce(bars, F.split(F.trim(row), r" {2,}"))

    return F.transform(F.transform(rows, cells), item)


def extract_line_items(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """One row per line item with its position (from 1)."""
    return (
        df.select(*keep, F.posexplode(line_items(F.col(text))).alias("_pos", "item"))
        .withColumn("position", F.col("_pos") + 1)
        .select(*keep, "position", "item.*")
    )


def extract_invoice(df: DataFrame, text: str = "text", into: str = "invoice") -> DataFrame:
    """Invoice header, parties, totals, terms and line items."""
    return df.withColumn(into, invoice_of(F.col(text), _path(df)))


def invoice_of(text: Column, path: Column | None = None) -> Column:
    read = F.struct(tx.fields(text).alias("f"), tx.payment_terms(text).alias("terms"))
    return tx.let(read, lambda r: _invoice(r["f"], r["terms"], path))


def _invoice(f: Column, terms: Column, path: Column | None) -> Column:
    get = partial(tx.labelled, f)
    total = get("total", "total amount", "amount due")
    discount = F.when(
        terms["percentage"].isNotNull(),
        F.struct(terms["percentage"].alias("percentage"), terms["days"].cast("double").alias("days")),
    )
    return _typed(
        "invoice",
        document_path=F.lit(None) if path is None else path,
        document_type=F.lit("invoice"),
        metadata=_record(
            ("invoice", "metadata"),
            invoice_number=get("invoice number", "invoice no", "invoice #", value=NUMBER),
            invoice_date=tx.to_date(get("invoice date", "date")),
            due_date=tx.to_date(get("due date", "payment due")),
            po_number=get("po number", "po", "po no", "purchase order", "purchase order number", value=NUMBER),
        ),
        vendor=_record(
            ("invoice", "vendor"),
            name=get("vendor", "from", "seller"),
            address=get("vendor address"),
            tax_id=get("vendor tax id", "tax id"),
            contact=get("contact"),
        ),
        customer=_record(
            ("invoice", "customer"),
            name=get("customer", "bill to", "buyer"),
            address=get("customer address"),
            tax_id=get("customer tax id"),
        ),
        line_items=line_items(f["text"]),
        financial=_record(
            ("invoice", "financial"),
            subtotal=tx.to_amount(get("subtotal")),
            tax=tx.to_amount(get("tax", "sales tax", "vat")),
            shipping=tx.to_amount(get("shipping", "shipping and handling")),
            discount=tx.to_amount(get("discount")),
            total_amount=tx.to_amount(total),
            currency=F.coalesce(get("currency", value="[A-Z]{3}"), _leading_currency(total)),
        ),
        payment_terms=_record(
            ("invoice", "payment_terms"),
            terms=get("payment terms", "terms"),
            method=get("payment method"),
            bank_details=F.struct(
                get("bank", "bank name").alias("bank_name"),
                get("account number", "account no").alias("account_number"),
                get("routing number").alias("routing_number"),
                get("swift", "swift code").alias("swift_code"),
            ),
            early_payment_discount=discount,
        ),
    )


def _leading_currency(amount: Column) -> Column:
    return F.when(amount.rlike(r"^(?:USD|EUR|GBP|\$|€|£)"), tx.currency_of(amount))


# --- agreements (X10-X13) ----------------------------------------------------------------------


def extract_agreement(df: DataFrame, text: str = "text", into: str = "agreement") -> DataFrame:
    """Agreement header, parties, key terms, obligations, penalties, renewal terms and signatures."""
    return df.withColumn(into, agreement_of(F.col(text), _path(df)))


def agreement_of(text: Column, path: Column | None = None) -> Column:
    return tx.let(tx.fields(text), lambda f: _agreement(f, path))


def _agreement(f: Column, path: Column | None) -> Column:
    t, get = f["text"], partial(tx.labelled, f)
    # `Party (role): name[; address][, represented by person[, title]]`
    party_line = r"(?m)^Party \(([^)\n]+)\): ([^;\n]+?)(?:; ([^\n]+?))?(?:, represented by ([^,\n]+)(?:, ([^\n]+))?)?$"
    duty_line = r"(?m)^Obligation \(([^)\n]+)\): ([^\n]+?)(?: by ([^\n]+))?$"
    penalty_line = r"(?i)[^.\n]*\bpenalt(?:y|ies)\b[^.\n]*"
    sign_line = r"(?m)^Signed for ([^:\n]+): ([^,\n]+), ([^,\n]+), ([^\n]+)$"
    none = F.lit(None).cast("string")
    parties = F.transform(
        tx.all_matches(t, party_line),
        lambda line: F.struct(
            F.regexp_extract(line, party_line, 1).alias("role"),
            F.regexp_extract(line, party_line, 2).alias("name"),
            tx.blank_to_null(F.regexp_extract(line, party_line, 3)).alias("address"),
            tx.blank_to_null(F.regexp_extract(line, party_line, 4)).alias("representative"),
            tx.blank_to_null(F.regexp_extract(line, party_line, 5)).alias("title"),
        ),
    )
    obligations = F.transform(
        tx.all_matches(t, duty_line),
        lambda line: F.struct(
            F.regexp_extract(line, duty_line, 1).alias("party"),
            F.regexp_extract(line, duty_line, 2).alias("obligation"),
            tx.blank_to_null(F.regexp_extract(line, duty_line, 3)).alias("deadline"),
            none.alias("deliverable"),
        ),
    )
    penalties = F.transform(
        tx.all_matches(t, penalty_line),
        lambda line: F.struct(
            tx.blank_to_null(F.trim(F.regexp_extract(line, PENALTY_CONDITION, 1))).alias("condition"),
            F.trim(line).alias("penalty"),
            tx.blank_to_null(
                F.regexp_extract(line, r"([0-9]+(?:\.[0-9]+)? ?%|" + tx.MONEY_PATTERN + ")", 1)
            ).alias("amount"),
        ),
    )
    signatures = F.transform(
        tx.all_matches(t, sign_line),
        lambda line: F.struct(
            F.regexp_extract(line, sign_line, 1).alias("party"),
            F.regexp_extract(line, sign_line, 2).alias("signatory"),
            F.regexp_extract(line, sign_line, 3).alias("title"),
            tx.to_date(F.regexp_extract(line, sign_line, 4)).alias("date"),
            F.lit(True).alias("detected"),
        ),
    )
    return _typed(
        "agreement",
        document_path=F.lit(None) if path is None else path,
        document_type=F.lit("agreement"),
        metadata=_record(
            ("agreement", "metadata"),
            agreement_type=get("agreement type", value="[A-Za-z]+"),
            agreement_id=get("agreement no", "agreement number", "agreement id", value=NUMBER),
            effective_date=tx.to_date(get("effective date")),
            expiry_date=tx.to_date(get("expiry date", "expiration date")),
            term_duration=get("term"),
        ),
        parties=parties,
        key_terms=_record(
            ("agreement", "key_terms"),
            scope=get("scope"),
            payment_terms=get("payment terms"),
            termination_clause=get("termination"),
            notice_period=get("notice period"),
            liability_cap=get("liability cap"),
            indemnification=get("indemnification"),
            confidentiality=get("confidentiality"),
            governing_law=get("governing law"),
            dispute_resolution=get("dispute resolution"),
        ),
        obligations=obligations,
        penalties=penalties,
        renewal_terms=F.struct(
            t.rlike(CLAUSE_RULES["auto-renewal"]).alias("auto_renewal"),
            tx.blank_to_null(F.regexp_extract(t, RENEWAL_PERIOD, 1)).alias("renewal_period"),
            notice_period(t).alias("renewal_notice_period"),
            none.alias("renewal_terms_change"),
        ),
        signatures=signatures,
    )


NOTICE_PATTERN = r"(?i)notice of ([0-9]+ (?:day|week|month)s?)|([0-9]+ (?:day|week|month)s?)(?:'| of)? notice"
RENEWAL_PERIOD = r"(?i)\b(?:renew(?:s|ed)?(?: automatically)?|extended) for (?:a |an |one )?(?:further |additional |successive )?([0-9]+ (?:day|week|month|year)s?|(?:day|week|month|year)\b)"


def notice_period(text: Column) -> Column:
    """`notice of 30 days` and `2 months notice` as the named period, null without one."""
    return F.coalesce(
        tx.blank_to_null(F.regexp_extract(text, NOTICE_PATTERN, 1)),
        tx.blank_to_null(F.regexp_extract(text, NOTICE_PATTERN, 2)),
    )


def paragraphs(text: Column) -> Column:
    """Blank-line separated paragraphs, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def extract_clauses(
    df: DataFrame, rules: Mapping[str, str] = CLAUSE_RULES, text: str = "text", *keep: str
) -> DataFrame:
    """One row per paragraph and clause type it matches, with the paragraph's number as location (X11)."""
    types = F.array_compact(
        F.array(*[F.when(F.col("clause").rlike(p), F.lit(name)) for name, p in rules.items()])
    )
    exploded = df.select(*keep, F.posexplode(paragraphs(F.col(text))).alias("_pos", "clause"))
    return exploded.select(
        *keep, (F.col("_pos") + 1).alias("paragraph"), F.explode(types).alias("clause_type"), "clause"
    )


def penalty_clauses(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """Penalty and liquidated-damages clauses."""
    return extract_clauses(df, {t: CLAUSE_RULES[t] for t in PENALTY_TYPES}, text, *keep)


def renewal_terms(df: DataFrame, text: str = "text", into: str = "renewal") -> DataFrame:
    """has_renewal, auto_renewal and the notice period in days, from the renewal paragraphs.

    The clauses of a document are looked at inside its own row, so nothing is grouped again.
    """
    wanted = "|".join(f"(?:{CLAUSE_RULES[t]})" for t in RENEWAL_TYPES)
    clauses = F.filter(paragraphs(F.col(text)), lambda p: p.rlike(wanted))
    notice = F.array_compact(F.transform(clauses, notice_period))
    return df.withColumn(
        into,
        F.struct(
            (F.size(clauses) > 0).alias("has_renewal"),
            F.exists(clauses, lambda p: p.rlike(CLAUSE_RULES["auto-renewal"])).alias("auto_renewal"),
            tx.duration_days(F.get(notice, F.lit(0))).alias("notice_days"),
        ),
    )


# --- identity documents (X14, X15) ---------------------------------------------------------------


def parse_mrz(line1: Column, line2: Column) -> Column:
    """The ten fields of a passport zone of two lines of 44 characters, by fixed position."""
    plain = lambda c: tx.blank_to_null(F.trim(F.translate(c, "<", " ")))
    names = F.split(F.rtrim(F.substring(line1, 6, 39), F.lit("<")), "<<", 2)
    birth, expiry = F.substring(line2, 14, 6), F.substring(line2, 22, 6)
    date = lambda yymmdd, century: F.concat(
        century,
        F.substring(yymmdd, 1, 2),
        F.lit("-"),
        F.substring(yymmdd, 3, 2),
        F.lit("-"),
        F.substring(yymmdd, 5, 2),
    )
    digits = lambda c: c.rlike("^[0-9]{6}$")
    zone = F.struct(
        plain(F.substring(line1, 1, 2)).alias("document_type"),
        plain(F.substring(line1, 3, 3)).alias("issuing_country"),
        plain(names[0]).alias("surname"),
        plain(F.get(names, F.lit(1))).alias("given_names"),
        plain(F.substring(line2, 1, 9)).alias("document_number"),
        plain(F.substring(line2, 11, 3)).alias("nationality"),
        F.when(
            digits(birth), date(birth, F.when(F.substring(birth, 1, 2).cast("int") > MRZ_PIVOT, "19").otherwise("20"))
        ).alias("date_of_birth"),
        plain(F.substring(line2, 21, 1)).alias("sex"),
        F.when(digits(expiry), date(expiry, F.lit("20"))).alias("expiry_date"),
        plain(F.substring(line2, 29, 14)).alias("personal_number"),
    )
    return F.when((F.length(line1) == 44) & (F.length(line2) == 44), zone)


MRZ_PIVOT = 30  # two-digit birth years above it belong to the 1900s
MRZ_LINES = r"(?m)^(P[A-Z<][A-Z<]{3}[A-Z0-9<]{39})\n([A-Z0-9<]{44})$"


def extract_kyc(df: DataFrame, text: str = "text", into: str = "kyc") -> DataFrame:
    """Identity fields, address and the machine-readable zone if there is one."""
    return df.withColumn(into, kyc_of(F.col(text), _path(df)))


def kyc_of(text: Column, path: Column | None = None) -> Column:
    read = F.struct(tx.fields(text).alias("f"), F.regexp_extract(text, MRZ_LINES, 0).alias("zone"))
    return tx.let(read, lambda r: _kyc(r["f"], r["zone"], path))


def _kyc(f: Column, lines: Column, path: Column | None) -> Column:
    get = partial(tx.labelled, f)
    zone = parse_mrz(F.regexp_extract(lines, MRZ_LINES, 1), F.regexp_extract(lines, MRZ_LINES, 2))
    full = get("full name", "name")
    return _typed(
        "kyc",
        document_path=F.lit(None) if path is None else path,
        document_type=F.lit("kyc"),
        metadata=_record(
            ("kyc", "metadata"),
            document_id=get("document no", "document number", "passport no", "passport number", "license no",
                            "licence no", "license number", "id no", "id number", value=NUMBER),
            document_subtype=get("document type", value="[a-z_]+"),
            issue_date=tx.to_date(get("date of issue", "issue date")),
            expiry_date=tx.to_date(get("date of expiry", "expiry date")),
            issuing_authority=get("issuing authority", "authority"),
            issuing_country=get("issuing country", "country"),
        ),
        personal_info=_record(
            ("kyc", "personal_info"),
            full_name=full,
            first_name=tx.blank_to_null(F.substring_index(full, " ", 1)),
            middle_name=tx.blank_to_null(F.regexp_extract(full, r"^[^ ]+ +(.+) +[^ ]+$", 1)),
            last_name=F.when(full.contains(" "), F.substring_index(full, " ", -1)),
            date_of_birth=tx.to_date(get("date of birth")),
            place_of_birth=get("place of birth"),
            nationality=get("nationality"),
            gender=get("sex", "gender", value="M|F|X|Other"),
        ),
        address=_address(get("address")),
        verification=_record(("kyc", "verification"), mrz_data=zone),
        additional_info=_record(
            ("kyc", "additional_info"),
            document_holder_signature=F.lower(get("holder signature", "signature")).isin("yes", "present", "signed"),
            endorsements=_listed(get("endorsements", "endorsement")),
            restrictions=_listed(get("restrictions", "restriction")),
        ),
        utility_bill_specific=_record(
            ("kyc", "utility_bill_specific"),
            utility_type=F.lower(get("utility type", "utility")),
            billing_period=get("billing period"),
            amount_due=tx.to_amount(get("amount due")),
        ),
    )


def _listed(value: Column) -> Column:
    """`A, B; C` as a list; `none` and nothing as an empty one."""
    parts = F.transform(F.split(value, "[,;]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "") & (F.lower(p) != "none"))


def _address(full: Column) -> Column:
    """`street, city[, state] [postal code][, country]` taken apart at its commas; parts that are not
    there stay null."""
    parts = F.transform(F.split(full, ","), lambda p: F.trim(p))
    code = r"\b([A-Z]{0,2}[0-9][0-9A-Z]*(?:[ -][0-9][0-9A-Z]*)?)$"
    last = F.size(parts) - 1
    country = F.when((last >= 2) & ~F.get(parts, last).rlike(r"[0-9]"), F.get(parts, last))
    region = F.get(parts, F.when(country.isNotNull(), last - 1).otherwise(last))
    region = F.when(F.size(parts) - country.isNotNull().cast("int") >= 3, region)
    city = F.get(parts, F.lit(1))
    postal = F.coalesce(tx.blank_to_null(F.regexp_extract(region, code, 1)), tx.blank_to_null(F.regexp_extract(city, code, 1)))
    bare = lambda c: tx.blank_to_null(F.trim(F.regexp_replace(c, code, "")))
    return _record(
        ("kyc", "address"),
        full_address=full,
        street=tx.blank_to_null(F.get(parts, F.lit(0))),
        city=bare(city),
        state=bare(region),
        postal_code=postal,
        country=country,
    )


# --- receipts (X16) ------------------------------------------------------------------------------


def extract_receipt(df: DataFrame, text: str = "text", into: str = "receipt") -> DataFrame:
    """Store, transaction, items, totals, payment, promotion and loyalty fields."""
    return df.withColumn(into, receipt_of(F.col(text)))


def receipt_of(text: Column) -> Column:
    return tx.let(tx.fields(text), _receipt)


def _receipt(f: Column) -> Column:
    t, get = f["text"], partial(tx.labelled, f)
    total = get("total")
    items = F.transform(
        line_items(t),
        lambda i: F.struct(
            i["description"].alias("description"),
            tx.blank_to_null(F.regexp_extract(i["description"], r"\[([^\]]+)\]", 1)).alias("sku"),
            i["quantity"].alias("quantity"),
            i["unit_price"].alias("unit_price"),
            i["amount"].alias("amount"),
            tx.to_amount(tx.blank_to_null(F.regexp_extract(i["description"], r"(?i)\bless ([^ )\]]+)", 1))).alias("discount"),
        ),
    )
    tax_line = r"(?m)^ *([A-Za-z]+) \(([0-9]+(?:\.[0-9]+)?) ?%\) *: *([^\r\n]*[^\r\n ])"
    taxes = F.filter(
        F.transform(
            tx.all_matches(t, tax_line),
            lambda line: F.struct(
                F.regexp_extract(line, tax_line, 1).alias("type"),
                F.regexp_extract(line, tax_line, 2).try_cast("double").alias("rate"),
                tx.to_amount(F.regexp_extract(line, tax_line, 3)).alias("amount"),
            ),
        ),
        lambda x: x["amount"].isNotNull(),
    )
    offer = r"(?m)^ *(?:Promotion|Coupon)(?: \(([^)\n]+)\))? *: *([^\r\n]*?)(?:, *(-?[^ ,\r\n]*[0-9][^ ,\r\n]*))?$"
    promotions = F.transform(
        tx.all_matches(t, offer),
        lambda line: F.struct(
            tx.blank_to_null(F.regexp_extract(line, offer, 1)).alias("code"),
            F.regexp_extract(line, offer, 2).alias("description"),
            F.abs(tx.to_amount(tx.blank_to_null(F.regexp_extract(line, offer, 3)))).alias("discount"),
        ),
    )
    return _typed(
        "receipt",
        store=_record(
            ("receipt", "store"),
            name=get("store"),
            address=get("address"),
            phone=get("phone", "tel"),
            store_id=get("store id", value=NUMBER),
        ),
        transaction=_record(
            ("receipt", "transaction"),
            receipt_number=get("receipt no", "receipt number", "receipt #", value=NUMBER),
            date=tx.to_date(get("date")),
            time=receipt_time(get("time")),
            cashier=get("cashier"),
            register=get("register"),
        ),
        line_items=items,
        totals=_record(
            ("receipt", "totals"),
            subtotal=tx.to_amount(get("subtotal")),
            tax=tx.to_amount(get("tax")),
            tax_breakdown=taxes,
            total=tx.to_amount(total),
            currency=_leading_currency(total),
        ),
        promotions=promotions,
        payment=_record(
            ("receipt", "payment"),
            method=F.lower(get("paid by", value="[A-Za-z_]+")),
            card_last_four=tx.blank_to_null(F.regexp_extract(get("card"), "([0-9]{4})$", 1)),
            amount_tendered=tx.to_amount(get("tendered")),
            change=tx.to_amount(get("change")),
        ),
        loyalty=_record(
            ("receipt", "loyalty"),
            member_id=get("member", value=NUMBER),
            points_earned=get("points earned", value="[0-9]+").try_cast("double"),
            points_redeemed=get("points redeemed", value="[0-9]+").try_cast("double"),
            points_balance=get("points balance", value="[0-9]+").try_cast("double"),
        ),
    )


def receipt_time(raw: Column) -> Column:
    """`9:05`, `21:07:09` or `9:05 PM` as HH:mm:ss."""
    hour = F.regexp_extract(raw, r"^([0-9]{1,2}):", 1).try_cast("int")
    minute = F.regexp_extract(raw, r":([0-9]{2})", 1)
    second = F.coalesce(tx.blank_to_null(F.regexp_extract(raw, r":[0-9]{2}:([0-9]{2})", 1)), F.lit("00"))
    half = F.upper(F.regexp_extract(raw, r"(?i)([ap])m\b", 1))
    clock = F.when(half == "P", hour % 12 + 12).when(half == "A", hour % 12).otherwise(hour)
    return F.when(
        (minute != "") & (clock < 24), F.concat_ws(":", F.lpad(clock.cast("string"), 2, "0"), minute, second)
    )


# --- custom rules (X23, X24) ---------------------------------------------------------------------

# Our own patterns for the extra fields of the built-in types.
INVOICE_EXTENSION = [
    {"name": "po_reference", "scope": "invoice", "pattern": r"\bPO-[0-9]+\b"},
    {"name": "early_payment_discount", "scope": "invoice", "pattern": tx.DISCOUNT_PATTERN},
    {"name": "shipping_charges", "scope": "invoice", "pattern": tx.SHIPPING_PATTERN, "group": 1},
    {"name": "credit_adjustments", "scope": "invoice", "pattern": tx.CREDIT_PATTERN, "group": 1},
]
AGREEMENT_EXTENSION = [
    {"name": "sla_commitments", "scope": "agreement", "pattern": r"(?i)\b[0-9]+(?:\.[0-9]+)? ?% uptime\b"},
    {"name": "compliance_requirements", "scope": "agreement", "pattern": r"\b(?:GDPR|SOX|SOC2|HIPAA)\b"},
    {"name": "service_credits", "scope": "agreement", "pattern": r"(?i)\bservice credits? of [^.\n]+"},
    {"name": "escalation_procedures", "scope": "agreement", "pattern": r"(?i)\bescalat(?:e|es|ed|ion) [^.\n]+"},
]
_LEVELS = {"field": 0, "type": 1, "global": 2}


def apply_rules(
    df: DataFrame,
    rules: Iterable[Mapping],
    text: str = "text",
    document_type: str = "document_type",
    into: str = "custom_extractions",
) -> DataFrame:
    """Named pattern rules into a map.

    A rule has `name`, `pattern`, optional `group`, `scope` (`global` or a type) and `level` (field,
    type or global; by default what the scope says). Per name the highest level that finds something
    wins: field over type over global, then list order. Several matches are joined by `; `. Each rule
    is one literal pattern in the projection, so the texts are neither joined nor shuffled.
    """
    ranked: dict[str, list[tuple[int, Column]]] = {}
    for rule in rules:
        scope = rule.get("scope", "global")
        level = _LEVELS[rule.get("level", "global" if scope == "global" else "type")]
        found = F.array_join(
            F.array_distinct(tx.all_matches(F.col(text), rule["pattern"], rule.get("group", 0))), "; "
        )
        value = tx.blank_to_null(found)
        if scope != "global":
            value = F.when(F.col(document_type) == scope, value)
        ranked.setdefault(rule["name"], []).append((level, value))
    entries = [
        F.struct(F.lit(name).alias("key"), F.coalesce(*[v for _, v in sorted(c, key=lambda x: x[0])]).alias("value"))
        for name, c in ranked.items()
    ]
    return df.withColumn(into, F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())))


def extend_type(
    df: DataFrame, rules: Iterable[Mapping], fields: Sequence[str], text: str = "text", into: str = "custom_extractions"
) -> DataFrame:
    """Extra fields of a built-in type (X24): apply the rules, keep the requested fields."""
    ruled = apply_rules(df, rules, text, into=into)
    return ruled.withColumn(into, F.map_filter(into, lambda k, _: k.isin(list(fields))))


def finalize(df: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Default currency, of invoices (`financial`) and receipts (`totals`), and extraction timestamp."""
    for amounts in ("financial", "totals"):
        if amounts in df.columns:
            filled = F.coalesce(F.col(f"{amounts}.currency"), F.lit(schemas.DEFAULT_CURRENCY))
            df = df.withColumn(amounts, F.col(amounts).withField("currency", filled))
    return df.withColumn("extraction_timestamp", F.current_timestamp() if stamp is None else stamp)


def medical_code_counts(df: DataFrame, codes: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """ICD-10 and CPT codes per document with counts and the code table's description.

    Mentions become rows and are counted by (document, system, code), map-side first, so neither a long
    text nor a frequent code is a burden of its own.
    """
    system = lambda name, c: F.transform(c, lambda x: F.struct(F.lit(name).alias("system"), x.alias("code")))
    found = F.concat(system("ICD-10", tx.icd10_codes(F.col(text))), system("CPT", tx.cpt_codes(F.col(text))))
    mentions = df.select(doc, F.explode(found).alias("c")).groupBy(doc, "c.system", "c.code")
    counted = mentions.agg(F.count(F.lit(1)).cast("int").alias("mentions"))
    return join_skewed(counted, codes, ["system", "code"], F.col(doc), "left")
