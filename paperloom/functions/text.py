"""Column functions that read facts out of whole texts (X17-X22 and the helpers of X8-X16).

Patterns stay in the subset that Java and RE2 share: no look-around, no back-references.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# Candidate shapes. Each starts with one character class, which lets the regex engine skip most of a
# text; what they match too much is removed by parsing the (few) matches.
DATE_PATTERN = (
    r"\b[0-9JFMASOND](?:[0-9]{3}-[0-9]{2}-[0-9]{2}"
    r"|[0-9]?/[0-9]{1,2}/[0-9]{4}"
    r"|[0-9]? (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* [0-9]{4}"
    r"|(?:an|eb|ar|pr|ay|un|ul|ug|ep|ct|ov|ec)[a-z]* [0-9]{1,2}, [0-9]{4})\b"
)
# An amount with its currency before or behind it and its sign: a minus or an opening bracket that no word
# precedes, a minus that no word follows, a closing bracket. A currency between two numbers belongs to the
# second; only that needs a look-ahead (this pattern is Java's alone). A number is taken whole, since what may follow
# it never follows a part of it; the look-ahead in front passes over most of a text.
_SIGNED = r"[0-9]++(?:[.,]++[0-9]++)*+(?:-?\)|-\B)?"
MONEY_CANDIDATE = (
    r"(?=[-($£UEG0-9]|€)(?:"
    rf"(?:\B[-(])?[$€£UEG](?:SD|UR|BP)? ?[-(]?{_SIGNED}"
    rf"|(?:\B[-(])?\b{_SIGNED} ?(?:[$€£]|(?:USD|EUR|GBP)\b)(?! ?[-(]?[0-9])\)?)"
)
CURRENCY = r"[$€£]|USD|EUR|GBP"
MONEY_PATTERN = r"(?:[$€£]|USD|EUR|GBP) ?[0-9](?:[0-9.,]*[0-9])?"
COMPLIANCE_TERMS = ["GDPR", "SOX", "SOC2", "HIPAA"]
CURRENCY_OF_SIGN = {"$": "USD", "€": "EUR", "£": "GBP"}
# Numbers are taken whole, since what follows them never follows a part of one (Java's alone, like the amounts above).
DISCOUNT_PATTERN = r"\b([0-9]++(?:\.[0-9]++)?+) ?%,? ?/?([0-9]++),? [Nn][Ee][Tt] ?([0-9]++)"
NET_PATTERN = r"\b[Nn][Ee][Tt] ?([0-9]+)"
TAX_RATE_PATTERN = r"(?i)\b(?:tax|vat|gst)[^0-9%\n]{0,20}([0-9]+(?:\.[0-9]+)?) ?%"
SHIPPING_PATTERN = r"(?im)^\s*shipping[^:\n]*: ?[^0-9\n]*([0-9](?:[0-9.,]*[0-9])?)"
CREDIT_PATTERN = r"(?im)^\s*credit (?:note|adjustment)[^:\n]*: ?[^0-9\n]*([0-9](?:[0-9.,]*[0-9])?)"
# Shapes of a number without sign and currency. `1.234` alone may be either and is no amount.
POINT_DECIMAL = r"^(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]{1,2})?$|^(?:0|[0-9]{4,})\.[0-9]+$|^[0-9]+\.[0-9]{4,}$"
COMMA_DECIMAL = r"^(?:[0-9]+|[0-9]{1,3}(?:\.[0-9]{3})+),[0-9]{1,2}$|^[0-9]{1,3}(?:\.[0-9]{3}){2,}$"
PLAIN_AMOUNT = r"^[0-9]+(?:\.[0-9]{1,2})?$"
# The most common shapes, whose groups without what is around and between them are a plain amount.
USUAL_AMOUNT = (
    r"^[^0-9.,()\-]*+(?:([0-9]{1,3})(?:,([0-9]{3}))?+(?:,([0-9]{3}))?+(?:,([0-9]{3}))?+|([0-9]{4,}+))"
    r"(\.[0-9]{1,2})?+[^0-9.,()\-]*+$"
)
AMOUNT_SHAPE = r"^(\(?-?)([0-9](?:[0-9.,]*[0-9])?)(-?\)?)[.,]?$"
ICD10_PATTERN = r"\b[A-TV-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?\b"
CPT_PATTERN = r"\b[0-9]{5}\b"


def blank_to_null(c: Column) -> Column:
    return let(c, lambda v: F.when(v != "", v))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of one group; the group is always named because engines differ in the default."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


# A line `Label: value`; a remark in brackets after the label is not part of its name.
LABEL_LINE = r"(?m)^ *([A-Za-z][A-Za-z #/]*[A-Za-z#])\.?(?: *\([^)\n]*\))? *: *([^\r\n]*[^\r\n ])"


def fields(text: Column) -> Column:
    """The text with all its `Label: value` lines: struct of text, labels (lower case, between commas, which no label
    holds) and values.

    Bind it with `let` and the text is scanned once; fields are then looked up in the short list.
    """
    return F.struct(
        text.alias("text"),
        F.lower(F.array_join(all_matches(text, LABEL_LINE, 1), ",")).alias("labels"),
        all_matches(text, LABEL_LINE, 2).alias("values"),
    )


def labelled(f: Column, *names: str, value: str | None = None) -> Column:
    """Value of the first of `names` that labels a line, cut to its leading `value` match if given.

    A label is found by `find_in_set`: `array_position` leaves its loop by an exception, several times the cost."""
    found = F.coalesce(*[F.get(f["values"], F.find_in_set(F.lit(n), f["labels"]) - 1) for n in names])
    return found if value is None else blank_to_null(F.regexp_extract(found, f"^(?:{value})", 0))


def to_amount(text: Column) -> Column:
    """An amount of money as DECIMAL(18,2), by its shape: `1,234.50` and `1.234,50`, `(20.00)`, `-20.00`
    and `20.00-` (all three negative), with currency names or signs around it. Null for anything else,
    and where the shape leaves open what a separator means (`1.234`)."""

    def point(number: Column) -> Column:
        return F.replace(number, F.lit(","), F.lit("")).try_cast("decimal(18,2)")

    def comma(number: Column) -> Column:
        return F.translate(number, ",.", ".").try_cast("decimal(18,2)")

    def read(number: Column) -> Column:
        return F.when(number.rlike(POINT_DECIMAL), point(number)).when(number.rlike(COMMA_DECIMAL), comma(number))

    def signed(bare: Column) -> Column:
        before, number, after = (F.regexp_extract(bare, AMOUNT_SHAPE, i) for i in (1, 2, 3))
        minus = lambda a: (-a).cast("decimal(18,2)")
        by_sign = lambda sign: F.when(sign == "", let(number, read)).when(
            sign.isin("-", "()"), minus(let(number, read))
        )
        return let(F.concat(before, after), by_sign)

    def parsed(bare: Column) -> Column:  # most need no look at signs
        return F.when(bare.rlike(POINT_DECIMAL), point(bare)).when(bare.rlike(COMMA_DECIMAL), comma(bare)).otherwise(
            signed(bare)
        )

    def shaped(raw: Column) -> Column:
        usual = F.regexp_replace(raw, USUAL_AMOUNT, "$1$2$3$4$5$6")
        other = lambda: let(F.regexp_replace(raw, r"[^0-9.,()\-]+", ""), parsed)
        by_shape = lambda u: F.when(u.rlike(PLAIN_AMOUNT), u.try_cast("decimal(18,2)")).otherwise(other())
        return F.when(raw.isNotNull(), let(usual, by_shape))

    return let(text, shaped)


def to_date(text: Column) -> Column:
    """ISO, month/day/year, `April 4, 2000` and `4 April 2000` to DATE; the shape picks the format, so a
    row is parsed once; impossible dates are null."""

    def parsed(raw: Column) -> Column:
        short = F.regexp_replace(raw, r"([A-Za-z]{3})[a-z]*", "$1")
        return (
            F.when(raw.rlike(r"^[0-9]{4}-"), F.try_to_date(raw, "yyyy-MM-dd"))
            .when(raw.contains("/"), F.try_to_date(raw, "M/d/yyyy"))
            .when(raw.rlike(r"^[A-Za-z]"), F.try_to_date(short, "MMM d, yyyy"))
            .when(raw.rlike(r"^[0-9]{1,2} "), F.try_to_date(short, "d MMM yyyy"))
        )

    return let(text, parsed)


def iso_dates(text: Column) -> Column:
    """All dates of a text as ISO strings, in order of appearance."""
    return F.array_compact(F.transform(all_matches(text, DATE_PATTERN), lambda d: to_date(d).cast("string")))


def compliance_mentions(text: Column, terms: Sequence[str] = tuple(COMPLIANCE_TERMS)) -> Column:
    """Distinct regulation names in order of appearance, upper case."""
    pattern = r"(?i)\b(?:" + "|".join(terms) + r")\b"
    return F.array_distinct(F.transform(all_matches(text, pattern), F.upper))


def payment_terms(text: Column) -> Column:
    """`2% 10 net 30` -> percentage, discount days, net days; plain `net 30` -> net days only."""

    def terms(phrase: Column) -> Column:
        part = lambda i: F.when(phrase != "", F.regexp_extract(phrase, DISCOUNT_PATTERN, i))
        plain = F.when(phrase == "", let(F.regexp_extract(text, NET_PATTERN, 1), blank_to_null))
        return F.struct(
            part(1).cast("double").alias("percentage"),
            part(2).cast("int").alias("days"),
            F.coalesce(part(3), plain).cast("int").alias("net_days"),
        )

    return let(F.regexp_extract(text, DISCOUNT_PATTERN, 0), terms)


def tax_rates(text: Column) -> Column:
    return F.transform(all_matches(text, TAX_RATE_PATTERN, 1), lambda r: r.cast("double"))


def shipping_charges(text: Column) -> Column:
    return F.transform(all_matches(text, SHIPPING_PATTERN, 1), to_amount)


def credit_adjustments(text: Column) -> Column:
    return F.transform(all_matches(text, CREDIT_PATTERN, 1), to_amount)


def currency_of(token: Column) -> Column:
    """ISO code of a money token that starts with a code or a sign."""
    signs = [x for k, v in CURRENCY_OF_SIGN.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*signs)[F.substring(token, 1, 1)], F.substring(token, 1, 3))


def money_mentions(text: Column) -> Column:
    """All amounts with a currency, in order of appearance (X21): the currency stands before or behind the
    number, a minus before or behind, or brackets around it, make it negative. A bracket without its
    partner is punctuation; an amount whose shape leaves its value open is null."""
    found = F.filter(all_matches(text, MONEY_CANDIDATE), lambda m: m.rlike(CURRENCY))
    paired = lambda m: F.when(m.contains("(") & m.contains(")"), m).otherwise(F.translate(m, "()", ""))
    code = lambda m: currency_of(F.regexp_extract(m, f"({CURRENCY})", 1))
    return F.transform(found, lambda m: F.struct(code(m).alias("currency"), to_amount(paired(m)).alias("amount")))


def icd10_codes(text: Column) -> Column:
    return all_matches(text, ICD10_PATTERN)


def cpt_codes(text: Column) -> Column:
    return all_matches(text, CPT_PATTERN)


def duration_days(text: Column) -> Column:
    """`2 years`, `60 days`, `Net 30` as a number of days (year = 365, month = 30, week = 7)."""
    amount = F.regexp_extract(text, r"(?i)([0-9]+) *(?:day|week|month|year)", 1).try_cast("int")
    unit = F.lower(F.regexp_extract(text, r"(?i)[0-9]+ *(day|week|month|year)", 1))
    factor = F.when(unit == "year", 365).when(unit == "month", 30).when(unit == "week", 7).when(unit == "day", 1)
    return F.coalesce(amount * factor, F.regexp_extract(text, NET_PATTERN, 1).try_cast("int"))
