"""Documents derived from the test tables by Spark, row for row, so every query grows with them.

The same derivations exist as DuckDB CTEs in `oracle_inputs.py`. Faults are planted by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a test table that is a single file: costly text is rendered per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _pad(key: Column, width: int = 8) -> Column:
    """Zero-pad without ever cutting a longer key."""
    text = key.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def _money(value: float | str) -> Column:
    return F.lit(str(value)).cast(MONEY)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice per (order, supplier); its lines stay in lineitem, only their total and count come along."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("order_key"), F.col("l_suppkey").alias("supp_key"))
        .agg(
            F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("line_total"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), "o_custkey", F.col("o_orderdate").cast("date").alias("invoice_date")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("customer_name")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supp_key"), F.col("s_name").alias("vendor_name")
    )
    base = lines.join(orders, "order_key").join(customers, "o_custkey").join(suppliers, "supp_key")
    key = F.col("order_key")
    planted = (
        F.when(key % 17 == 0, _money(0))
        .when(key % 7 == 0, F.col("line_total") + _money("1.00"))
        .when(key % 19 == 0, F.col("line_total") + _money("0.01"))
        .when(key % 23 == 0, F.col("line_total") + _money("0.02"))
        .otherwise(F.col("line_total"))
        .cast(MONEY)
    )
    number = F.concat(F.lit("INV-"), _pad(key), F.lit("-"), F.col("supp_key").cast("string"))
    shaped = (
        base.withColumn("subtotal", planted)
        .withColumn("tax", (F.col("line_total") * F.lit("0.07").cast("decimal(3,2)")).cast(MONEY))
        .withColumn(
            "total",
            (F.col("subtotal") + F.col("tax") + F.when(key % 29 == 0, _money("0.05")).otherwise(_money(0))).cast(MONEY),
        )
    )
    return shaped.select(
        (key * 10_000_000 + F.col("supp_key")).alias("ord"),
        F.concat(F.lit("inbox/"), number, F.lit(".pdf")).alias("path"),
        "order_key",
        "supp_key",
        F.lit("invoice").alias("document_type"),
        F.struct(
            F.when(key % 13 != 0, number).alias("invoice_number"),
            "invoice_date",
            F.when(key % 11 == 0, F.date_sub("invoice_date", 1))
            .otherwise(F.date_add("invoice_date", 30))
            .alias("due_date"),
            F.when(key % 5 != 0, F.concat(F.lit("PO-"), _pad(key))).alias("po_number"),
            ((key % 101) / F.lit(100.0)).alias("confidence"),
        ).alias("metadata"),
        F.struct(F.col("vendor_name").alias("name")).alias("vendor"),
        F.struct(F.col("customer_name").alias("name")).alias("customer"),
        F.struct(
            "subtotal",
            "tax",
            F.col("total").alias("total_amount"),
            F.when(key % 3 == 1, "USD").when(key % 3 == 2, "EUR").alias("currency"),
        ).alias("financial"),
        "line_total",
        "n_lines",
    )


def purchase_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase order per order that is not pending."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "P")
    return orders.select(F.concat(F.lit("PO-"), _pad(F.col("o_orderkey"))).alias("po_number"))


AGREEMENT_TYPES = ["NDA", "MSA", "SOW", "SLA", "License", "Partnership", "Employment", "Other"]


def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three contracts per supplier with staggered intervals; some single-party, reversed or without an end."""
    base = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot")
    )
    key, slot = F.col("s_suppkey"), F.col("slot")
    effective = F.date_add(F.lit("1995-01-01").cast("date"), ((key * 37 + slot * 700) % 2000).cast("int"))
    dated = base.withColumn("effective_date", effective).withColumn(
        "expiry_date",
        F.when((key * 3 + slot) % 11 == 0, F.date_sub("effective_date", 10))
        .when((key * 3 + slot) % 7 == 5, F.lit("9999-12-31").cast("date"))
        .otherwise(
            F.date_add("effective_date", (365 * (1 + (key + slot) % 6)).cast("int"))
        ),
    )
    types = F.array(*[F.lit(t) for t in AGREEMENT_TYPES])
    kind = (key + slot) % 9
    party = lambda role, name: F.struct(F.lit(role).alias("role"), name.alias("name"))
    vendor = party("vendor", F.col("s_name"))
    client = party("client", F.concat(F.lit("Customer#"), _pad(key * 10, 9)))
    return dated.select(
        (key * 3 + slot).alias("ord"),
        F.concat(F.lit("contracts/AGR-"), key.cast("string"), F.lit("-"), slot.cast("string"), F.lit(".pdf")).alias(
            "path"
        ),
        F.lit("agreement").alias("document_type"),
        F.struct(
            F.when(kind < 8, F.element_at(types, (kind + 1).cast("int"))).alias("agreement_type"),
            F.concat(F.lit("AGR-"), key.cast("string"), F.lit("-"), slot.cast("string")).alias("agreement_id"),
            "effective_date",
            "expiry_date",
        ).alias("metadata"),
        F.when((key + slot) % 9 == 4, F.array(vendor)).otherwise(F.array(vendor, client)).alias("parties"),
        (((key * 7919 + slot * 104729) % 40 + 1) * 1_000_000).cast(MONEY).alias("cap"),
    )


RESULT_TYPES = ["invoice", "agreement", "kyc", "receipt", "document"]


def scored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored result per document; confidence takes every value 0.00 .. 1.00, 0.70 included."""
    doc = F.col("doc_id")
    types = F.array(*[F.lit(t) for t in RESULT_TYPES])
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(doc % 6 < 5, F.element_at(types, (doc % 6 + 1).cast("int"))).alias("document_type"),
        ((doc % 101) / F.lit(100.0)).alias("confidence"),
        (F.col("n_chars") % 5000).alias("duration_ms"),
        (doc % 17 == 0).alias("failed"),
        (doc % 4 == 1).alias("cache_hit"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three extraction attempts per document with ties in confidence."""
    doc, n = F.col("doc_id"), F.col("attempt")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt")
    ).select(
        "doc_id",
        "attempt",
        ((doc * 31 + n * n * 7) % 11 / F.lit(10.0)).alias("confidence"),
        F.concat_ws("-", F.lit("v"), doc.cast("string"), n.cast("string")).alias("value"),
        "n_chars",
    )


FIELDS = ["number", "vendor", "total"]


def attempt_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field values per attempt; confidences around the 0.3 limit, some values missing."""
    fields = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("field")) for i, f in enumerate(FIELDS)])
    rows = attempts(spark, sf_dir).select("doc_id", "attempt", F.explode(fields).alias("f")).select(
        "doc_id", "attempt", "f.*"
    )
    doc, n, i = F.col("doc_id"), F.col("attempt"), F.col("i")
    return rows.select(
        "doc_id",
        "attempt",
        "field",
        F.when((doc + n + i) % 7 != 0, F.concat_ws("-", F.col("field"), doc.cast("string"), n.cast("string"))).alias(
            "value"
        ),
        ((doc * 13 + n * 5 + i * 3) % 10 / F.lit(10.0)).alias("confidence"),
    )


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files per order in folders of several spellings, each with vendor and customer."""
    key = F.col("o_orderkey")
    group = F.floor(key / 3).cast("string")
    text = key.cast("string")
    names = (
        F.when(key % 4 == 0, F.array(F.concat(F.lit("a/INV-"), group, F.lit(".pdf")), F.concat(F.lit("b/INV_"), group, F.lit(".pdf"))))
        .when(key % 4 == 1, F.array(F.concat(F.lit("a/INV-"), group, F.lit(".pdf")), F.concat(F.lit("c/PO-"), group, F.lit(".pdf"))))
        .when(key % 4 == 2, F.array(F.concat(F.lit("x/invoice-"), group, F.lit(".pdf")), F.concat(F.lit("y/invoice_"), group, F.lit("_part1.pdf"))))
        .when(key % 8 == 3, F.array(F.concat(F.lit("deal"), text, F.lit("_part1.pdf")), F.concat(F.lit("deal"), text, F.lit("-part-2.pdf"))))
        .otherwise(F.array(F.concat(F.lit("Deal"), text, F.lit("_v1.pdf")), F.concat(F.lit("deal"), text, F.lit("-v2.pdf"))))
    )
    return (
        spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
        .select("o_orderkey", "o_custkey", F.posexplode(names).alias("i", "path"))
        .select(
            (key * 2 + F.col("i")).alias("ord"),
            "path",
            F.array(
                F.concat(F.lit("Vendor "), (key % 97).cast("string")),
                F.concat(F.lit("Client "), F.floor(F.col("o_custkey") / 2).cast("string")),
            ).alias("entities"),
        )
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with every suffix and stem trap of the classifier, with an optional content hint."""
    key = F.col("o_orderkey")
    stems = F.array(*[F.lit(s) for s in STEMS])
    suffixes = F.array(*[F.lit(s) for s in SUFFIXES])
    hints = F.array(*[F.lit(h) for h in HINTS])
    return spread(table(spark, sf_dir, "orders").select("o_orderkey")).select(
        "o_orderkey",
        F.concat(
            F.lit("in/"),
            F.element_at(stems, (key % len(STEMS) + 1).cast("int")),
            F.lit("_"),
            key.cast("string"),
            F.element_at(suffixes, (F.floor(key / 7) % len(SUFFIXES) + 1).cast("int")),
        ).alias("path"),
        F.element_at(hints, (F.floor(key / 5) % len(HINTS) + 1).cast("int")).alias("hint"),
    )


STEMS = ["invoice", "video", "company", "border", "policy_invoice", "Contract", "scan", "LEASE", "notes", "msa", "page", "visa"]
SUFFIXES = [".pdf", ".zip", ".TAR.GZ", ".tgz", ".eml", ".Msg", ".docx", "", ".7z", ".json", ".html"]
HINTS = ["", "A Payment is due", "Terms apply", "holder of this PASSPORT", "plain text", None]


# --- rendered texts ----------------------------------------------------------------------------


def _dated(date: Column, style: Column) -> Column:
    """A date in one of four spellings."""
    return (
        F.when(style == 0, F.date_format(date, "yyyy-MM-dd"))
        .when(style == 1, F.date_format(date, "MM/dd/yyyy"))
        .when(style == 2, F.date_format(date, "MMMM d, yyyy"))
        .otherwise(F.date_format(date, "d MMM yyyy"))
    )


def _cents(cents: Column) -> Column:
    return (cents / F.lit(100).cast("decimal(3,0)")).cast(MONEY)


def _amount(cents: Column) -> Column:
    """`format_number` of an amount in cents with two decimals; below a million, as nearly all are, by its digits."""
    text = F.when(cents < 100, F.lpad(cents.cast("string"), 3, "0")).otherwise(cents.cast("string"))
    whole = F.when(cents < 100_000, F.left(text, F.length(text) - 2)).otherwise(
        F.concat(F.left(text, F.length(text) - 5), F.lit(","), F.substring(text, -5, 3))
    )
    small = F.concat(whole, F.lit("."), F.substring(text, -2, 2))
    return F.when((cents >= 0) & (cents < 100_000_000), small).otherwise(F.format_number(_cents(cents), 2))


def _lines(*parts: Column | str) -> Column:
    """Join lines, leaving out null ones."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _line(label: str, *values: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), *values)


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered invoice per lineitem row: two items, charges, terms, dates in four spellings."""
    raw = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    rows = spread(raw).select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("n"),
        F.col("l_suppkey").alias("s"),
        F.col("l_partkey").alias("p"),
        F.col("l_quantity").cast("bigint").alias("q"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"),
        F.col("l_shipdate").cast("date").alias("d"),
    )
    k, c, q = F.col("k"), F.col("c"), F.col("q")
    text = lambda name: F.col(name).cast("string")
    sign = F.when(k % 3 == 0, "$").when(k % 3 == 1, "EUR ").otherwise("£")
    tax = F.floor(c * 7 / 100)
    # each amount is formatted once, by one expression: the code that Spark makes of it stays short enough to be compiled
    amounts = {
        "price": F.floor(c / q), "line": c, "subtotal": c + 1250, "tax": tax, "shipping": k % 90 * 100,
        "credit": F.lit(500).cast("bigint"), "total": c + 1250 + tax + k % 90 * 100,
    }
    rows = rows.withColumn("plain", F.transform(F.array(*amounts.values()), _amount))
    comma = F.transform("plain", lambda amount: F.translate(amount, ",.", ".,"))
    rows = rows.withColumn("spelled", F.when(k % 5 == 1, comma).otherwise(F.col("plain")))
    plain = lambda name: F.col("plain")[list(amounts).index(name)]
    shown = lambda name: F.concat(sign, F.col("spelled")[list(amounts).index(name)])
    # items between bars, tabs or blanks, half of them with a tax rate
    gap = F.when(k % 4 == 2, "\t").when(k % 4 == 3, "  ").otherwise(" | ")
    row = lambda *cells: F.concat_ws(
        "", *[x for cell in cells for x in (gap, cell)][1:], F.when(k % 2 == 0, F.concat(gap, F.lit("7%")))
    )
    body = _lines(
        "INVOICE",
        _line("Invoice Number", F.lit("INV-"), text("k"), F.lit("-"), text("n"), F.lit("-"), text("s")),
        _line("Invoice Date", _dated(F.col("d"), k % 4)),
        _line("Due Date", _dated(F.date_add("d", 30), (k + 1) % 4)),
        F.when(k % 5 != 0, _line("PO Number", F.lit("PO-"), text("k"))),
        _line("Vendor", F.lit("Supplier#"), _pad(F.col("s"), 9)),
        _line("Vendor Tax ID", F.lit("12-"), _pad(F.col("s"), 7)),
        F.when(k % 11 != 0, _line("Bill To", F.lit("Customer of order "), text("k"))),
        "",
        "No | Description | Quantity | Unit Price | Amount",
        row(F.lit("1"), F.concat(F.lit("Part "), text("p")), text("q"), plain("price"), plain("line")),
        row(*[F.lit(x) for x in ("2", "Handling", "1", "12.50", "12.50")]),
        "",
        _line("Subtotal", shown("subtotal")),
        _line("Tax (7%)", shown("tax")),
        _line("Shipping and handling", shown("shipping")),
        F.when(k % 6 == 0, _line("Credit note", shown("credit"))),
        F.when(k % 9 == 0, F.lit("Discount: (3.00)")).when(k % 9 == 1, F.lit("Discount: 3.00-")),
        _line("Total", shown("total")),
        F.when(k % 4 == 0, "Payment Terms: 2% 10 net 30").when(k % 4 == 1, "Payment Terms: Net 45"),
        F.when(k % 7 == 0, "Data is handled under GDPR and sox rules, see GDPR notice."),
    )
    return rows.select("k", "n", "s", "p", F.lit("invoice").alias("document_type"), body.alias("text"))


def agreement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered agreement per contract with clauses chosen by key."""
    docs = agreements(spark, sf_dir)
    k = F.col("ord")
    meta = lambda name: F.col(f"metadata.{name}")
    home = F.concat(F.lit("; "), k.cast("string"), F.lit(" Dock Road, represented by R. Agent, Director"))
    details = lambda p: F.when(p["role"] == "vendor", home).otherwise("")
    party = lambda p: F.concat(F.lit("Party ("), p["role"], F.lit("): "), p["name"], details(p))
    parties = F.array_join(F.transform("parties", party), "\n")
    vendor = F.col("parties")[0]["name"]
    header = _lines(
        _line("Agreement Type", meta("agreement_type")),
        _line("Agreement No", meta("agreement_id")),
        _line("Effective Date", _dated(meta("effective_date"), k % 4)),
        _line("Expiry Date", _dated(meta("expiry_date"), (k + 2) % 4)),
        _line("Term", (1 + k % 3).cast("string"), F.lit(" years")),
        parties,
        _line("Scope", F.lit("supply of lot "), k.cast("string")),
        "Governing Law: State of Delaware",
        F.concat(F.lit("Obligation (vendor): deliver lot "), k.cast("string"), F.lit(" by the fifth of each month")),
    )
    body = F.concat_ws(
        "\n\n",
        header,
        F.when(k % 2 == 0, F.concat(F.lit("A penalty of "), (k % 10).cast("string"), F.lit("% applies to late delivery."))),
        F.when(k % 3 == 0, F.lit("Liquidated damages are payable on breach and count as a penalty.")),
        F.when(k % 5 == 0, F.concat(F.lit("This agreement renews automatically for 12 months after a notice of "), (30 + k % 60).cast("string"), F.lit(" days.")))
        .when(k % 5 == 1, F.lit("Renewal needs 2 months notice.")),
        F.when(k % 4 == 0, "Either side may terminate for cause. Neither side is liable for delay."),
        F.when(k % 6 == 0, F.concat(F.lit("The service keeps 99.9% uptime under SOC2. Service credits of 5% apply. Faults escalate to desk "), k.cast("string"), F.lit("."))),
        F.concat(F.lit("Signed for vendor: Agent of "), vendor, F.lit(", Director, "), _dated(meta("effective_date"), k % 2)),
    )
    return docs.select("ord", "path", "document_type", body.alias("text"))


def identity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered passport per customer, zone included."""
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    k = F.col("c_custkey")
    surname = F.concat(F.lit("NAME"), F.translate((k % 1000).cast("string"), "0123456789", "ABCDEFGHIJ"))
    given = F.concat(F.lit("GIVEN"), F.translate(F.col("c_nationkey").cast("string"), "0123456789", "KLMNOPQRST"))
    number = F.concat(F.lit("P"), _pad(k, 8))
    born = F.date_add(F.lit("1940-01-01").cast("date"), (k * 37 % 25000).cast("int"))
    expires = F.date_add(F.lit("2024-01-01").cast("date"), (k * 11 % 4000).cast("int"))
    sex = F.when(k % 3 == 0, "M").when(k % 3 == 1, "F").otherwise("X")
    line1 = F.rpad(F.concat(F.lit("P<UTO"), surname, F.lit("<<"), given, F.lit("<"), F.lit("B")), 44, "<")
    line2 = F.concat(
        F.rpad(number, 9, "<"), F.lit("1UTO"), F.date_format(born, "yyMMdd"), F.lit("2"),
        F.when(sex == "X", "<").otherwise(sex), F.date_format(expires, "yyMMdd"), F.lit("3"),
        F.rpad((k % 5000).cast("string"), 14, "<"), F.lit("45"),
    )
    body = _lines(
        "PASSPORT",
        "Document Type: passport",
        _line("Passport No", number),
        _line("Full Name", F.initcap(given), F.lit(" B "), F.initcap(surname)),
        _line("Date of Birth", _dated(born, k % 4)),
        _line("Date of Expiry", _dated(expires, (k + 1) % 4)),
        _line("Sex", sex),
        "Nationality: Utopian",
        "Issuing Country: Utopia",
        _line("Address", (k % 200).cast("string"), F.lit(" Long Street, Port"), F.when(k % 2 == 0, ", UT 12345, Utopia").otherwise("")),
        F.when(k % 3 == 0, "Endorsements: crew; diplomat"),
        "Restrictions: none",
        F.when(k % 5 == 0, "Holder Signature: present"),
        "",
        line1,
        line2,
    )
    return rows.select("c_custkey", body.alias("text"))


def receipt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered till receipt per order."""
    raw = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    rows = spread(raw).select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("m"), F.col("o_orderdate").cast("date").alias("d"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"),
    )
    k, c = F.col("k"), F.col("c")
    money = lambda cents: F.format_number(_cents(cents), 2)
    body = _lines(
        _line("Store", F.lit("Shop "), (k % 50).cast("string")),
        _line("Store ID", F.lit("S"), (k % 50).cast("string")),
        _line("Receipt No", F.lit("R-"), k.cast("string")),
        _line("Date", _dated(F.col("d"), k % 4)),
        F.concat(F.lit("Time: "), (k % 12 + 1).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"),
                 F.when(k % 2 == 0, " PM").otherwise(" AM")),
        _line("Cashier", F.lit("C"), (k % 9).cast("string")),
        F.concat(F.lit("1 | Goods [SKU"), (k % 300).cast("string"), F.when(k % 4 == 0, "] less 0.50").otherwise("]"),
                 F.lit(" | 2 | "), money(F.floor(c / 2)), F.lit(" | "), money(c)),
        F.when(k % 3 == 0, "State (6%): 6.00"),
        F.when(k % 3 == 0, "City (4.5%): 4,50"),
        F.when(k % 5 == 0, "Promotion (SAVE5): spring offer, -5.00").when(k % 5 == 1, "Coupon: a bag for free"),
        _line("Subtotal", money(c)),
        _line("Tax (10%)", money(F.floor(c / 10))),
        _line("Total", F.lit("$"), money(c + F.floor(c / 10))),
        F.when(k % 2 == 0, "Paid by: Credit").otherwise("Paid by: CASH"),
        F.when(k % 2 == 0, F.concat(F.lit("Card: **** **** **** "), F.lpad((k % 10000).cast("string"), 4, "0"))),
        _line("Member", F.lit("M"), F.col("m").cast("string")),
        _line("Points earned", (k % 77).cast("string")),
    )
    return rows.select("k", body.alias("text"))


def medical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered visit note per order: two diagnosis codes, procedure codes named twice or once."""
    k = F.col("o_orderkey")
    code = lambda n: (10000 + n).cast("string")
    body = F.concat(
        F.lit("Diagnosis: E"), F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.lit(".9 and I10.\nProcedures: "),
        code(k % 2500), F.lit(", "), code((k + 7) % 2500), F.lit("; repeated "), code(k % 2500), F.lit("."),
    )
    return spread(table(spark, sf_dir, "orders").select("o_orderkey")).select(k.alias("doc_id"), body.alias("text"))


def medical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code table: one procedure code per part."""
    return table(spark, sf_dir, "part").select(
        F.lit("CPT").alias("system"), (10000 + F.col("p_partkey")).cast("string").alias("code"), F.col("p_name").alias("description")
    )


# --- parser output tables ------------------------------------------------------------------------


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a page."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select(
        "doc_id", (F.col("i") + 1).alias("page_number"), "text", ((F.col("doc_id") + F.col("i")) % 10 == 0).alias("has_images")
    )


def ocr_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of a document as a token; confidences run from -1 to 99."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[ \n]")).alias("position", "token"))
    i = F.col("position")
    return words.select(
        "doc_id", "position", "token", (i % 101 - 1).alias("conf"),
        (i % 20 * 50).alias("x"), (F.floor(i / 20) * 12).alias("y"), F.lit(40).alias("width"), F.lit(10).alias("height"),
    )


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 3 x 4 grid per order: header row with three names, a fourth column without header."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey").cast("string")
    cell = lambda r, c, v: F.struct(F.lit(r).alias("row"), F.lit(c).alias("column"), v.alias("value"))
    grid = [cell(0, c, F.lit(h)) for c, h in enumerate(["key", "status", "priority"])]
    for r in (1, 2):
        grid += [
            cell(r, 0, F.concat(key, F.lit(f"/{r}"))), cell(r, 1, F.col("o_orderstatus")),
            cell(r, 2, F.col("o_orderpriority")), cell(r, 3, F.lit("beyond")),
        ]
    return rows.select(F.col("o_orderkey").alias("table_id"), F.explode(F.array(*grid)).alias("c")).select("table_id", "c.*")


def found_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables per document, some too small or empty."""
    k, i = F.col("doc_id"), F.col("i")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i"))
    return rows.select(
        "doc_id", "i", ((k + i) % 5).alias("rows"), ((k + 2 * i) % 4).alias("columns"),
        F.when(k % 13 != 0, (k + i) % 3).alias("data_rows"), (50 + (k * 3 + i) % 50).cast("double").alias("accuracy"),
    )


def method_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each table method returned per document; some failed, some documents have none."""
    k = F.col("doc_id")
    tries = F.array(
        *[
            F.struct(F.lit(m).alias("method"), ((k + i) % (i + 2) == 0).alias("failed"), (k % 4 + i).alias("table_count"))
            for i, m in enumerate(["camelot", "pdfplumber", "tabula"])
        ]
    )
    rows = table(spark, sf_dir, "documents").filter(k % 10 != 3)
    return rows.select("doc_id", F.explode(tries).alias("t")).select("doc_id", "t.*")


# --- containers ------------------------------------------------------------------------------------


LINEAGE_LEVELS = 7  # between a source and its documents


def lineage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of nine levels over the documents: source -> seven levels of halving boxes -> document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    nothing = F.lit(None).cast("string")
    source = F.concat(F.lit("src:"), "source")

    def box(level: Column) -> Column:
        number = F.floor(F.col("doc_id") / F.pow(F.lit(2), level)).cast("string")
        return F.concat(F.lit("box"), level.cast("string"), F.lit(":"), "source", F.lit("/"), number)

    leaves = docs.select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("document_id"), source.alias("root_id"),
        box(F.lit(1)).alias("parent_id"), F.lit("document").alias("container_type"),
        F.lit(LINEAGE_LEVELS + 1).alias("extraction_depth"), F.sha2("text", 256).alias("file_hash"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
    )
    level = F.col("level")
    boxes = docs.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.lit(LINEAGE_LEVELS))).alias("level")).select(
        box(level).alias("document_id"), source.alias("root_id"),
        F.when(level == LINEAGE_LEVELS, source).otherwise(box(level + 1)).alias("parent_id"),
        F.lit("archive").alias("container_type"), (LINEAGE_LEVELS + 1 - level).alias("extraction_depth"), nothing.alias("file_hash"),
        F.concat(F.substring_index(box(level), "/", -1), F.lit(".zip")).alias("file_name"),
    ).distinct()
    sources = docs.select("source").distinct().select(
        source.alias("document_id"), source.alias("root_id"), nothing.alias("parent_id"), F.lit("archive").alias("container_type"),
        F.lit(0).alias("extraction_depth"), nothing.alias("file_hash"), F.concat(F.col("source"), F.lit(".tar")).alias("file_name"),
    )
    return leaves.unionByName(boxes).unionByName(sources)


def member_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of e-mail attachments, many repeated inside one message and some with forbidden characters;
    and one message whose repeats meet a taken number for every order."""
    i, key = F.col("i"), F.col("o_orderkey")
    taken = table(spark, sf_dir, "orders").select(
        F.lit("numbered").alias("parent_id"), key.alias("ordinal"), F.concat(F.lit("n_"), key.cast("string"), F.lit(".pdf")).alias("name")
    )
    repeats = table(spark, sf_dir, "orders").filter(key % 10 == 0).select(
        F.lit("numbered").alias("parent_id"), (key + 1_000_000_000).alias("ordinal"), F.lit("n.pdf").alias("name")
    )
    small = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 50).cast("string").alias("parent_id"), (F.col("o_orderkey") % 50).alias("i")
    ).select(
        "parent_id", i.alias("ordinal"),
        F.when(i % 3 == 0, F.concat(F.lit("scan"), (i % 4).cast("string"), F.lit(".pdf")))
        .when(i % 3 == 1, F.concat(F.lit(" in:voice/"), (i % 2).cast("string"), F.lit(".pdf ")))
        .otherwise(F.lit("readme")).alias("name"),
    )
    return small.unionByName(taken).unionByName(repeats)


def zipped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A real ZIP file per document, made inside the partitions: the text, a copy of it, a nested ZIP
    with the language, and a junk member."""

    def build(batches):
        import io
        import zipfile

        import pandas as pd

        def packed(members):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
                for name, data in members:
                    zf.writestr(name, data)
            return buf.getvalue()

        for batch in batches:
            out = []
            for doc_id, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"]):
                inner = packed([("lang.txt", f"{doc_id} {lang}"), ("again.txt", text)])
                members = [("text.txt", text), ("copy.txt", text), ("inner.zip", inner), ("__MACOSX/text.txt", "junk")]
                out.append((f"box/{doc_id}.zip", packed(members)))
            yield pd.DataFrame(out, columns=["path", "content"])

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return docs.mapInPandas(build, "path STRING, content BINARY")


def odd_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container per document of one of four kinds: a broken ZIP, a RAR, a ZIP nested five deep, and a ZIP
    that holds an e-mail with the document's language attached."""

    def build(batches):
        import io
        import zipfile

        import pandas as pd

        def packed(name, data):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w") as zf:
                zf.writestr(name, data)
            return buf.getvalue()

        def mail(lang):
            return (
                "Subject: s\nFrom: a@example.org\nMIME-Version: 1.0\nContent-Type: application/octet-stream\n"
                f'Content-Disposition: attachment; filename="lang.txt"\n\n{lang}'
            ).encode()

        for batch in batches:
            out = []
            for doc_id, lang in zip(batch["doc_id"], batch["lang"]):
                kind = doc_id % 4
                if kind == 0:
                    out.append((f"odd/{doc_id}.zip", b"PK is not enough"))
                elif kind == 1:
                    out.append((f"odd/{doc_id}.rar", b"Rar!"))
                elif kind == 2:
                    data, name = f"core {doc_id}".encode(), "core.txt"
                    for level in range(5):
                        data, name = packed(name, data), f"z{level}.zip"
                    out.append((f"odd/{doc_id}.zip", data))
                else:
                    out.append((f"odd/{doc_id}.zip", packed("m.eml", mail(lang))))
            yield pd.DataFrame(out, columns=["path", "content"])

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang"))
    return docs.mapInPandas(build, "path STRING, content BINARY")


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An e-mail per conversation turn: the turn as body and two attachments of the same name."""
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    part = lambda *lines: F.concat(F.lit("--=edge=\n"), *[F.lit(x) if isinstance(x, str) else x for x in lines])
    attachment = lambda text: part(
        'Content-Type: application/octet-stream\nContent-Disposition: attachment; filename="no:te.txt"\n\n', text, "\n"
    )
    raw = F.concat(
        F.lit("Subject: turn "), key, F.lit("\nFrom: "), F.col("role"), F.lit("@example.org\nTo: desk@example.org\nMessage-ID: <"), key,
        F.lit('@example.org>\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="=edge="\n\n'),
        part("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n", F.col("text"), "\n"),
        attachment(F.concat(F.lit("first "), key)), attachment(F.concat(F.lit("second "), key)), F.lit("--=edge=--\n"),
    )
    return table(spark, sf_dir, "conversations").select(key.alias("document_id"), raw.cast("binary").alias("content"))


def batch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed batch of texts with telling names: invoices, receipts, agreements, passports, archives that
    nothing extracts, and pages without a type."""
    of = lambda name, key, ext="pdf": F.concat(F.lit(f"in/{name}_"), key, F.lit(f".{ext}"))
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    invoice_key = F.concat_ws("-", F.col("k").cast("string"), F.col("n").cast("string"), F.col("s").cast("string"))
    parts = [
        invoice_texts(spark, sf_dir).select(of("invoice", invoice_key).alias("path"), "text"),
        receipt_texts(spark, sf_dir).select(of("receipt", F.col("k").cast("string")).alias("path"), "text"),
        agreement_texts(spark, sf_dir).select(of("contract", F.col("ord").cast("string")).alias("path"), "text"),
        identity_texts(spark, sf_dir).select(of("passport", F.col("c_custkey").cast("string")).alias("path"), "text"),
        orders.filter(k % 7 == 0).select(of("box", k.cast("string"), "zip").alias("path"), F.lit("").alias("text")),
        orders.filter(k % 5 == 0).select(of("page", k.cast("string")).alias("path"), F.lit("who knows").alias("text")),
    ]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united.select(F.xxhash64("path").alias("ord"), "path", "text")
