"""Roll-ups over parser output tables: pages, OCR tokens, table cells, method attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from paperloom.operators.keys import first_per_key, join_skewed

# Fixed values
EMBEDDED_TEXT_ABOVE = 100
MIN_ROWS, MIN_COLUMNS = 2, 2
TABLE_METHODS = ["pdfplumber", "tabula", "camelot"]
FAILED = "failed"


def rollup_pages(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Whole text per document: pages in order, each followed by a newline (X1). The result is one text
    value per document, so a group is no larger than the row it becomes."""
    numbered = pages.withColumns({"_text": F.coalesce("text", F.lit("")), "_images": F.coalesce("has_images", F.lit(False))})
    return (
        numbered.groupBy(doc)
        .agg(
            F.count(F.lit(1)).alias("page_count"),
            F.bool_or("_images").alias("has_images"),
            F.concat(F.expr("listagg(_text, '\n') WITHIN GROUP (ORDER BY page_number, _text)"), F.lit("\n")).alias("text"),
        )
        .withColumn("has_embedded_text", F.length(F.regexp_replace("text", r"^\s+|\s+$", "")) > EMBEDDED_TEXT_ABOVE)
    )


def scanned_flag(docs: DataFrame) -> DataFrame:
    """Documents without embedded text need OCR."""
    return docs.withColumn("is_scanned", ~F.col("has_embedded_text")).withColumn(
        "extraction_method", F.when(F.col("has_embedded_text"), "native_text").otherwise("ocr_required")
    )


def rollup_ocr(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Mean confidence over tokens with a positive one, on a 0-1 scale, and the number of blocks."""
    return tokens.groupBy(doc).agg(
        F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))) / 100, F.lit(0.0)).alias("confidence"),
        F.count_if(F.trim("token") != "").alias("block_count"),
    )


def ocr_blocks(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Non-blank tokens as blocks with confidence and position, one row each."""
    return tokens.filter(F.trim("token") != "").select(
        doc,
        "position",
        F.col("token").alias("text"),
        (F.col("conf") / 100).alias("confidence"),
        F.struct("x", "y", "width", "height").alias("box"),
    )


def grid_to_records(cells: DataFrame, table: Sequence[str] = ("table_id",)) -> DataFrame:
    """Cell grid to (row, header, value) records (X4): row 0 is the header, cells beyond it are dropped.

    The header row is joined to the cells by (table, column), a very long table in parts; a record is left as rows of fields, see
    `records_as_maps` for one map per row.
    """
    keys = [*table, "column"]
    headers = cells.filter(F.col("row") == 0).select(*keys, F.col("value").alias("header"))
    body = cells.filter(F.col("row") > 0)
    return join_skewed(body, headers, keys, F.col("row")).select(*table, "row", "column", "header", "value")


def records_as_maps(records: DataFrame, table: Sequence[str] = ("table_id",)) -> DataFrame:
    """One map header -> value per table row; of repeated headers the last column wins. A row is one
    group, as long as the table is wide."""
    cells = F.array_sort(F.collect_list(F.struct("header", "column", "value")))
    rows = records.filter(F.col("header").isNotNull()).groupBy(*table, "row").agg(cells.alias("_cells"))
    following = lambda i: F.get("_cells", i + 1)["header"]
    last = F.filter("_cells", lambda c, i: ~c["header"].eqNullSafe(following(i)))
    record = F.map_from_entries(F.transform(last, lambda c: F.struct(c["header"], c["value"])))
    return rows.select(*table, "row", record.alias("record"))


def valid_tables(tables: DataFrame) -> DataFrame:
    """At least two rows, two columns and some data."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    return tables.filter((count("rows") >= MIN_ROWS) & (count("columns") >= MIN_COLUMNS) & (count("data_rows") > 0))


def table_confidence(tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Mean accuracy on a 0-1 scale and number of tables per document."""
    return tables.groupBy(doc).agg((F.avg("accuracy") / 100).alias("confidence"), F.count(F.lit(1)).alias("table_count"))


def pick_method(candidates: DataFrame, docs: DataFrame, primary: str = "camelot", doc: str = "doc_id") -> DataFrame:
    """The primary method if it worked, else the first working fallback, else `failed`."""
    order = [primary, *[m for m in TABLE_METHODS if m != primary]]
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    worked = candidates.filter(~F.coalesce("failed", F.lit(False))).withColumn("_rank", rank).filter("_rank > 0")
    best = first_per_key(worked.select(doc, "method", "table_count", "_rank"), [doc], [F.col("_rank")])
    return (
        docs.select(doc)
        .join(best.drop("_rank"), doc, "left")
        .withColumn("extraction_method", F.coalesce("method", F.lit(FAILED)))
        .withColumn("table_count", F.coalesce("table_count", F.lit(0).cast("bigint")))
        .drop("method")
    )
