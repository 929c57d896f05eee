"""Reading document corpora (S1-S8). Paths may be local, `gs://`, `s3a://` or any Hadoop file system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The default file patterns of a corpus scan.
DEFAULT_GLOBS = ["*.pdf", "*.png", "*.jpg", "*.docx"]

BINARY_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def _glob(globs: Sequence[str] | None) -> str:
    wanted = list(globs or DEFAULT_GLOBS)
    return wanted[0] if len(wanted) == 1 else "{" + ",".join(wanted) + "}"


def read_corpus(spark: SparkSession, path: str, globs: Sequence[str] | None = None, recursive: bool = True) -> DataFrame:
    """Files as rows: path, modificationTime, length, content (S1, S2). `content` is only read if it is used."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", _glob(globs))
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(path)


def read_text_docs(spark: SparkSession, path: str, globs: Sequence[str] = ("*.txt",), recursive: bool = True) -> DataFrame:
    """Whole text files as one UTF-8 string each; undecodable files give empty text and an error (S3)."""
    files = read_corpus(spark, path, globs, recursive)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(
        "path",
        F.coalesce(text, F.lit("")).alias("text"),
        F.when(text.isNull(), F.lit("invalid UTF-8")).alias("error"),
    )


def read_json_docs(spark: SparkSession, path: str, schema: T.StructType | str | None = None, globs: Sequence[str] = ("*.json",)) -> DataFrame:
    """JSON files as typed data (`schema`) or as VARIANT (S4). A file that is no JSON gives null data and
    an error; one that does not fit the schema keeps the fields that do, and an error."""
    return parse_json_docs(read_text_docs(spark, path, globs), schema)


def parse_json_docs(docs: DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
    """Texts that are JSON (path, text, error) as data: path, data, error, as `read_json_docs` gives them."""
    variant = F.try_parse_json("text")
    broken = F.when(variant.isNull(), F.lit("not valid JSON"))
    if schema is None:
        return docs.select("path", variant.alias("data"), F.coalesce("error", broken).alias("error"))
    typed = _ddl(schema)
    corrupt = "_corrupt_record"
    wide = T.StructType([*typed.fields, T.StructField(corrupt, T.StringType())])
    parsed = docs.withColumn("_p", F.when(variant.isNotNull(), F.from_json("text", wide, {"columnNameOfCorruptRecord": corrupt})))
    misfit = F.when(F.col(f"_p.{corrupt}").isNotNull(), F.lit("does not fit the schema"))
    data = F.when(F.col("_p").isNotNull(), F.struct(*[F.col("_p")[f.name].alias(f.name) for f in typed.fields]))
    return parsed.select("path", data.alias("data"), F.coalesce("error", broken, misfit).alias("error"))


def _ddl(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_csv_docs(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, **options: str
) -> DataFrame:
    """CSV files as rows and columns with the file they come from (S5). Give a schema on large inputs."""
    reader = spark.read.options(**options).option("header", str(header).lower()).option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", "*.csv")
    reader = reader.schema(schema) if schema is not None else reader
    return reader.csv(path).withColumn("path", F.input_file_name())


def read_xml_docs(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """XML files, one row per `row_tag` element (S6). Give a schema on large inputs."""
    reader = spark.read.option("rowTag", row_tag).option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true")
    reader = reader.schema(schema) if schema is not None else reader
    return reader.xml(path).withColumn("path", F.input_file_name())


# --- HTML (S7) -----------------------------------------------------------------------------------

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
HIDDEN_PATTERN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<head\b[^>]*>.*?</head>"


def html_text(html: Column) -> Column:
    """Visible text: comments, scripts, styles and the head removed, tags to blanks, entities decoded."""
    bare = F.regexp_replace(F.regexp_replace(html, HIDDEN_PATTERN, " "), r"<[^>]+>", " ")
    for entity, char in ENTITIES.items():
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))


def html_extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds text, links, title and lang."""
    h = F.col(html)
    title = F.regexp_extract(h, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    for entity, char in ENTITIES.items():
        title = F.replace(title, F.lit(entity), F.lit(char))
    return (
        df.withColumn("text", html_text(h))
        .withColumn("links", html_links(h))
        .withColumn("title", F.nullif(F.trim(title), F.lit("")))
        .withColumn("lang", F.nullif(F.regexp_extract(h, r'(?i)<html\b[^>]*\blang="([^"]*)"', 1), F.lit("")))
    )


def stream_corpus(spark: SparkSession, path: str, globs: Sequence[str] | None = None, max_files: int = 1000) -> DataFrame:
    """Watch a folder: new files arrive as rows of a stream."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("pathGlobFilter", _glob(globs))
    return reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)
