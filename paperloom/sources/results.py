"""Writing and reading results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from paperloom import schemas

FORMATS = ["json", "csv", "parquet"]


def flatten(df: DataFrame) -> DataFrame:
    """Structs to `a.b` columns, arrays, maps and variants to JSON text: what a CSV file can hold."""

    def leaves(field: T.StructField, path: str, name: str):
        if isinstance(field.dataType, T.StructType):
            for f in field.dataType.fields:
                yield from leaves(f, f"{path}.`{f.name}`", f"{name}.{f.name}")
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.VariantType)):
            yield F.to_json(F.col(path)).alias(name)
        else:
            yield F.col(path).alias(name)

    return df.select(*[c for f in df.schema.fields for c in leaves(f, f"`{f.name}`", f.name)])


def write_results(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists", **options: str) -> None:
    """Write as json, csv (flattened) or parquet; any other format is an error (S9). Options of Spark's writers
    pass through: `compression="gzip"` makes the texts of large corpora several times smaller."""
    if fmt == "json":
        df.write.mode(mode).options(**options).json(path)
    elif fmt == "csv":
        flatten(df).write.mode(mode).option("header", "true").options(**options).csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).options(**options).parquet(path)
    else:
        raise ValueError(f"Unsupported format: {fmt}")


def select_output(
    df: DataFrame, confidence: bool = True, metadata: bool = True, source_references: bool = True
) -> DataFrame:
    """Drop confidences, metadata or source references on request, also inside structs."""
    out = df
    if not metadata and "metadata" in out.columns:
        out = out.drop("metadata")
    if not confidence:
        for f in out.schema.fields:
            if isinstance(f.dataType, T.StructType) and "confidence" in f.dataType.names:
                out = out.withColumn(f.name, F.col(f.name).dropFields("confidence"))
        out = out.drop("confidence")
    if not source_references:
        out = out.drop("document_path", "path", "source_documents")
    return out


def outputs(
    documents: DataFrame,
    aggregated: DataFrame,
    relationships: DataFrame,
    per_document: bool = True,
    with_aggregated: bool = True,
    with_relationships: bool = True,
    **fields: bool,
) -> Mapping[str, DataFrame]:
    """The three result tables that were asked for."""
    wanted = {}
    if per_document:
        wanted["documents"] = select_output(documents, **fields)
    if with_aggregated:
        wanted["aggregated"] = aggregated
    if with_relationships:
        wanted["relationships"] = relationships
    return wanted


def parse_results(df: DataFrame, json: str = "json", *keep: str) -> DataFrame:
    """Stored result JSON to the struct of its document type, mixed types in one table.

    `document_type` decides; each type is parsed by its own schema in one scan, and the columns of the
    other types stay null.
    """
    kind = F.get_json_object(json, "$.document_type")
    typed = df.withColumn("document_type", F.coalesce(kind, F.when(F.get_json_object(json, "$.totals").isNotNull(), "receipt")))
    return typed.select(
        *keep,
        "document_type",
        *[
            F.when(F.col("document_type") == t, F.from_json(json, schemas.struct_type(t))).alias(t)
            for t in schemas.known_types()
        ],
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files (one JSON document per line) as one table with a struct column per type."""
    return parse_results(spark.read.text(path).withColumnRenamed("value", "json"))
