"""Classification, routing and handler choice (K1-K12). Projections only: no join, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.functions.paths import stem, suffix
from paperloom.functions.text import let

CLASSIFICATION = "struct<type:string,confidence:double,method:string,features:array<string>>"

# Suffixes, keywords (in order), families, routes, aliases, MIME types, confidences.
EXTENSION_TYPES = {
    ".zip": "archive",
    ".rar": "archive",
    ".tar": "archive",
    ".7z": "archive",
    ".gz": "archive",
    ".eml": "email",
    ".msg": "email",
}
KEYWORDS = {
    "invoice": ["invoice", "inv", "bill", "receipt", "payment", "order"],
    "agreement": ["agreement", "contract", "nda", "msa", "sow", "lease", "terms", "policy"],
    "kyc": ["passport", "license", "id", "identity", "permit", "visa", "aadhaar", "pan"],
}
TYPE_FAMILIES = {
    "container": ["archive", "email", "pdf_portfolio"],
    "invoice": ["invoice", "bill", "receipt", "purchase_order"],
    "agreement": ["agreement", "contract", "nda", "msa", "sow", "mou", "lease"],
    "kyc": ["passport", "drivers_license", "id_card", "residence_permit", "visa"],
    "document": ["document", "form", "letter", "report"],
}
ROUTES = {
    **{t: "invoice" for t in ["invoice", "bill", "receipt", "purchase_order"]},
    **{t: "agreement" for t in ["agreement", "contract", "nda", "msa", "sow", "mou", "lease"]},
    **{t: "kyc" for t in ["kyc", "passport", "drivers_license", "id_card", "residence_permit", "visa"]},
}
ALIASES = {"po": "purchase_order", "license": "drivers_license", "id": "id_card"}
FILENAME_CONFIDENCE, HINT_CONFIDENCE, DEFAULT_CONFIDENCE = 0.8, 0.7, 0.5
GATE_BELOW = 0.7
GATE_HANDLER = "custom"
UNKNOWN_TYPE = "unknown"
SAMPLE_CHARS, SAMPLE_MIN_CHARS = 3000, 20
MIME_HANDLERS = {
    "application/pdf": "handle_pdf",
    "application/msword": "handle_doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "handle_docx",
    "text/plain": "handle_text",
    "text/markdown": "handle_markdown",
    "application/vnd.ms-excel": "handle_xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "handle_xlsx",
    "text/csv": "handle_csv",
    "image/jpeg": "handle_image",
    "image/png": "handle_image",
    "image/tiff": "handle_image",
    "image/bmp": "handle_image",
    "application/zip": "handle_zip",
    "application/x-rar": "handle_rar",
    "application/x-tar": "handle_tar",
    "message/rfc822": "handle_email",
    "application/vnd.ms-outlook": "handle_msg",
    "text/html": "handle_html",
    "application/json": "handle_json",
    "application/xml": "handle_xml",
    "text/xml": "handle_xml",
}
MISSING_HANDLERS = ["handle_doc", "handle_markdown", "handle_xls", "handle_rar", "handle_tar", "handle_msg"]
GENERIC_HANDLER = "handle_generic"
GENERIC_MIME = "application/octet-stream"
# Public MIME registrations and file signatures (hexadecimal prefixes).
EXTENSION_MIME = {
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".csv": "text/csv",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".bmp": "image/bmp",
    ".zip": "application/zip",
    ".rar": "application/x-rar",
    ".tar": "application/x-tar",
    ".eml": "message/rfc822",
    ".msg": "application/vnd.ms-outlook",
    ".html": "text/html",
    ".htm": "text/html",
    ".json": "application/json",
    ".xml": "application/xml",
}
MAGIC = {
    "25504446": "application/pdf",
    "FFD8FF": "image/jpeg",
    "89504E470D0A1A0A": "image/png",
    "49492A00": "image/tiff",
    "4D4D002A": "image/tiff",
    "424D": "image/bmp",
    "504B0304": "application/zip",
    "526172211A07": "application/x-rar",
}


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a small constant table; a literal map, so nothing has to be joined or broadcast."""
    entries = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*entries)[key] if entries else F.lit(None).cast("string")


def _result(type_: Column | str, confidence: float, method: str, features: Column) -> Column:
    kind = F.lit(type_) if isinstance(type_, str) else type_
    return F.struct(
        kind.alias("type"),
        F.lit(float(confidence)).alias("confidence"),
        F.lit(method).alias("method"),
        features.alias("features"),
    )


def classify_extension(path: Column) -> Column:
    """Container suffixes decide alone, with full confidence (K1)."""
    ext = F.lower(suffix(path))
    kind = _lookup(EXTENSION_TYPES, ext)
    return F.when(kind.isNotNull(), _result(kind, 1.0, "extension", F.array(F.concat(F.lit("extension:"), ext))))


def _first_keyword(
    text: Column, confidence: float, method: str, prefix: str, keywords: Mapping[str, Sequence[str]]
) -> Column:
    """First keyword contained in `text`, in list order; plain substrings, not words.

    The keywords are one literal array: a branch for each made methods too long for the JVM to compile.
    """
    words = [(kind, word) for kind, listed in keywords.items() for word in listed]
    known = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(word).alias("word")) for kind, word in words])
    first = let(text, lambda t: F.get(F.filter(known, lambda k: t.contains(k["word"])), F.lit(0)))
    found = lambda k: _result(k["kind"], confidence, method, F.array(F.concat(F.lit(f"{prefix}:"), k["word"])))
    return let(first, lambda k: F.when(k.isNotNull(), found(k)))


def classify_filename(path: Column, keywords: Mapping[str, Sequence[str]] = KEYWORDS) -> Column:
    """Keyword in the lower-cased file stem (K2)."""
    return _first_keyword(F.lower(stem(path)), FILENAME_CONFIDENCE, "filename_keyword", "filename", keywords)


def classify_hint(hint: Column, keywords: Mapping[str, Sequence[str]] = KEYWORDS) -> Column:
    """Keyword in the lower-cased content hint (K3)."""
    return _first_keyword(F.lower(hint), HINT_CONFIDENCE, "content_hint", "hint", keywords)


def default_class() -> Column:
    """Anything else is a plain document (K4)."""
    return _result("document", DEFAULT_CONFIDENCE, "default", F.array().cast("array<string>"))


def classify(
    df: DataFrame,
    path: str = "path",
    hint: str | None = None,
    model: str | None = None,
    into: str = "classification",
    keywords: Mapping[str, Sequence[str]] = KEYWORDS,
) -> DataFrame:
    """Extension, then a model answer if one is at hand, then file name, hint, default (K5)."""
    steps = [classify_extension(F.col(path))]
    if model:
        steps.append(F.col(model))
    steps.append(classify_filename(F.col(path), keywords))
    if hint:
        steps.append(classify_hint(F.col(hint), keywords))
    steps.append(default_class())
    return df.withColumn(into, F.coalesce(*[s.cast(CLASSIFICATION) for s in steps]))


def parse_model_response(answer: Column) -> Column:
    """A stored model answer as a classification, or null if it is not a JSON object with a type and a
    confidence (K9). A code fence and its `json` tag are stripped first."""
    text = F.trim(answer)
    fenced = F.regexp_replace(F.split(text, "```")[1], r"^json", "")
    body = F.when(text.startswith("```"), fenced).otherwise(text)
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    parsed = F.when(body.startswith("{") & body.endswith("}"), F.try_parse_json(body))
    kind = F.try_variant_get(parsed, "$.type", "string")
    confidence = F.try_variant_get(parsed, "$.confidence", "double")
    return F.when(
        kind.isNotNull() & confidence.isNotNull(),
        F.struct(
            kind.alias("type"),
            confidence.alias("confidence"),
            F.lit("llm").alias("method"),
            F.try_variant_get(parsed, "$.features", "array<string>").alias("features"),
        ),
    )


def type_family(kind: Column) -> Column:
    """container / invoice / agreement / kyc / document, null for an unknown type (K6)."""
    return _lookup({t: family for family, types in TYPE_FAMILIES.items() for t in types}, kind)


def route(kind: Column, routes: Mapping[str, str] = ROUTES, aliases: Mapping[str, str] = ALIASES) -> Column:
    """Handler of a type after alias resolution; null when none is registered (K7)."""
    resolved = F.coalesce(_lookup(aliases, F.coalesce(kind, F.lit("document"))), kind, F.lit("document"))
    return _lookup(routes, resolved)


def route_types(routes: Mapping[str, str] = ROUTES) -> list[str]:
    return sorted(routes)


def gate(kind: Column, confidence: Column, below: float = GATE_BELOW) -> Column:
    """Types classified with less than `below` go to the custom handler (K8)."""
    return F.when(confidence < below, F.lit(GATE_HANDLER)).otherwise(kind)


@dataclass(frozen=True)
class Routing:
    """How types are told by name and which handler takes them; the same for batches and streams."""

    routes: Mapping[str, str] = field(default_factory=lambda: dict(ROUTES))
    aliases: Mapping[str, str] = field(default_factory=lambda: dict(ALIASES))
    keywords: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(KEYWORDS))
    below: float = GATE_BELOW

    def register(self, kind: str, handler: str | None = None, keywords: Sequence[str] = ()) -> Routing:
        """With a custom type: its own handler, and keywords that are tried before the built-in ones."""
        own = {kind: list(keywords)} if keywords else {}
        return replace(self, routes={**self.routes, kind: handler or kind}, keywords={**own, **self.keywords})


def classify_and_route(
    df: DataFrame, hint: str | None = None, model: str | None = None, routing: Routing | None = None
) -> DataFrame:
    """document_type, confidence and handler per document (K5, K7, K8).

    Weak classes go to the custom handler. A type that no handler takes counts as unknown: it has no
    handler and no confidence, so it is never a success.
    """
    routing = routing or Routing()
    c = F.col("classification")
    handler = gate(route(c["type"], routing.routes, routing.aliases), c["confidence"], routing.below)
    classified = classify(df, hint=hint, model=model, keywords=routing.keywords).withColumn("handler", handler)
    taken = F.col("handler").isNotNull()
    return classified.withColumns(
        {
            "document_type": F.when(taken, c["type"]).otherwise(F.lit(UNKNOWN_TYPE)),
            "confidence": F.when(taken, c["confidence"]),
        }
    )


def content_sample(text: Column) -> Column:
    """What a classifier gets to see: the first 3000 characters, if 20 remain after trimming.

    This sample only feeds model answers; every other operator reads whole texts.
    """
    sample = F.substring(text, 1, SAMPLE_CHARS)
    return F.when(F.length(F.regexp_replace(sample, r"^\s+|\s+$", "")) >= SAMPLE_MIN_CHARS, sample)


def mime_type(path: Column, content: Column | None = None) -> Column:
    """File signature first when bytes are at hand, then suffix, then octet-stream.

    Office files are ZIP by signature, so a more specific suffix wins over a ZIP signature.
    """
    by_suffix = _lookup(EXTENSION_MIME, F.lower(suffix(path)))
    if content is None:
        return F.coalesce(by_suffix, F.lit(GENERIC_MIME))
    head = F.hex(F.substring(content, 1, 8))
    signed = F.coalesce(*[F.when(head.startswith(prefix), F.lit(mime)) for prefix, mime in MAGIC.items()])
    office = by_suffix.startswith("application/vnd.openxmlformats") & (signed == "application/zip")
    return F.when(office, by_suffix).otherwise(F.coalesce(signed, by_suffix, F.lit(GENERIC_MIME)))


def mime_handler(mime: Column) -> Column:
    """Handler name of a MIME type; unknown types and named but absent handlers are generic."""
    usable = {m: (GENERIC_HANDLER if h in MISSING_HANDLERS else h) for m, h in MIME_HANDLERS.items()}
    return F.coalesce(_lookup(usable, mime), F.lit(GENERIC_HANDLER))


def detect_mime(df: DataFrame, path: str = "path", content: str | None = None) -> DataFrame:
    mime = mime_type(F.col(path), F.col(content) if content else None)
    return (
        df.withColumn("extension", suffix(F.col(path)))
        .withColumn("mime_type", mime)
        .withColumn("handler", mime_handler(F.col("mime_type")))
    )


def extraction_status(df: DataFrame, primary: str, fallback: str, error: str) -> DataFrame:
    """Text and status after the fallback chain (K12): the primary result, else OCR text for images and
    PDF, else metadata only with the primary error kept."""
    visual = F.col("mime_type").startswith("image/") | F.col("mime_type").contains("pdf")
    use_ocr = F.col(primary).isNull() & visual & F.col(fallback).isNotNull()
    ok = F.col(primary).isNotNull()
    return (
        df.withColumn("text", F.when(ok, F.col(primary)).when(use_ocr, F.col(fallback)).otherwise(F.lit("")))
        .withColumn("processing_success", ok)
        .withColumn("extraction_method", F.when(ok, "primary").when(use_ocr, "fallback_ocr").otherwise("metadata_only"))
        .withColumn("status", F.when(~ok & ~use_ocr, "partial_failure"))
        .withColumn("primary_error", F.when(~ok, F.col(error)))
    )
