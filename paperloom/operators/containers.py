"""Container decomposition and lineage.

A corpus is a DataFrame of files; unpacking is a loop over nesting levels, each level one distributed
job. Only the codecs themselves (zip, tar, e-mail) run in Python, inside the partition that holds the
container's bytes; their members become rows and are spread again before the next level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paperloom.functions.paths import file_name, suffix
from paperloom.operators.keys import first_per_key, join_skewed, keep_first_ids
from paperloom.operators.naming import name_key, number_members, ordinal_block, tasks_for
from paperloom.session import cut, drop_cut

# Container suffixes in matching order, junk names, forbidden characters, depth.
CONTAINER_EXTENSIONS = {
    ".zip": "archive",
    ".rar": "archive",
    ".7z": "archive",
    ".tar": "archive",
    ".gz": "archive",
    ".tgz": "archive",
    ".tar.gz": "archive",
    ".eml": "email",
    ".msg": "email",
}
JUNK_NAMES = ["__MACOSX", ".DS_Store", "Thumbs.db", "~$"]
FORBIDDEN = '/\\:*?"<>|\x00'
MAX_DEPTH = 3
MAX_DEPTH_NOTE = "max_depth_reached"

CHUNK_BYTES = 1 << 28  # larger members arrive in several rows: a binary value ends at 2 GiB
ORDINAL_WIDTH = 10

MEMBER_DDL = (
    "container_id STRING, ordinal BIGINT, name STRING, chunk INT, content BINARY, file_size BIGINT, file_hash STRING, "
    "error STRING"
)
MESSAGE = [
    "subject", "sender", "recipients", "cc", "date", "message_id", "body", "attachment_count", "inline_image_count"
]
PART_DDL = (
    "container_id STRING, part STRING, ordinal BIGINT, name STRING, chunk INT, content BINARY, file_size BIGINT, "
    "file_hash STRING, error STRING, "
    "subject STRING, sender STRING, recipients STRING, cc STRING, date STRING, message_id STRING, body STRING, "
    "attachment_count BIGINT, inline_image_count BIGINT"
)
NODE = ["document_id", "root_id", "parent_id", "path", "depth", "position", "chunk", "content", "file_size", "file_hash"]


# --- small column operators --------------------------------------------------------------------


def container_type(path: Column) -> Column:
    """`archive` or `email` by the end of the lower-cased path, else null."""
    lowered = F.lower(path)
    return F.coalesce(*[F.when(lowered.endswith(ext), F.lit(kind)) for ext, kind in CONTAINER_EXTENSIONS.items()])


def is_junk(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(j) for j in JUNK_NAMES])


def drop_junk_members(df: DataFrame, name: str = "name") -> DataFrame:
    """Without archive members such as resource forks and office lock files."""
    return df.filter(~is_junk(F.col(name)))


def clean_name(name: Column) -> Column:
    """Forbidden characters to `_`, then trimmed."""
    return F.regexp_replace(F.translate(name, FORBIDDEN, "_" * len(FORBIDDEN)), r"^\s+|\s+$", "")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


# --- unique member names (C7) --------------------------------------------------------------------

RANK_BLOCK = 65_536


def _rank_in_name(df: DataFrame, keys: Sequence[str], ord_col: str, n_tasks: int) -> DataFrame:
    """0-based rank by `ord_col` among equal keys, without one task sorting a whole key.

    Rows are ranked inside blocks of consecutive ordinals and shifted by the counts of earlier blocks;
    a block holds at most RANK_BLOCK rows because an ordinal is unique in its parent.
    """
    blocked = df.withColumn("_block", F.floor(F.col(ord_col) / RANK_BLOCK))
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*keys, "_block").orderBy(ord_col)
    ranked = blocked.repartition(n_tasks, *keys, "_block").withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        ranked.join(offsets, [*keys, "_block"])
        .withColumn("_rank", (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_block", "_before", "_inside")
    )


def unique_names(
    df: DataFrame, parent: str = "parent_id", name: str = "name", ord_col: str = "ordinal"
) -> DataFrame:
    """Cleaned names made unique per parent in order of arrival: the k-th repeat of `a.txt` takes the
    next free name of `a_1.txt`, `a_2.txt`, ... (C7). Adds `unique_name`; `name` stays as it was.

    A made name can only meet names of its own family, those that differ in a tail of `_<number>`. In a
    family of one name, however often, or without repeats, the number is the rank among equal names.
    In other families `number_members` finds the numbers that are left out. No task sees a whole name
    or family: rows are dealt out by blocks of ordinals.
    """
    stem = F.regexp_replace("_clean", r"(?s)^(.*[^.].*)\.[^.]*$", "$1")
    family = F.regexp_replace("_stem", r"(_[0-9]+)+$", "")
    based = df.withColumn("_clean", clean_name(F.col(name))).withColumn("_stem", stem)
    based = based.withColumn("_ext", F.substr("_clean", F.length("_stem") + 1))
    based = based.withColumn("_family", name_key(F.col(parent), family, F.col("_ext")))
    based = cut(based.withColumn("_dealt", ordinal_block(F.col(ord_col), RANK_BLOCK)))
    n_tasks = tasks_for(based)
    per_name = based.groupBy("_family", "_clean").agg(F.count(F.lit(1)).alias("_n"))
    mixed = per_name.groupBy("_family").agg(
        ((F.count(F.lit(1)) > 1) & (F.max("_n") > 1)).alias("_mixed"), F.sum("_n").alias("_size")
    )
    blocks = based.select("_family", "_dealt").distinct().join(mixed.filter("_mixed"), "_family")
    tagged = based.repartition(n_tasks, "_family", "_dealt").join(blocks, ["_family", "_dealt"], "left")
    tagged = cut(tagged.withColumn("_mixed", F.coalesce("_mixed", F.lit(False))).drop("_family", "_dealt"), "_mixed")
    drop_cut(based)
    ranked = _rank_in_name(tagged.filter("NOT _mixed"), [parent, "_clean"], ord_col, n_tasks)
    numbered = F.when(F.col("_rank") == 0, F.col("_clean")).otherwise(
        F.concat("_stem", F.lit("_"), F.col("_rank").cast("string"), "_ext")
    )
    simple = ranked.select(*[F.col(c) for c in df.columns], numbered.alias("unique_name"))

    members = tagged.filter("_mixed").select(*df.columns, "_clean", "_stem", "_ext", "_size")
    return simple.unionByName(number_members(members, parent, ord_col).select(*df.columns, "unique_name"))


# --- codecs (C2, C3) -----------------------------------------------------------------------------


FLUSH_BYTES, FLUSH_ROWS = 32 << 20, 2_000  # members are handed on in batches of about this size


def _flushed(rows: Callable, schema) -> Callable:
    """A `mapInArrow` function that hands on the rows `rows(source)` makes of each source row, in batches
    of bounded size, whatever the size of a source."""
    flush_bytes, flush_rows = FLUSH_BYTES, FLUSH_ROWS

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        waiting, held = [], 0
        for batch in batches:
            for source in batch.to_pylist():
                for row in rows(source):
                    waiting.append(row)
                    held += len(row.get("content") or b"") + len(row.get("body") or "")
                    if held >= flush_bytes or len(waiting) >= flush_rows:
                        yield pa.RecordBatch.from_pylist(waiting, schema=schema)
                        waiting, held = [], 0
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=schema)

    return run


def _archive_rows(chunk_bytes: int, carry: Sequence[str]) -> Callable:
    """Member rows of one archive. It carries its imports: executors need nothing but the standard library."""
    carry = list(carry)

    def pieces(opened) -> Iterator:
        while piece := opened.read(chunk_bytes):
            yield piece

    def zip_members(data: bytes) -> Iterator:
        import io
        import zipfile

        with zipfile.ZipFile(io.BytesIO(data)) as zf:
            for info in zf.infolist():
                if not info.is_dir():
                    yield info.filename, lambda info=info: zf.open(info)

    def tar_members(data: bytes) -> Iterator:
        import io
        import tarfile

        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tf:
            for info in tf.getmembers():
                if info.isfile():
                    yield info.name, lambda info=info: tf.extractfile(info)

    def unpack(path: str, data: bytes) -> Iterator:
        lowered = path.lower()
        if lowered.endswith(".zip"):
            return zip_members(data)
        if lowered.endswith((".tar", ".gz", ".tgz")):
            return tar_members(data)
        raise ValueError("unsupported container: " + lowered.rsplit(".", 1)[-1])

    def rows(source: dict) -> Iterator:
        import hashlib

        own = {"container_id": source["document_id"], **{c: source[c] for c in carry}}
        try:
            for ordinal, (name, open_member) in enumerate(unpack(source["path"], source["content"])):
                found = {**own, "ordinal": ordinal, "name": name}
                try:
                    # read once for hash and size; only a member of several chunks is read again
                    digest, size, first = hashlib.sha256(), 0, b""
                    for number, piece in enumerate(pieces(open_member())):
                        first = piece if number == 0 else b""
                        size += len(piece)
                        digest.update(piece)
                    facts = {**found, "file_size": size, "file_hash": digest.hexdigest()}
                except Exception as e:  # one bad member must not lose the others
                    yield {**found, "error": f"{type(e).__name__}: {e}"}
                    continue
                if size <= chunk_bytes:
                    yield {**facts, "chunk": 0, "content": first}
                    continue
                for number, piece in enumerate(pieces(open_member())):
                    yield {**facts, "chunk": number, "content": piece}
        except Exception as e:  # unreadable container
            yield {**own, "error": f"{type(e).__name__}: {e}"}

    return rows


def _carried(df: DataFrame, ddl: str, carry: Sequence[str]) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(ddl).fields, *[df.schema[c] for c in carry]])


def explode_archives(df: DataFrame, chunk_bytes: int = CHUNK_BYTES, carry: Sequence[str] = ()) -> DataFrame:
    """Members of ZIP and TAR archives (C2). Input: document_id, path, content.

    A member is one row; above `chunk_bytes` it is several rows, `chunk` 0, 1, ..., each with the hash
    and size of the whole member. Directories and non-files are left out. A member that cannot be read
    keeps its name and an error; an archive that cannot be opened gives one row with an error and no
    name. Columns in `carry` are repeated on every row, so members need no join back to their container.
    """
    taken = df.select(*dict.fromkeys(["document_id", "path", "content", *carry]))
    out = _carried(df, MEMBER_DDL, carry)
    return taken.mapInArrow(_flushed(_archive_rows(chunk_bytes, carry), to_arrow_schema(out)), out)


def register_unpack(spark: SparkSession, name: str = "unpack", chunk_bytes: int = CHUNK_BYTES) -> None:
    """The archive unpacker as a table function for SQL (U2):
    `SELECT f.path, m.* FROM files f, LATERAL unpack(f.path, f.content) m`."""
    rows = _archive_rows(chunk_bytes, [])

    class Unpack:
        def eval(self, path: str, content: bytes):
            for m in rows({"document_id": path, "path": path, "content": bytes(content)}):
                yield m.get("ordinal"), m.get("name"), m.get("chunk"), m.get("content"), m.get("error")

    ddl = "ordinal BIGINT, name STRING, chunk INT, content BINARY, error STRING"
    spark.udtf.register(name, F.udtf(Unpack, returnType=ddl))


def _email_rows(chunk_bytes: int, carry: Sequence[str]) -> Callable:
    """Part rows of one e-mail: a walk types its parts, then attachments are named and cut into chunks."""
    carry = list(carry)
    forbidden = str.maketrans({c: "_" for c in FORBIDDEN})

    def kind_of(part, payload) -> str:
        if part.get_filename():
            return "attachment"
        inline = "inline" in str(part.get("Content-Disposition", ""))
        return "image" if inline and part.get_content_maintype() == "image" else "text"

    def typed_parts(message) -> Iterator:
        """(kind, part, payload or exception) of every leaf with a payload."""
        for part in message.walk():
            if part.get_content_maintype() == "multipart":
                continue
            try:
                payload = part.get_payload(decode=True)
            except Exception as e:
                yield "error", part, e
                continue
            if payload:
                yield kind_of(part, payload), part, payload

    def named(names: list[str]) -> list[str]:
        import os

        taken, last, out = set(), {}, []
        for name in names:
            stem, ext = os.path.splitext(name)
            unique, k = name, last.get(name, 0)
            while unique in taken:
                k += 1
                unique = f"{stem}_{k}{ext}"
            last[name] = k
            taken.add(unique)
            out.append(unique)
        return out

    def body_of(message) -> str:
        if not message.is_multipart():
            payload = message.get_payload(decode=True)
            return payload.decode("utf-8", errors="ignore") if payload else ""
        plain = (p.get_payload(decode=True) for p in message.walk() if p.get_content_type() == "text/plain")
        return next((p.decode("utf-8", errors="ignore") for p in plain if p), "")

    def rows(source: dict) -> Iterator:
        import email
        import hashlib
        from email import policy

        own = {"container_id": source["document_id"], **{c: source[c] for c in carry}}
        try:
            message = email.message_from_bytes(source["content"], policy=policy.default)
            parts = list(typed_parts(message))
            for kind, part, e in parts:
                if kind == "error":
                    yield {**own, "part": "error", "name": part.get_filename(), "error": f"{type(e).__name__}: {e}"}
            files = [(part.get_filename(), payload) for kind, part, payload in parts if kind == "attachment"]
            names = named([name.translate(forbidden).strip() for name, _ in files])
            for ordinal, (name, (_, payload)) in enumerate(zip(names, files)):
                facts = {"file_size": len(payload), "file_hash": hashlib.sha256(payload).hexdigest()}
                for number, at in enumerate(range(0, len(payload), chunk_bytes)):
                    yield {
                        **own, **facts, "part": "attachment", "ordinal": ordinal, "name": name, "chunk": number,
                        "content": payload[at : at + chunk_bytes],
                    }
            header = lambda name: str(message.get(name, ""))
            yield {
                **own, "part": "message", "subject": header("subject"), "sender": header("from"),
                "recipients": header("to"), "cc": header("cc"), "date": header("date"),
                "message_id": header("message-id"), "body": body_of(message), "attachment_count": len(files),
                "inline_image_count": sum(kind == "image" for kind, _, _ in parts),
            }
        except Exception as e:
            yield {**own, "part": "error", "error": f"{type(e).__name__}: {e}"}

    return rows


def email_parts(df: DataFrame, carry: Sequence[str] = (), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows with `part` = `message`, `attachment`, `error` of e-mails (C3). Input: document_id, content."""
    taken = df.select(*dict.fromkeys(["document_id", "content", *carry]))
    out = _carried(df, PART_DDL, carry)
    return taken.mapInArrow(_flushed(_email_rows(chunk_bytes, carry), to_arrow_schema(out)), out)


def explode_emails(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, attachments): headers and body per e-mail; a row per chunk of each named part with
    cleaned, unique names. Inline images without a name are only counted."""
    parts = email_parts(df)
    messages = parts.filter("part = 'message'").select("container_id", *MESSAGE)
    attachments = parts.filter("part = 'attachment'").select("container_id", "ordinal", "name", "chunk", "content")
    return messages, attachments


# --- dedup (C9, C10) -----------------------------------------------------------------------------


def dedup_by_hash(
    df: DataFrame, scope: Sequence[str] = ("root_id",), order: Sequence[str] = ("position",), id_col: str = "document_id"
) -> DataFrame:
    """Keep the first row per content hash inside `scope` (C9). Needs `file_hash`.

    Only scope, hash, order and id are aggregated (map-side first), so a hash that a third of the rows
    share costs one row per task; contents stay where they are until the semi join on the unique id.
    """
    return keep_first_ids(df, [*scope, "file_hash"], [F.col(c) for c in order], id_col)


def dedup_and_replicate(
    df: DataFrame, compute: Callable[[DataFrame], DataFrame], id_col: str = "document_id", hot_rows: int | None = None
) -> DataFrame:
    """Run `compute` once per distinct content and hand its result to every copy.

    `compute` gets one row per hash and must keep `file_hash`; all copies are joined back on it, with
    heavily copied hashes split over tasks.
    """
    unique = keep_first_ids(df, ["file_hash"], [F.col(id_col)], id_col)
    results = compute(unique)
    added = [c for c in results.columns if c not in df.columns]
    narrow = results.select("file_hash", *added)
    return join_skewed(df, narrow, ["file_hash"], F.col(id_col), "left", hot_rows)


# --- recursive decomposition (C8, C11, C16) --------------------------------------------------------


def _ordinal(c: Column) -> Column:
    """Ordinals as text that sorts like numbers; one too long for the width is kept whole behind a `z`."""
    text = c.cast("string")
    return F.when(F.length(text) <= ORDINAL_WIDTH, F.lpad(text, ORDINAL_WIDTH, "0")).otherwise(
        F.concat(F.lit("z"), F.lpad(text, 2 * ORDINAL_WIDTH, "0"))
    )


def _roots(files: DataFrame) -> DataFrame:
    root = F.substring(F.sha2(F.col("path"), 256), 1, 32)
    return files.select(
        root.alias("document_id"),
        root.alias("root_id"),
        F.lit(None).cast("string").alias("parent_id"),
        "path",
        F.lit(0).alias("depth"),
        F.lit("").alias("position"),
        F.lit(0).alias("chunk"),
        "content",
        F.octet_length("content").cast("bigint").alias("file_size"),
        content_hash(F.col("content")).alias("file_hash"),
    )


CARRIED = ["root_id", "path", "depth", "position", "kind"]


def _children(members: DataFrame) -> DataFrame:
    """Member rows as nodes of the next level; ids derive from the root and the ordinal path."""
    position = F.concat_ws("/", F.nullif("position", F.lit("")), _ordinal(F.col("ordinal")))
    return members.withColumn("position", position).select(
        F.substring(F.sha2(F.concat_ws(":", "root_id", "position"), 256), 1, 32).alias("document_id"),
        "root_id",
        F.col("container_id").alias("parent_id"),
        F.concat_ws("/", "path", "name").alias("path"),
        (F.col("depth") + 1).alias("depth"),
        "position",
        "chunk",
        "content",
        "file_size",
        "file_hash",
    )


def _unpack(containers: DataFrame, chunk_bytes: int) -> DataFrame:
    """All members, messages and errors of one level's containers, with the container's own columns."""
    mail = F.lower("path").endswith(".eml")
    taken = containers.select("document_id", "content", *CARRIED)
    archived = drop_or_error(explode_archives(taken.filter(~mail), chunk_bytes, CARRIED))
    part = F.when(F.col("error").isNull(), "attachment").otherwise("error")
    mailed = email_parts(taken.filter(mail), CARRIED, chunk_bytes)
    both = archived.withColumn("part", part).unionByName(mailed, allowMissingColumns=True)
    return both.withColumnRenamed("kind", "container_type")


CHUNKED_NOTE = "container_in_chunks"


def decompose(files: DataFrame, max_depth: int = MAX_DEPTH, chunk_bytes: int = CHUNK_BYTES) -> dict[str, DataFrame]:
    """Unpack nested containers level by level (C8). Input: path, content.

    Returns `documents` (what is left to process, with bytes), `lineage` (C11), `errors` (C16) and
    `messages`. Levels 0..max_depth are unpacked; what lies deeper is kept as it is with the note
    `max_depth_reached`. Inside one root equal contents are kept once, the shallowest first and then in
    archive order; equal files under different roots are all kept. A container that cannot be opened
    gives an error row and stays as a document. A file above `chunk_bytes` is several document rows
    (`chunk` 0, 1, ...), each with hash and size of the whole; a container inside a container that is so
    large cannot be opened in one task and stays as a document with an error.

    Hashes and sizes are made where members are unpacked. Copies are found on narrow rows, and a level's
    contents are shuffled once, to the ids that stay. Each level is written to the shared checkpoint
    folder; the loop runs max_depth + 2 times at most.
    """
    note = lambda text: F.lit(text).cast("string").alias("note")
    frontier, seen = _roots(files), None
    documents, lineage, errors, messages = [], [], [], []
    for depth in range(max_depth + 2):
        if depth > max_depth:
            deep = frontier.withColumns({"note": F.lit(MAX_DEPTH_NOTE), "kind": note(None)})
            lineage.append(_lineage(deep))
            documents.append(deep.select(*NODE, "note"))
            break
        if seen is None:  # a root is alone at level 0: files are read once and not shuffled
            fresh = frontier
        else:
            narrow = frontier.filter("chunk = 0").select("root_id", "file_hash", "position", "document_id")
            first = first_per_key(narrow, ["root_id", "file_hash"], [F.col("position")])
            winners = first.join(seen, ["root_id", "file_hash"], "left_anti")
            fresh = frontier.join(winners.select("document_id"), "document_id", "left_semi")
        level = cut(fresh.withColumn("kind", container_type(F.col("path"))))
        hashes = level.filter("chunk = 0").select("root_id", "file_hash")
        seen = hashes if seen is None else seen.unionByName(hashes)
        lineage.append(_lineage(level.withColumn("note", F.lit(None).cast("string"))))
        documents.append(level.filter("kind IS NULL").select(*NODE, note(None)))

        containers = level.filter("kind IS NOT NULL")
        if containers.isEmpty():
            break
        in_chunks = (F.col("depth") > 0) & (F.col("file_size") > chunk_bytes)
        documents.append(containers.filter(in_chunks).select(*NODE, note(CHUNKED_NOTE)))
        errors.append(
            containers.filter(in_chunks & (F.col("chunk") == 0)).select(
                "path",
                F.concat(F.lit("container of "), F.col("file_size").cast("string"), F.lit(" bytes arrived in chunks")).alias("error"),
                F.col("kind").alias("container_type"),
                "depth",
            )
        )
        containers = containers.filter(~in_chunks)
        members = cut(_unpack(containers, chunk_bytes))
        messages.append(members.filter("part = 'message'").select("container_id", *MESSAGE))
        failed = members.filter("part = 'error'")
        errors.append(failed.select(F.concat_ws("/", "path", "name").alias("path"), "error", "container_type", "depth"))
        broken = failed.filter("name IS NULL").select(F.col("container_id").alias("document_id"))
        kept = containers.join(broken, "document_id", "left_semi")
        documents.append(kept.select(*NODE, note("container_unreadable")))
        frontier = _children(members.filter("part = 'attachment'"))
        if frontier.isEmpty():
            break
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    empty = lambda ddl: files.sparkSession.createDataFrame([], ddl)
    message_ddl = T.StructType([f for f in T.StructType.fromDDL(PART_DDL).fields if f.name in ("container_id", *MESSAGE)])
    return {
        "documents": union(documents),
        "lineage": union(lineage),
        "errors": union(errors) if errors else empty("path STRING, error STRING, container_type STRING, depth INT"),
        "messages": union(messages) if messages else empty(message_ddl),
    }


def drop_or_error(members: DataFrame) -> DataFrame:
    """Archive members without junk; rows about the archive itself have no name and stay."""
    return members.filter(F.col("name").isNull() | ~is_junk(F.col("name")))


def _lineage(level: DataFrame) -> DataFrame:
    """Lineage rows of one level, one per file (C11)."""
    return level.filter("chunk = 0").select(
        "document_id",
        "root_id",
        F.col("path").alias("original_path"),
        "parent_id",
        F.coalesce("kind", F.lit("document")).alias("container_type"),
        F.col("depth").alias("extraction_depth"),
        "file_hash",
        F.struct(
            "file_size",
            file_name(F.col("path")).alias("file_name"),
            F.lower(suffix(F.col("path"))).alias("extension"),
            F.col("note").alias("note"),
        ).alias("metadata"),
    )


# --- lineage queries (C12-C15) ---------------------------------------------------------------------


def lineage_children(lineage: DataFrame) -> DataFrame:
    """One row (parent_id, document_id) per child: the children list in linear form, so that a parent
    with very many children never becomes one value (C12)."""
    return lineage.filter("parent_id IS NOT NULL").select("parent_id", "document_id")


def children_counts(lineage: DataFrame) -> DataFrame:
    """Number of children, first and last child id per parent."""
    return lineage_children(lineage).groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("n_children"), F.min("document_id").alias("first_child"), F.max("document_id").alias("last_child")
    )


def _chains(lineage: DataFrame, wanted: DataFrame, step: Column) -> DataFrame:
    """Per wanted node the list of `step` values from the root down to it.

    One join on the unique id per level, until no chain has a parent left to look up; finished chains
    leave the loop. A chain that meets one of its own nodes again is a cycle and raises.
    """
    up = lineage.select(F.col("document_id").alias("_next"), F.col("parent_id").alias("_above"), step.alias("_step"))
    open_chains = wanted.select(
        "document_id", F.array(step).alias("chain"), F.array("document_id").alias("_ids"), F.col("parent_id").alias("_next")
    )
    done = open_chains.filter("_next IS NULL").select("document_id", "chain")
    open_chains = open_chains.filter("_next IS NOT NULL")
    while True:
        known = open_chains.join(up, "_next", "left")
        there = F.col("_step").isNotNull()
        level = cut(
            known.select(
                "document_id",
                F.when(there, F.concat(F.array("_step"), "chain")).otherwise(F.col("chain")).alias("chain"),
                F.concat(F.array("_next"), "_ids").alias("_ids"),
                F.col("_above").alias("_next"),
            )
        )
        done = done.unionByName(level.filter("_next IS NULL").select("document_id", "chain"))
        open_chains = level.filter("_next IS NOT NULL")
        left = open_chains.agg(
            F.count(F.lit(1)).alias("n"), F.first(F.when(F.array_contains("_ids", F.col("_next")), F.col("document_id")), True).alias("loop")
        ).first()
        if left["loop"] is not None:
            raise ValueError(f"the parents of {left['loop']} form a cycle")
        if not left["n"]:
            return done.withColumn("length", F.size("chain"))


def lineage_chain(lineage: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Root -> node chain and its length (C13), however deep; it starts where a parent is absent."""
    wanted = lineage if ids is None else lineage.join(ids.select("document_id").distinct(), "document_id", "left_semi")
    return _chains(lineage, wanted, F.col("document_id"))


def document_tree(lineage: DataFrame, names: str = "metadata.file_name") -> DataFrame:
    """Flat list and tree of a package: every node with its path of names from the root (C14). Sorting
    by `tree_path` prints the tree."""
    chains = _chains(lineage, lineage, F.coalesce(F.col(names), F.lit("")))
    return chains.select("document_id", F.array_join("chain", "/").alias("tree_path"), F.col("length").alias("level"))


def preprocess_summary(documents: DataFrame, errors: DataFrame, roots: DataFrame) -> DataFrame:
    """total_extracted, original_count, error_count in one row."""
    tagged = (
        documents.filter("chunk = 0").select(F.lit("d").alias("t"))
        .unionByName(errors.select(F.lit("e").alias("t")))
        .unionByName(roots.select(F.lit("r").alias("t")))
    )
    count = lambda t: F.count_if(F.col("t") == t)
    return tagged.agg(count("d").alias("total_extracted"), count("r").alias("original_count"), count("e").alias("error_count"))
