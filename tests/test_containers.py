"""Container bytes are built here with the standard library."""

import hashlib
import io
import tarfile
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from paperloom.operators import containers as c


def zip_bytes(members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        for name, data in members:
            zf.writestr(name, data)
    return buf.getvalue()


def tgz_bytes(members):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tf:
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        tf.addfile(folder)
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tf.addfile(info, io.BytesIO(data))
    return buf.getvalue()


def mail_bytes():
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Message-ID"] = "Offer", "a@x.org", "b@y.org", "<1@x.org>"
    m.set_content("Hello body")
    m.add_attachment(b"first", maintype="application", subtype="pdf", filename="a:b.pdf")
    m.add_attachment(b"second", maintype="application", subtype="pdf", filename="a:b.pdf")
    m.add_attachment(b"third", maintype="application", subtype="pdf", filename="a_b_1.pdf")
    m.add_attachment(b"\x89PNG", maintype="image", subtype="png", disposition="inline")
    return m.as_bytes()


def files(spark, rows):
    return spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path STRING, content BINARY")


def names(df, col="path"):
    return sorted(r[0] for r in df.select(col).collect())


def test_container_type(spark):
    paths = ["a.zip", "A.TAR.GZ", "b.tgz", "c.eml", "d.Msg", "e.pdf", "zip", "f.7z.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING")
    got = [r[0] for r in df.select(c.container_type(F.col("path"))).collect()]
    assert got == ["archive", "archive", "archive", "email", "email", None, None, None]


def test_archives_keep_good_members_and_report_bad_ones(spark):
    rows = [
        ("x.zip", zip_bytes([("a.txt", b"1"), ("dir/", b""), ("__MACOSX/a.txt", b"j"), ("~$b.doc", b"j"), ("dir/b.txt", b"2")])),
        ("y.tgz", tgz_bytes([("t.txt", b"3")])),
        ("broken.zip", b"PK not a zip"),
        ("plain.gz", b"\x1f\x8bnope"),
        ("old.rar", b"Rar!"),
    ]
    got = c.decompose(files(spark, rows))
    docs = names(got["documents"])
    assert docs == ["broken.zip", "old.rar", "plain.gz", "x.zip/a.txt", "x.zip/dir/b.txt", "y.tgz/t.txt"]
    errors = {r["path"]: r["error"] for r in got["errors"].collect()}
    assert set(errors) == {"broken.zip", "plain.gz", "old.rar"}
    assert "unsupported container: rar" in errors["old.rar"]
    summary = c.preprocess_summary(got["documents"], got["errors"], files(spark, rows)).first()
    assert tuple(summary) == (6, 5, 3)


def test_large_members_arrive_in_chunks(spark):
    big = bytes(range(256)) * 3
    inner = zip_bytes([("deep", b"z" * 90)])
    rows = [("x.zip", zip_bytes([("big", big), ("small", b"y"), ("copy", big), ("in.zip", inner)])), ("m.eml", mail_bytes())]
    got = c.decompose(files(spark, rows), chunk_bytes=100)
    docs = got["documents"].orderBy("path", "chunk").collect()
    parts = [bytes(r["content"]) for r in docs if r["path"] == "x.zip/big"]
    assert [len(p) for p in parts] == [100] * 7 + [68] and b"".join(parts) == big
    assert {(r["file_size"], r["file_hash"]) for r in docs if r["path"] == "x.zip/big"} == {(768, hashlib.sha256(big).hexdigest())}
    assert {r["path"] for r in docs} == {"x.zip/big", "x.zip/small", "x.zip/in.zip", "m.eml/a_b.pdf", "m.eml/a_b_1.pdf", "m.eml/a_b_1_1.pdf"}
    assert b"".join(bytes(r["content"]) for r in docs if r["path"] == "x.zip/in.zip") == inner
    assert [(r["path"], r["error"]) for r in got["errors"].collect()] == [
        ("x.zip/in.zip", f"container of {len(inner)} bytes arrived in chunks")
    ]
    assert got["lineage"].count() == 8
    assert c.preprocess_summary(got["documents"], got["errors"], files(spark, rows)).first()["total_extracted"] == 6


def test_email_parts(spark):
    df = files(spark, [("m.eml", mail_bytes()), ("bad.eml", b"\xff\xfe no headers")]).withColumn("document_id", F.col("path"))
    messages, attachments = c.explode_emails(df)
    m = {r["container_id"]: r for r in messages.collect()}
    assert (m["m.eml"]["subject"], m["m.eml"]["attachment_count"], m["m.eml"]["inline_image_count"]) == ("Offer", 3, 1)
    assert m["m.eml"]["body"].strip() == "Hello body"
    got = [(r["ordinal"], r["name"], bytes(r["content"])) for r in attachments.orderBy("ordinal").collect()]
    assert got == [(0, "a_b.pdf", b"first"), (1, "a_b_1.pdf", b"second"), (2, "a_b_1_1.pdf", b"third")]


def nested(levels):
    data, name = b"core", "core.txt"
    for i in range(levels):
        data, name = zip_bytes([(name, data)]), f"z{i}.zip"
    return name, data


def test_depth_limit(spark):
    name, data = nested(6)
    got = c.decompose(files(spark, [(name, data)]))
    docs = got["documents"].select("path", "depth", "note").collect()
    assert [(r["path"], r["depth"], r["note"]) for r in docs] == [
        ("z5.zip/z4.zip/z3.zip/z2.zip/z1.zip", 4, "max_depth_reached")
    ]
    assert got["lineage"].count() == 5
    deep = c.decompose(files(spark, [(name, data)]), max_depth=10)
    assert [r["path"].split("/")[-1] for r in deep["documents"].collect()] == ["core.txt"]


def test_lineage_chain_tree_and_children(spark):
    name, data = nested(2)
    got = c.decompose(files(spark, [(name, data), ("lone.pdf", b"%PDF")]))
    lineage = got["lineage"]
    chains = {r["length"] for r in c.lineage_chain(lineage).collect()}
    assert chains == {1, 2, 3}
    tree = sorted(r["tree_path"] for r in c.document_tree(lineage).collect())
    assert tree == ["lone.pdf", "z1.zip", "z1.zip/z0.zip", "z1.zip/z0.zip/core.txt"]
    assert {r["n_children"] for r in c.children_counts(lineage).collect()} == {1}
    kinds = {r["metadata"]["file_name"]: (r["container_type"], r["extraction_depth"], r["metadata"]["extension"]) for r in lineage.collect()}
    assert kinds["core.txt"] == ("document", 2, ".txt")
    assert kinds["z1.zip"] == ("archive", 0, ".zip")


def test_dedup_is_per_root_and_shallowest_first(spark):
    inner = zip_bytes([("copy.txt", b"same"), ("other.txt", b"other")])
    rows = [
        ("r1.zip", zip_bytes([("in.zip", inner), ("top.txt", b"same"), ("again.txt", b"same")])),
        ("r2.zip", zip_bytes([("top.txt", b"same")])),
    ]
    got = c.decompose(files(spark, rows))
    assert names(got["documents"]) == ["r1.zip/in.zip/other.txt", "r1.zip/top.txt", "r2.zip/top.txt"]


def test_messages_of_nested_mail(spark):
    got = c.decompose(files(spark, [("box.zip", zip_bytes([("m.eml", mail_bytes())]))]))
    assert got["messages"].count() == 1
    assert names(got["documents"]) == ["box.zip/m.eml/a_b.pdf", "box.zip/m.eml/a_b_1.pdf", "box.zip/m.eml/a_b_1_1.pdf"]


def sequential_names(given):
    taken, out = set(), []
    for n in given:
        stem, dot, ext = n.rpartition(".") if "." in n.lstrip(".") else (n, "", "")
        unique, k = n, 0
        while unique in taken:
            k += 1
            unique = f"{stem}_{k}{dot}{ext}"
        taken.add(unique)
        out.append(unique)
    return out


def test_unique_names_equal_one_by_one_naming(spark):
    given = ["a.txt", "a.txt", "a_1.txt", "a.txt", "b", "b", "b_1", "a_1.txt", "a.txt", "c.tar.gz", "c.tar.gz", ".env", ".env"]
    rows = [("p", i, n) for i, n in enumerate(given)] + [("q", i, n) for i, n in enumerate(["x.txt", "x.txt"])]
    df = spark.createDataFrame(rows, "parent_id STRING, ordinal BIGINT, name STRING")
    got = {(r["parent_id"], r["ordinal"]): r["unique_name"] for r in c.unique_names(df).collect()}
    for i, want in enumerate(sequential_names(given)):
        assert got[("p", i)] == want
    assert got[("q", 1)] == "x_1.txt"


def test_clean_name(spark):
    df = spark.createDataFrame([(' a/b\\c:d*e?f"g<h>i|j\x00 ',)], "n STRING")
    assert df.select(c.clean_name(F.col("n"))).first()[0] == "a_b_c_d_e_f_g_h_i_j_"


def test_replication_runs_once_per_content(spark):
    df = spark.createDataFrame([("1", "h"), ("2", "h"), ("3", "g")], "document_id STRING, file_hash STRING")
    out = c.dedup_and_replicate(df, lambda d: d.withColumn("made_from", F.col("document_id")), hot_rows=2)
    assert sorted((r["document_id"], r["made_from"]) for r in out.collect()) == [("1", "1"), ("2", "1"), ("3", "3")]


def test_unpack_as_a_table_function(spark):
    c.register_unpack(spark)
    files(spark, [("x.zip", zip_bytes([("a", b"1"), ("b", b"2")])), ("y.zip", b"no")]).createOrReplaceTempView("packed")
    rows = spark.sql("SELECT p.path, m.name, m.error FROM packed p, LATERAL unpack(p.path, p.content) m").collect()
    assert sorted((r["path"], r["name"] or "") for r in rows) == [("x.zip", "a"), ("x.zip", "b"), ("y.zip", "")]
    assert [r["error"] is not None for r in rows if r["path"] == "y.zip"] == [True]


def test_chain_with_a_wide_parent(spark):
    rows = [("r", None, "root")] + [(f"c{i}", "r", f"n{i}") for i in range(30)] + [("lost", "gone", "lost")]
    df = spark.createDataFrame(rows, "document_id STRING, parent_id STRING, file_name STRING")
    got = {r["document_id"]: r["chain"] for r in c.lineage_chain(df).collect()}
    assert got["c7"] == ["r", "c7"] and got["r"] == ["r"] and got["lost"] == ["lost"] and len(got) == 32
    assert {r["tree_path"] for r in c.document_tree(df, "file_name").collect()} >= {"root", "root/n7", "lost"}


def test_deep_chains_are_whole_and_cycles_raise(spark):
    rows = [(str(i), str(i - 1) if i else None, f"n{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "document_id STRING, parent_id STRING, file_name STRING")
    got = {r["document_id"]: (r["chain"], r["length"]) for r in c.lineage_chain(df).collect()}
    assert got["11"] == ([str(i) for i in range(12)], 12)
    only = c.lineage_chain(df, spark.createDataFrame([("8",)], "document_id STRING")).collect()
    assert [r["length"] for r in only] == [9]
    assert max(r["level"] for r in c.document_tree(df, "file_name").collect()) == 12
    loop = spark.createDataFrame([("a", "b", ""), ("b", "c", ""), ("c", "a", ""), ("d", None, "")], df.schema)
    with pytest.raises(ValueError, match="cycle"):
        c.lineage_chain(loop)


def test_many_taken_numbers(spark):
    given = [f"a_{i}.txt" for i in range(1, 1500)] + ["a.txt"] * 40 + ["a_3.txt", "a_3_1.txt", "a_3.txt"] + ["b"] * 3 + ["b_1"]
    df = spark.createDataFrame([("p", i, n) for i, n in enumerate(given)], "parent_id STRING, ordinal BIGINT, name STRING")
    got = {r["ordinal"]: r["unique_name"] for r in c.unique_names(df).collect()}
    assert [got[i] for i in range(len(given))] == sequential_names(given)


def test_names_of_a_family_are_numbered_across_blocks(spark, monkeypatch):
    import random

    from paperloom.operators import naming

    monkeypatch.setattr(naming, "BLOCK", 3)
    monkeypatch.setattr(c, "RANK_BLOCK", 3)
    rng, given = random.Random(20), {}
    for p in range(150):
        stems = ["a"] + [f"a_{i}" for i in range(rng.choice([3, 12]))] + [f"a_{rng.randint(1, 3)}_{i}" for i in range(1, 6)] + ["a_1_1_1", "a_01"]
        weights = [rng.choice([1, 4, 20])] + [1] * (len(stems) - 1)
        given[f"p{p}"] = [s + ".txt" for s in rng.choices(stems, weights, k=rng.choice([5, 15, 60]))]
    given["deep"] = ["a", "a"] + ["a" + "_1" * i for i in range(1, 9)] * 2
    given["odd"] = [".pdf", "_1.pdf", ".pdf", "_1.pdf", "x_1", "x", "x", "x_1", ".pdf_1", "a_99999999999999999999", "a", "a"]
    rows = [(p if p != "odd" else None, i if i else None, n) for p, names in given.items() for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "parent_id STRING, ordinal BIGINT, name STRING")
    got = {(r["parent_id"], r["ordinal"]): r["unique_name"] for r in c.unique_names(df).collect()}
    for p, names in given.items():
        for i, want in enumerate(sequential_names(names)):
            key = (p if p != "odd" else None, i if i else None)
            if key in got or (p != "odd" and i):
                assert got[key] == want, (p, i, names)
    assert sum(p is None for p, _ in got) > 5 and sum(i is None for _, i in got) > 100


def test_no_task_names_a_whole_family(spark, monkeypatch):
    from paperloom.operators import naming

    monkeypatch.setattr(naming, "BLOCK", 64)
    monkeypatch.setattr(c, "RANK_BLOCK", 64)
    names = [f"n_{4 * i}.pdf" for i in range(1, 2000)] + ["n.pdf"] * 800
    df = spark.createDataFrame([("p", i, n) for i, n in enumerate(names)], "parent_id STRING, ordinal BIGINT, name STRING")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = c.unique_names(df).withColumn("_part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r["unique_name"] for r in sorted(out, key=lambda r: r["ordinal"])] == sequential_names(names)
    sizes = {}
    for r in out:
        sizes[r["_part"]] = sizes.get(r["_part"], 0) + 1
    assert max(sizes.values()) < len(names) / 2
