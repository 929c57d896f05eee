import hashlib
import random
import re

from pyspark.sql import functions as F

from paperloom.llm.fill_in_middle import fill_in_middle, restore

SCHEMA = "doc_id long, text string, n string, form string, output string, key string, a int"


def reference(key, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    random.seed(3)
    parts = ["a", "\n", "\n\n", "\u00e4", "\U0001d4b3", "\r\n", " <P", "S>", "$1", "\\", "<M >", "\u2028"]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(12))) for _ in range(300)]
    texts += [None, "", "\n", "no line feed", "x<P>", "<S>", "y<M>z", "<P\n>", "z\n" * 50_000, "w" * 100_000]
    texts += ["a\nb\nc\n"] * 3
    return [(None if i % 50 == 49 else i // 2, t, "n", "f", "o", "k", 1) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    data = rows()
    for percent, spm in ((100, 50), (60, 0), (80, 100)):
        made = fill_in_middle(spark.createDataFrame(data, SCHEMA), percent=percent, spm_percent=spm)
        assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        got = sorted((tuple(r) for r in made.collect()), key=repr)
        assert got == sorted(((r[0], *reference(r[0], r[1], percent, spm)) for r in data), key=repr)


def test_every_text_comes_back(spark):
    made = fill_in_middle(spark.createDataFrame(rows(), SCHEMA)).withColumn("back", restore(F.col("output"), F.col("form")))
    assert sorted(r["back"] for r in made.collect()) == sorted(r[1] or "" for r in rows())


def test_other_units_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two  three four")], "doc_id long, text string")
    row = fill_in_middle(df, unit=r"\S++\s*+").first()
    assert row["n"] == 4 and sum(map(len, re.split("<[PSM]>", row["output"]))) == 19
    assert fill_in_middle(df.limit(0)).collect() == []


def test_no_python_and_no_shuffle(spark):
    plan = fill_in_middle(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
