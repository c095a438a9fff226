"""Fill-in-the-middle against a brute-force version, and the rows that have no ordinary text."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fleetsight.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ROWS = [
    (1, "a b c d e"), (2, None), (3, ""), (4, " \t\n"), (5, "x <P> y"), (6, "q w \U0001f600 e\n\nr "), (7, "  lead $1 \\ x"),
    (8, "one"), (9, "b c \x1c d"), (9, "b c \x1c d"), (None, "no id at all"), (-4, "under < P > zero <"), (10, "tail<"),
]


def brute(doc_id, text, changed=50, suffix_first=80):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    cuts = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[: cuts[0]]), "".join(units[cuts[0] : cuts[1]]), "".join(units[cuts[1] :])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= changed:
        return len(units), "plain", text, None, None
    if h[3] % 100 < suffix_first:
        return len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


@pytest.mark.parametrize("changed, suffix_first", [(50, 80), (100, 0), (100, 100), (0, 80)])
def test_equals_brute_force(spark, changed, suffix_first):
    settings = M.Settings(changed=changed, suffix_first=suffix_first)
    rows = ROWS + [(100 + k, f"w{k} " * k + "end") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("form", F.lit(1))
    made = M.transform(docs, settings)
    found = M.parts(F.col("output"), F.col("form"), settings)
    made = made.select("*", F.length(found["prefix"]).alias("p"), F.length(found["middle"]).alias("m"), M.restore(F.col("output"), F.col("form")).alias("back"))
    got = sorted((repr(r.doc_id), r.n, r.form, r.output, r.p, r.m) for r in made.collect())
    assert got == sorted((repr(i), *brute(i, t, changed, suffix_first)) for i, t in rows)
    assert all(r.back == r.text for r in made.collect())


def test_a_very_long_text(spark):
    text = "word  next\tone " * 200_000
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    row = M.transform(docs, M.Settings(changed=100)).first()
    assert (row.n, row.form, row.output) == brute(5, text, 100)[:3]


def test_empty_table(spark):
    assert M.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_markers(spark):
    settings = M.Settings(changed=100, prefix="$1\\", suffix="(S)", middle="[M]")
    docs = spark.createDataFrame([(k, f"a{k} b c <P> d") for k in range(20)], "doc_id long, text string")
    made = M.transform(docs, settings)
    rows = made.select("text", "form", M.restore(F.col("output"), F.col("form"), settings).alias("back")).collect()
    assert all(row.back == row.text and row.form != "plain" for row in rows)


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "<M>")])
def test_markers_that_cannot_be_told_apart(marks):
    with pytest.raises(ValueError):
        M.Settings(prefix=marks[0], suffix=marks[1], middle=marks[2])
