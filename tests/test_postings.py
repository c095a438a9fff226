"""Postings: what a search reads, batches that come again, changed rows, odd needles."""

import re

import pytest
from pyspark.sql import functions as F

from fleetsight.functions.text import contains_ignoring_case
from fleetsight.operators import postings as P

TEXTS = {
    1: "The quick brown fox", 2: "quick fox, the END", 3: None, 4: "", 5: "ab", 6: "100%_done", 7: "Ünïcode 😀😀😀 text", 8: "foxes are quick",
    9: "aaaa aaaa", 10: "THE the The",
}


def rows(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


def made(spark, texts, folder, batch="0", **layout):
    found = P.postings(rows(spark, texts), "id", {P.WORD_KIND: {"text": F.col("text")}, P.GRAM_KIND: {"text": F.col("text")}})
    P.add_batch(found, folder, batch, **layout)
    return P.read(spark, folder)


def ids(frame):
    return sorted(row["id"] for row in frame.collect())


def test_words_in_any_order(spark, tmp_path):
    table = made(spark, TEXTS, str(tmp_path))
    assert ids(P.ids_with_all(table, P.WORD_KIND, "the QUICK")) == [1, 2]
    assert ids(P.ids_with_all(table, P.WORD_KIND, "the the")) == [1, 2, 10]
    assert ids(P.ids_with_all(table, P.WORD_KIND, "fox zebra")) == []


@pytest.mark.parametrize("needle", ["quick", "UICK F", "%_d", "ïco", "😀😀😀", "aaaa", "a a", "the"])
def test_gram_candidates_hold_every_match(spark, tmp_path, needle):
    table = made(spark, TEXTS, str(tmp_path))
    exact = ids(rows(spark, TEXTS).filter(contains_ignoring_case("text", needle)))
    candidates = ids(P.ids_with_all(table, P.GRAM_KIND, needle.lower()))
    assert exact and set(exact) <= set(candidates)


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    before = made(spark, TEXTS, str(tmp_path)).count()
    table = made(spark, TEXTS, str(tmp_path))
    assert table.count() == before
    table = made(spark, {11: "quick as the wind"}, str(tmp_path), batch="1")
    assert ids(P.ids_with_all(table, P.WORD_KIND, "the quick")) == [1, 2, 11]
    P.compact(spark, str(tmp_path), str(tmp_path) + "-compact")
    whole = P.read(spark, str(tmp_path) + "-compact")
    assert whole.count() == table.count() and [row[0] for row in whole.select("batch").distinct().collect()] == ["all"]
    assert ids(P.ids_with_all(whole, P.WORD_KIND, "the quick")) == [1, 2, 11]


def test_the_plan_reads_the_wanted_buckets_only(spark, tmp_path):
    table = made(spark, TEXTS, str(tmp_path))
    found = P.ids_with_all(table, P.WORD_KIND, "fox")
    plan = found._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(P.bucket_of(F.lit("fox"))).first()[0]
    assert re.search(rf"PartitionFilters: \[.*bucket#\d+ = {bucket}\)?", plan)
    assert re.search(r"PushedFilters: \[.*EqualTo\(term,fox\)", plan)
    read = {name.split("bucket=")[1].split("/")[0] for name in table.filter(F.col("bucket") == bucket).inputFiles() if "bucket=" in name}
    assert str(bucket) in read


def test_a_frequent_word_lies_in_several_files(spark, tmp_path):
    texts = {k: f"common w{k}" for k in range(400)}
    made(spark, texts, str(tmp_path), buckets=4, slots=4)
    table = P.read(spark, str(tmp_path))
    files = table.filter((F.col("term") == "common") & (F.col("kind") == P.WORD_KIND)).select(F.input_file_name().alias("f"))
    counts = [row["count"] for row in files.groupBy("f").count().collect()]
    assert len(counts) == 4 and max(counts) < 200
    assert len(ids(P.ids_with_all(table, P.WORD_KIND, "common", buckets=4))) == 400


def test_rows_that_changed_are_thrown_out_by_the_exact_test(spark, tmp_path):
    from fleetsight.operators import search as S
    from fleetsight.plans import fixtures as X

    folder = "/root/testdata/sf0.001"
    records, links = X.records(spark, folder), X.links(spark, folder)
    index = P.SearchIndex(spark, str(tmp_path), buckets=4, slots=1)
    index.add("0", records, links)
    some = [row["id"] for row in records.select("id").orderBy("id").limit(2).collect()]
    changed = records.withColumn("title", F.when(F.col("id") == some[0], F.lit("Brand new wording")).otherwise(F.lit("plain")))
    index.add("1", changed.filter(F.col("id").isin(some)))
    assert ids(index.search(changed, links, S.SearchParams(q="new WORDING"))) == [some[0]]
    old = records.filter(F.col("id") == some[1]).first()["title"]
    assert some[1] not in ids(index.search(changed, links, S.SearchParams(q=old)))


def test_postings_take_about_a_byte_an_id(spark, tmp_path):
    rows_ = spark.range(0, 20000, 1, 1).select("id", F.concat(F.lit("common w"), F.col("id") % 40).alias("text"))
    found = P.postings(rows_, "id", {P.WORD_KIND: {"text": F.col("text")}, P.GRAM_KIND: {"text": F.col("text")}})
    whole = found.agg(F.sum("n").alias("ids"), F.sum(F.length("packed")).alias("bytes"), F.count("*").alias("rows")).first()
    assert whole["ids"] > 40_000 and whole["bytes"] < whole["ids"] // 4 and whole["rows"] < 1_000
    P.add_batch(found, str(tmp_path), "0")
    table = P.read(spark, str(tmp_path))
    assert ids(P.ids_with_all(table, P.WORD_KIND, "common w7")) == list(range(7, 20000, 40))
    assert P.flat(table).count() == whole["ids"]


@pytest.mark.parametrize("given", [[0], [-5, 0, 1, 1 << 40], list(range(0, 9000, 3)), [-(1 << 63), (1 << 63) - 1]])
def test_ids_come_back_from_their_packed_form(given):
    import numpy as np

    assert P.unpack(P.pack(np.array(given, dtype=np.int64))).tolist() == given


def test_ids_of_any_type_and_null(spark, tmp_path):
    named = spark.createDataFrame([("a", "red fox"), ("b", "red"), (None, "red fox"), ("a", "fox")], "id string, text string")
    P.add_batch(P.postings(named, "id", {P.WORD_KIND: {"text": F.col("text")}}), str(tmp_path / "s"), "0")
    found = P.ids_with_all(P.read(spark, str(tmp_path / "s")), P.WORD_KIND, "fox red").collect()
    assert {row["id"] for row in found} == {"a", None} and len(found) == 2
    numbered = spark.createDataFrame([(1, "red fox"), (None, "red fox"), (3, "fox")], "id long, text string").coalesce(1)
    P.add_batch(P.postings(numbered, "id", {P.WORD_KIND: {"text": F.col("text")}}), str(tmp_path / "n"), "0")
    P.compact(spark, str(tmp_path / "n"), str(tmp_path / "c"))
    for folder in ("n", "c"):
        found = P.ids_with_all(P.read(spark, str(tmp_path / folder)), P.WORD_KIND, "fox red").collect()
        assert {row["id"] for row in found} == {1, None} and len(found) == 2
