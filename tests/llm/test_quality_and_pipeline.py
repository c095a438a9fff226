"""The classifier on held-out labels, empty tables, and the pipeline stage by stage."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetsight.llm import bpe, chat, lm_scoring, near_copies, quality, simhash, spotsigs, substring_dedup
from fleetsight.llm.queries import QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


@given
def test_scores_agree_with_labels_that_training_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    seen, held = labels.filter("xxhash64(doc_id, 1) % 2 = 0"), labels.filter("xxhash64(doc_id, 1) % 2 <> 0")
    found = quality.classify(docs, seen).join(held, "doc_id").collect()
    clean = [r.keep for r in found if r.quality == 1 and r.toxic == 0]
    junk = [r.keep for r in found if r.quality == 0]
    assert sum(clean) >= 0.95 * len(clean) and sum(junk) <= 0.15 * len(junk)


def test_em_recovers_accuracies():
    import numpy as np

    rnd = np.random.default_rng(3)
    bad = rnd.random(40_000) < 0.2
    rates = [(0.5, 0.01), (0.4, 0.02), (0.6, 0.05), (0.9, 0.02)]  # the last are people, who label 3 in 10
    said = np.stack([np.where(rnd.random(bad.size) < np.where(bad, *rate), 2, 0) for rate in rates], axis=1)
    said[:, -1] = np.where(rnd.random(bad.size) < 0.3, np.maximum(said[:, -1], 1), 0)
    codes, counts = np.unique(quality.pattern_codes(said), return_counts=True)
    model = quality.fit_labellers(dict(zip(codes.tolist(), counts.tolist())), 4)
    assert model[1] == pytest.approx(0.2, abs=0.05)
    right = [0.2 * hit / (0.2 * hit + 0.8 * false) for hit, false in rates]
    assert np.abs(quality.accuracies(model) - right).max() < 0.1
    assert ((quality.posterior(said, model) > 0.5) == bad).mean() > 0.9


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, "Plain words of a text that says nothing much at all and goes on for a while, as such texts do. " * 3), (2, None), (3, ""), (3, ""), (None, " "), (4, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("junk", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if not r.keep} >= {2, 3, None}
    empty, none = docs.limit(0), labels.limit(0)
    assert quality.classify(docs, none).count() == len(rows) and quality.classify(empty, none).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and near_copies.keep_one(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0 and bpe.encode(empty, tokenizer_path()).count() == 0
    assert spotsigs.compare_edited(empty).count() == 0 and lm_scoring.score(empty, empty).count() == 0
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.rotate(talks).count() == 0


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(5, text, "a"), (9, text, "b"), (5, "zz " + text[:3], "c"), (7, "other words here", "d"), (None, text, "e")]
    docs = spark.createDataFrame(rows + [(7, "other words here", "d")], "doc_id long, text string, row string")
    kept = near_copies.keep_one(docs.withColumn("more", F.create_map(F.lit("k"), "row"))).drop("more")
    assert kept.columns == ["doc_id", "text", "row"]
    got = sorted((r.doc_id or 0, r.row) for r in kept.collect())
    # Two texts under one id are two rows; of equal rows one stays, also beside columns without an order.
    assert got == [(0, "e"), (5, "a"), (5, "c"), (7, "d")]


def test_repeats_are_cut_and_other_texts_stay_as_they_are(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"one\n{passage}  end", "x", 1, 10), (2, f"two\t\n{passage} last\n", "y", 2, 20), (3, None, "z", 3, None), (4, "  a\nb  ", None, 4, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_text string, batch long, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got[1].text == rows[0][1] and got[3].text is None and got[4].text == "  a\nb  "
    assert got[2].text == "two\t\nlast\n" and got[2].n_chars == len("two\t\nlast\n") and got[2].kept_text == "y"
    assert got[1].n_chars == 10 and corpus_pipeline.cut_repeats(spark, docs, "").columns == docs.columns


@given
def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    before, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER).cache()
        assert after.columns == docs.columns
        counts.append((before.count(), after.count()))
        before = after
    assert all(b <= a for a, b in counts) and counts[2][0] == counts[2][1]
    assert before.join(labels.filter("toxic = 1"), "doc_id").count() <= 0.15 * labels.filter("toxic = 1").count()
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = [r.text for r in before.select("text").collect()]
    assert not any(item in text for item in items for text in texts)


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5
