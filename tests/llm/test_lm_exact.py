"""The n-gram models against dictionaries on given documents; chances are chances."""

import math
import os
from collections import Counter

import numpy as np
import pytest

from fleetsight.llm import lm_scoring as L

FOLDER = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


class Dictionaries:
    """Counts of whole byte strings, kept in dictionaries."""

    def __init__(self, texts, scale):
        self.scale, self.five, self.four, self.three, self.two, self.one = scale, Counter(), Counter(), Counter(), Counter(), Counter()
        for text in texts:
            data = b"\0" * 4 + text
            for k in range(4, len(data)):
                for counts, part in ((self.five, data[k - 4 : k + 1]), (self.four, data[k - 4 : k]), (self.three, data[k - 2 : k + 1]), (self.two, data[k - 2 : k]), (self.one, data[k : k + 1])):
                    counts[part] += 1
        self.n = sum(self.one.values())

    def loss(self, text):
        data, total, s = b"\0" * 4 + text, 0.0, self.scale
        for k in range(4, len(data)):
            chance = (self.one[data[k : k + 1]] * s + 1) / (self.n * s + 256)
            chance = (self.three[data[k - 2 : k + 1]] * s + 4 * chance) / (self.two[data[k - 2 : k]] * s + 4)
            chance = (self.five[data[k - 4 : k + 1]] * s + 4 * chance) / (self.four[data[k - 4 : k]] * s + 4)
            assert 0 < chance <= 1
            total -= math.log(chance)
        return total / max(len(text), 1)


@given
@pytest.mark.parametrize("chunk", [1 << 22, 20_000])
def test_given_documents_equal_dictionary_models(spark, monkeypatch, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(250).cache()
    talks = spark.read.parquet(f"{FOLDER}/conversations.parquet").limit(400).cache()
    raw = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    aim = [(r.text or "").encode() for r in talks.collect()]
    scale = sum(map(len, aim)) / sum(map(len, raw.values()))
    target, background = Dictionaries(aim, 1.0), Dictionaries(raw.values(), scale)
    rows = L.score(docs, talks).collect()
    assert sorted(r.doc_id for r in rows) == sorted(raw)
    for r in rows:
        text = raw[r.doc_id]
        assert r.n_tokens == len(text)
        assert r.target_loss == pytest.approx(target.loss(text), abs=1e-5)
        assert r.background_loss == pytest.approx(background.loss(text), abs=1e-5)
        assert r.score == pytest.approx(r.target_loss - r.background_loss, abs=1e-9)


@given
def test_no_loss_of_the_given_documents_is_negative(spark):
    import pyarrow.parquet as pq

    texts = [t.encode() for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist() if t]
    found = L.grams(texts)[0]
    keys, counts = np.unique(found, return_counts=True)
    threes, n = np.unique(found & 0xFFFFFF, return_counts=True)
    loss = L.losses(keys, (keys, counts.astype(float)), L.Lower(threes, n), 1.0)
    assert loss.min() >= 0 and loss.size > 200_000


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, "abc"), (2, None), (3, ""), (4, "é" * 3)], "doc_id long, text string")
    talks = spark.createDataFrame([("abc abc",), (None,)], "text string")
    rows = L.score(docs, talks).collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.n_tokens == 3}) == 1
    assert all(r.score == 0 for r in rows if r.n_tokens == 0)
    assert L.score(docs.limit(0), talks).count() == 0 and L.score(docs, talks.limit(0)).count() == 6
    uniform = L.score(docs, talks.limit(0)).filter("doc_id = 4").first()
    assert uniform.target_loss == pytest.approx(math.log(256), abs=1e-6)
