"""Collocations against a brute-force version on small texts with every kind of odd row."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetsight.llm import collocations as C

LOWER = {k: k + 32 for k in range(0x41, 0x5B)}


def brute(rows, least, best=2000, subsumed=80):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            held = counts.setdefault(lang, Counter())
            for size in range(1, 5):
                held.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, held in counts.items():
        candidates = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        kept = []
        for phrase, a in candidates.items():
            ways = []
            for k in range(1, len(phrase)):
                l, r = held[phrase[:k]], held[phrase[k:]]
                ways.append((2_000_000 * a // (l + r), k, l, r))
            score, _, l, r = min(ways)
            inside = lambda q: any(q[i : i + len(phrase)] == phrase for i in range(len(q) - len(phrase) + 1))
            if not any(len(q) > len(phrase) and inside(q) and 100 * b >= subsumed * a for q, b in candidates.items()):
                kept.append((score, a, " ".join(phrase), l, r))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k + 1, p, a, l, r, n[lang], s) for k, (s, a, p, l, r) in enumerate(kept[:best])]
    return sorted(out)


def run(spark, rows, least, **more):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    docs = docs.withColumns({"phrase": F.lit("clash"), "total": F.lit(1), "prefix": F.lit(None).cast("string")})
    found = C.collocations(docs, least=least, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(row) for row in found.collect())


def texts(seed, count):
    rng = random.Random(seed)
    words = ["The", "the", "fox", "Öl", "öl", "é b", "x\x0by", "a-b", "\x1c", "end.", "so,", "😀"] + [f"w{k}" for k in range(8)]
    gaps = [" ", "  ", "\t", " \t ", "\n", "; "]
    for _ in range(count):
        yield rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))


@pytest.mark.parametrize("seed, least, best", [(1, 2, 2000), (2, 5, 2000), (3, 3, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, least, best):
    monkeypatch.setattr(C, "CHUNK", 1500)
    monkeypatch.setattr(C, "MERGE_ROWS", 40)
    rows = list(texts(seed, 120)) + [("en", None), (None, ""), ("de", " \t "), ("en", "new york city hall " * 9), ("en", "new york city hall " * 9)]
    got = run(spark, rows, least, best=best)
    assert got == brute(rows, least, best) and len(got) > 10


def test_a_word_in_a_third_of_all_places_and_a_very_long_text(spark):
    rng = random.Random(5)
    long = " ".join("hot" if rng.random() < 0.34 else f"v{rng.randrange(300)}" for _ in range(60_000))
    rows = [("en", long), ("en", "hot " * 500), ("en", "odd pair. " * 40)]
    got = run(spark, rows, 30)
    assert got == brute(rows, 30) and any(row[2] == "odd pair" for row in got)


def test_no_text_and_no_rows(spark):
    assert run(spark, [("en", None), (None, "")], 2) == []
    assert run(spark, [], 2) == []


def test_scores_beyond_64_bits(spark):
    a, parts = 9_000_000_000_000_000_000, 9_999_999_999_999_999_999
    frame = spark.createDataFrame([(a, str(parts))], "a long, p string")
    assert frame.select(C._score(F.col("a"), F.col("p").cast("decimal(20,0)"))).first()[0] == 2_000_000 * a // parts


def test_stripes_of_equal_keys_add_up():
    parts = pa.table({
        "key": ["a\nen", "b\nen", "a\nen"], "total": [3, 1, 2],
        "nexts": pa.array([["x", "y"], [], ["x"]], pa.list_(pa.string())), "counts": pa.array([[1, 1], [], [2]], pa.list_(pa.int64())),
    })
    found = C.merged(parts).to_pylist()
    assert [(row["key"], row["total"], dict(zip(row["nexts"], row["counts"]))) for row in found] == [("a\nen", 5, {"x": 3, "y": 1}), ("b\nen", 1, {})]
