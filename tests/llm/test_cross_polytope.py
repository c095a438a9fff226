"""Nearest neighbours against brute force: exact where all neighbours are asked for, by recall elsewhere."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsight.llm import cross_polytope as C


def frame(spark, rows, kind="float"):
    docs = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    return docs.withColumns({"rank": F.lit("clash"), "score": F.lit(0), "a": F.lit(None).cast("string"), "ids": F.lit(1)})


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        v = tuple(np.float32(x) + np.float32(0) for x in v)
        good.setdefault((i, tuple(np.trim_zeros(v, "b"))), v)
    rows = [(i, v) for i, v in good]
    out = []
    for i, v in rows:
        if i % every:
            continue
        scored = []
        for j, w in rows:
            if j != i:
                score = 0.0
                for x, y in zip(v, w):
                    score += float(x) * float(y)
                scored.append((-score, j))
        out += [(i, at + 1, j, -score) for at, (score, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def run(spark, rows, **more):
    found = C.nearest(frame(spark, rows), **more).select("query_id", "rank", "vec_id", "score")
    return sorted(tuple(row) for row in found.collect())


def vectors(seed, count, size=16):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.float32(v)]) for i, v in enumerate(rng.normal(size=(count, size)))]


ODD = [
    (None, [1.0] * 16), (1000, None), (1020, [0.0] * 16), (1040, []), (1060, [1.0, None] + [0.0] * 14), (1080, [float("nan")] * 16),
    (1100, [float("inf")] + [0.0] * 15), (1120, [1.0, -0.0, 2.0]), (1121, [1.0, 0.0, 2.0] + [-0.0] * 13), (-40, [0.5] * 16),
]


@pytest.mark.parametrize("bucket_rows", [1024, 4])
def test_all_neighbours_equal_brute_force(spark, bucket_rows):
    rows = vectors(1, 150) + ODD
    rows += [(2000 + k, [1.0, 2.0] * 8) for k in range(80)]  # a third of all rows: one vector, 4 queries
    rows += [(2000, [1.0, 2.0] * 8)] * 20 + [(2020, [3.0] * 16)]  # repeated rows; an id with two vectors
    got = run(spark, rows, k=7, recall=1.0, sample=100, bucket_rows=bucket_rows)
    assert [row[:3] for row in got] == [row[:3] for row in brute(rows, 7, 20)]
    assert [row[3] for row in got] == [row[3] for row in brute(rows, 7, 20)]
    assert {2000, 2020, 1120, -40} <= {row[0] for row in got}


def test_recall_with_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    rows = vectors(4, 1200, 32)
    centre = rng.normal(size=32)
    rows += [(2000 + k, [float(x) for x in np.float32(centre + 0.05 * rng.normal(size=32))]) for k in range(600)]
    got = run(spark, rows, bucket_rows=64)
    want = brute(rows, 20, 20)
    assert len(got) == len(want)
    hit = len({(row[0], row[2]) for row in got} & {(row[0], row[2]) for row in want}) / len(want)
    assert hit >= 0.9


def test_fewer_rows_than_neighbours_and_none(spark):
    assert [row[:3] for row in run(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])] == [(0, 1, 2), (0, 2, 1)]
    assert run(spark, [(20, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert run(spark, []) == []


def test_rotations_keep_lengths_and_probes_start_at_the_own_bucket():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(50, 24))
    hashes = C.Hashes(24, C.axes_for(400_000, 24, 16), tables=2)
    assert len(hashes.axes) == 3 and hashes.buckets >= 400_000 / 16
    turned = hashes.turned(rows, 0)[0][:, :32]
    assert np.allclose((turned * turned).sum(axis=1), 1)
    probes = hashes.probes(rows, 1, 40)
    assert (probes[:, 0] == hashes.bucket(rows, 1)).all()
    assert all(len(set(line)) == 40 for line in probes.tolist())
    every = hashes.probes(rows[:2], 1, hashes.buckets)
    assert all(len(set(line)) == hashes.buckets for line in every.tolist())
