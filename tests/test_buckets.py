"""Upserts rewrite the buckets of their keys, whole and only once."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from fleetsight.sources.buckets import BucketTable
from fleetsight.sources.tables import empty


def states(spark, rows):
    schema = "source_id string, cursor string, status string, consecutive_failures long"
    frame = spark.createDataFrame(rows, schema)
    return frame.withColumn("last_run_at", F.lit(None).cast("timestamp"))


def added(batch):
    """The batch's rows take the place of known ones, and their failures are added up."""

    def fold(known):
        every = known.withColumn("new", F.lit(0)).unionByName(batch.withColumn("new", F.lit(1)))
        return every.groupBy("source_id").agg(
            F.max_by("cursor", "new").alias("cursor"), F.max_by("status", "new").alias("status"),
            F.max("last_run_at").alias("last_run_at"), F.sum("consecutive_failures").alias("consecutive_failures"),
        )

    return fold


def files(path):
    return {str(file): os.stat(file).st_mtime_ns for file in Path(path).rglob("*.parquet")}


def rows(table):
    return {row.source_id: (row.cursor, row.consecutive_failures) for row in table.read().collect()}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), "sync_states", "source_id", buckets=16)
    assert table.read().isEmpty()
    first = states(spark, [(f"s{n}", "a", "success", 1) for n in range(400)] + [(None, "none", "success", 1)])
    table.upsert(first, added(first), "0")
    before = files(table.path)
    assert len(before) == 16
    batch = states(spark, [("s7", "b", "failed", 2), ("new", "c", "failed", 3)])
    numbers = table.touched(batch)
    table.upsert(batch, added(batch), "1")
    after = files(table.path)
    kept = {name for name in before if not any(f"bucket={number}/" in name for number in numbers)}
    assert len(kept) == 16 - len(numbers)
    assert {name for name in after if name in before} == kept and all(after[name] == before[name] for name in kept)
    expected = {f"s{n}": ("a", 1) for n in range(400)} | {None: ("none", 1), "s7": ("b", 3), "new": ("c", 3)}
    assert rows(table) == expected
    # The same run again copies what it folded; it does not fold twice.
    table.upsert(batch, added(batch), "1")
    assert rows(table) == expected
    table.upsert(empty(spark, "sync_states"), added(empty(spark, "sync_states")), "2")
    assert rows(table) == expected


def test_run_that_fails_before_its_mark_is_folded_anew(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), "sync_states", "source_id", buckets=4)
    first = states(spark, [("a", "x", "success", 1), ("b", "x", "success", 1)])
    table.upsert(first, added(first), "0")

    def broken(known):
        raise RuntimeError("lost")

    try:
        table.upsert(first, broken, "1")
    except RuntimeError:
        pass
    assert rows(table) == {"a": ("x", 1), "b": ("x", 1)}
    table.upsert(first, added(first), "1")
    assert rows(BucketTable(spark, str(tmp_path), "sync_states", "source_id", buckets=4)) == {"a": ("x", 2), "b": ("x", 2)}
