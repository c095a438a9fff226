"""Structured Streaming forms of the run: landing, de-duplication, merge, scores, alerts, trends.

Merge, scores and alerts of a micro-batch go through the batch operators, which spread dominating keys;
state by key is in :mod:`fleetsight.streaming.state`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetsight import schema
from fleetsight.operators import alerts as A
from fleetsight.operators import merge as M
from fleetsight.operators import normalize as N
from fleetsight.operators import score as S
from fleetsight.session import checkpointed, prepare, scratch_folder
from fleetsight.sources.buckets import BUCKETS, BucketTable


def landing_stream(spark: SparkSession, folder: str, columns: str = schema.RAW, files_per_batch: int = 1000) -> DataFrame:
    """Raw rows landed as JSON lines; the checkpoint takes the place of a cursor."""
    return prepare(spark).readStream.schema(columns).option("maxFilesPerTrigger", files_per_batch).json(folder)


def table_stream(spark: SparkSession, path: str, columns, files_per_batch: int = 1000) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    return prepare(spark).readStream.schema(columns).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(raw: DataFrame, delay: str = "7 days") -> DataFrame:
    """One row per raw hash; a repeat later than the delay is caught by the merge."""
    return raw.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["raw_hash"])


def run_available(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    """Process what has arrived and stop: the scheduled run."""
    return (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class Pipeline:
    """Normalise, merge, score and alert per micro-batch, in tables of which a batch rewrites the buckets it touches.

    Only records of these buckets are merged and scored: all others are scored already. A batch that is run again
    leaves the same tables.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        now: Column,
        registry: N.Registry | None = None,
        rules=A.RULES,
        buckets: int = BUCKETS,
    ) -> None:
        self.now, self.registry, self.rules = now, registry, rules
        self.records = BucketTable(spark, folder, "threat_intelligence", "dedup_key", buckets)
        self.links = BucketTable(spark, folder, "threat_intelligence_sources", "id", buckets)
        self.alerts = BucketTable(spark, folder, "alerts", "id", buckets)
        self.failures = f"{folder}/normalize_failures"

    def _merged(self, known: DataFrame, good: DataFrame) -> DataFrame:
        merged = M.upsert_records(known, good, self.now).drop("action")
        return S.score_table(checkpointed(merged), now=self.now).drop("score_action")

    def handle(self, raw: DataFrame, batch_id: int) -> None:
        run = str(batch_id)
        good, failed = N.normalize_stage(N.pending(raw), self.registry)
        failed.write.mode("overwrite").parquet(f"{self.failures}/batch={batch_id}")
        self.records.upsert(good, lambda known: self._merged(known, good), run)
        records = self.records.read()
        mine = self.records.read_buckets(self.records.touched(good))
        rows = checkpointed(M.link_rows(good, mine))
        self.links.upsert(rows.select(M.link_id().alias("id")), lambda known: M.add_links(known, rows), run)
        # Cross-record rules can fire for old records too, so all are candidates.
        fresh = checkpointed(A.evaluate_alerts(records, self.links.read(), self.alerts.read(), self.now, rules=self.rules))
        self.alerts.upsert(fresh, lambda known: known.unionByName(fresh.select(*known.columns)), run)


class TrendTable:
    """Daily counts, added up per micro-batch; a repeated batch replaces its own counts."""

    def __init__(self, spark: SparkSession, time: str, folder: str | None = None) -> None:
        self.spark, self.time = spark, time
        self.folder = folder or scratch_folder(spark, "trend")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.to_date(self.time).alias("date")).agg(F.count(F.lit(1)).alias("count"))
        counts.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def read(self) -> DataFrame:
        rows = self.spark.read.schema("date date, count long, batch int").parquet(self.folder)
        return rows.groupBy("date").agg(F.sum("count").alias("count"))
