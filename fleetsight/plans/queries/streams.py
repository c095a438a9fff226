"""Streams replayed over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.plans import fixtures as X
from fleetsight.plans.queries import Queries
from fleetsight.plans.queries.merging import NORMALIZED_SQL, link_columns, links_sql, record_rows, records_sql
from fleetsight.plans.queries.operations import JOBS_SQL, _STATES_SQL
from fleetsight.plans.queries.sqltext import cte
from fleetsight.session import scratch_folder
from fleetsight.sources.tables import load, with_utc_times
from fleetsight.streaming import jobs as J
from fleetsight.streaming import state

QUERIES = Queries()


def _events(spark: SparkSession, folder: str) -> DataFrame:
    columns = spark.read.parquet(f"{folder}/events.parquet").schema
    # A stream reads folders or patterns, and the given table may be a single file.
    return with_utc_times(J.table_stream(spark, f"{folder}/events.parque[t]", columns))


def _drain(stream: DataFrame, handle, mode: str = "append") -> None:
    J.run_available(stream, scratch_folder(stream.sparkSession, "checkpoint"), handle, mode).awaitTermination()


@QUERIES.add("stream_intake_trend", "SELECT CAST(ts AS DATE) AS date, count(*) AS count FROM events GROUP BY 1")
def stream_intake_trend(spark: SparkSession, folder: str) -> DataFrame:
    table = J.TrendTable(spark, "ts")
    _drain(_events(spark, folder), table.handle)
    return table.read()


@QUERIES.add("stream_deduplicated", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def stream_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose hash is made of user and type: only the first of each comes through."""
    out = scratch_folder(spark, "deduplicated")
    raw = _events(spark, folder).withColumns(
        {"raw_hash": F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256), "fetched_at": F.col("ts")}
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select("user_id", "event_type").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _drain(J.deduplicated(raw, "60 days"), keep)
    return spark.read.parquet(out).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def _arrivals(spark: SparkSession, folder: str, order, again=None) -> tuple[DataFrame, str]:
    """The events in three files in a given order of arrival, some of them a second time in a fourth.

    The stream takes one file a batch.
    """
    events, out = load(spark, folder, "events"), scratch_folder(spark, "arrivals")
    for number in range(3):
        events.filter(order == number).coalesce(1).write.mode("append").parquet(out)
    if again is not None:
        events.filter(again).coalesce(1).write.mode("append").parquet(out)
    return J.table_stream(spark, out, events.schema, files_per_batch=1), out


_PENDING_SQL = (
    NORMALIZED_SQL
    + """
    , ends AS (SELECT min(epoch(fetched_at)) AS low, max(epoch(fetched_at)) AS high FROM normal),
    sent AS (SELECT g.*, floor((high - epoch(fetched_at)) * 3 / (high - low + 1)) AS batch FROM good g, ends WHERE processing_status IN ('pending', 'collected'))"""
)


def _piped(spark: SparkSession, folder: str) -> J.Pipeline:
    """All raw rows through the run in three micro-batches, the newest first, as the fold order of one batch has them.

    Rows of a failed status and rows that do not normalise are among them.
    """
    raw, out = X.raw(spark, folder), scratch_folder(spark, "landed")
    low, high = raw.agg(F.min("fetched_at").cast("long"), F.max("fetched_at").cast("long")).first()
    part = F.floor((F.lit(high) - F.col("fetched_at").cast("long")) * 3 / (high - low + 1)) if high is not None else F.lit(0)
    raw = raw.withColumn("part", part)
    for number in range(3):
        raw.filter(F.col("part") == number).drop("part").write.mode("append").parquet(f"{out}/in-{number}")
    run = J.Pipeline(spark, scratch_folder(spark, "tables"), F.lit("2024-03-01").cast("timestamp"))
    checkpoint = scratch_folder(spark, "checkpoint")
    for number in range(3):
        stream = J.table_stream(spark, f"{out}/in-[0-{number}]", raw.drop("part").schema)
        J.run_available(stream, checkpoint, run.handle).awaitTermination()
    return run


@QUERIES.add("stream_pipeline_records", _PENDING_SQL + records_sql("sent"))
def stream_pipeline_records(spark: SparkSession, folder: str) -> DataFrame:
    return record_rows(_piped(spark, folder).records.read())


@QUERIES.add("stream_pipeline_links", _PENDING_SQL + links_sql("sent", "batch, -doc_id"))
def stream_pipeline_links(spark: SparkSession, folder: str) -> DataFrame:
    return link_columns(_piped(spark, folder).links.read())


def _as_view(stream: DataFrame, name: str) -> DataFrame:
    return stream.selectExpr(*[f"{expression} AS {column}" for column, expression in X.VIEWS[name][1].items()])


@QUERIES.add(
    "stream_source_health",
    JOBS_SQL + _STATES_SQL + "SELECT source_id, cursor, status, last_run_us, consecutive_failures FROM states",
)
def stream_source_health(spark: SparkSession, folder: str) -> DataFrame:
    """The newest runs arrive first, the oldest last, and every seventh comes again."""
    tenth = F.floor(F.dayofmonth("ts") / 11)
    stream, _ = _arrivals(spark, folder, 2 - F.least(tenth, F.lit(2)), F.col("event_id") % 7 == 0)
    health = state.SourceHealth(spark)
    _drain(state.source_health(_as_view(stream, "jobs")), health.handle, "update")
    return health.states().select("source_id", "cursor", "status", F.unix_micros("last_run_at").alias("last_run_us"), "consecutive_failures")


@QUERIES.add(
    "stream_bursts",
    cte("alerts")
    + """
    , n AS (SELECT *, count(*) FILTER (risk_level IN ('high', 'critical')) OVER (PARTITION BY threat_intelligence_id ORDER BY triggered_at RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS n FROM alerts)
    SELECT CAST(id AS VARCHAR) AS id, 'vendor' AS scope, epoch_us(triggered_at) AS time_us, n AS match_count FROM n WHERE n >= 3""",
)
def stream_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """Alert events as records whose vendor is the record they belong to, in three batches that mix all days."""
    stream, _ = _arrivals(spark, folder, F.pmod(F.xxhash64("event_id"), F.lit(3)))
    records = _as_view(stream, "alerts").select(
        "id",
        "risk_level",
        F.concat(F.lit("v"), F.col("threat_intelligence_id")).alias("affected_vendor"),
        F.lit(None).cast("string").alias("vehicle_component"),
        F.lit(None).cast("string").alias("attack_surface"),
        F.col("triggered_at").alias("first_seen_at"),
    )
    detector = state.BurstDetector(spark)
    _drain(state.burst_counts(records, "60 days"), detector.handle, "update")
    return detector.bursts().select("id", "scope", F.unix_micros("first_seen_at").alias("time_us"), "match_count")
