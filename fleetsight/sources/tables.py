"""Table scans and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from fleetsight import schema
from fleetsight.session import prepare


def with_utc_times(frame: DataFrame) -> DataFrame:
    """Zone-less times are UTC; windows, watermarks and epoch functions need them typed so."""
    casts = {
        field.name: F.col(field.name).cast("timestamp")
        for field in frame.schema.fields
        if isinstance(field.dataType, TimestampNTZType)
    }
    return frame.withColumns(casts) if casts else frame


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given Parquet table; column pruning and filters reach the scan."""
    return with_utc_times(prepare(spark).read.parquet(f"{folder}/{name}.parquet"))


# Rows of a part, and the most parts: up to that many Spark's shuffle writes parts as they come and holds no rows.
PART_ROWS = 100_000
MOST_PARTS = 200


def dealt(rows: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Rows spread over all tasks, or over ``parts``, by narrow columns, for work that costs far more than moving them.

    A scan has no more tasks than its files have row groups, and a file may have one. Only columns that are used move.
    Without ``parts`` Spark joins small parts by their packed bytes, and narrow rows pack so well that a part can be millions.
    """
    return rows.repartition(parts, *keys) if parts else rows.repartition(*keys)


def parts_of(rows: int, part_rows: int | None = None) -> int:
    return max(1, min(MOST_PARTS, -(-rows // (part_rows or PART_ROWS))))


def parts_for(spark: SparkSession, folder: str, *names: str) -> int:
    """Parts of about ``PART_ROWS`` rows of the named tables together; the rows are counted from the files' footers."""
    return parts_of(sum(load(spark, folder, name).count() for name in names))


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the engine's own tables, read with its declared schema."""
    return prepare(spark).read.schema(schema.TABLES[name]).parquet(f"{folder}/{name}")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema.TABLES[name])


# Files are laid out by the column that searches and recency filters prune on.
PARTITION_DAY = {"raw_intelligence": "fetched_at", "job_logs": "finished_at", "audit_events": "occurred_at"}


def write(frame: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    """Append-only facts by UTC day; other tables as they come."""
    writer = frame.write.mode(mode)
    if name in PARTITION_DAY:
        writer = frame.withColumn("day", F.to_date(PARTITION_DAY[name])).write.mode(mode).partitionBy("day")
    writer.parquet(f"{folder}/{name}")
