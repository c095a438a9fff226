"""Dashboard figures. Every figure is an aggregate with a map-side part."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight import constants as K

RECORD_DIMENSIONS = {
    "intelligence_type": K.INTELLIGENCE_TYPES,
    "severity": K.SEVERITIES,
    "risk_level": K.RISK_LEVELS,
    "processing_status": K.PROCESSING_STATUSES,
}


def distributions(frame: DataFrame, dimensions: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows (dimension, value, count) with every listed value present, zeros included.

    All dimensions come from one pass: each value is a conditional count.
    """
    cells = [(name, value) for name, values in dimensions.items() for value in values]
    counted = frame.agg(
        *[F.count_if(F.col(name) == value).alias(f"n{position}") for position, (name, value) in enumerate(cells)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.lit(value).alias("value"), F.col(f"n{position}").alias("count"))
            for position, (name, value) in enumerate(cells)
        ]
    )
    return counted.select(F.inline(rows))


def daily_trend(frame: DataFrame, time: str, now: Column, days: int = K.TREND_DAYS) -> DataFrame:
    """Rows (date, count) for the last ``days`` UTC days, oldest first, zeros included."""
    today = F.to_date(now)
    first = F.date_sub(today, days - 1)
    start = first.cast("timestamp")
    counts = (
        frame.filter((F.col(time) >= start) & (F.col(time) < F.date_add(today, 1).cast("timestamp")))
        .groupBy(F.to_date(time).alias("date"))
        .agg(F.count(F.lit(1)).alias("found"))
    )
    calendar = frame.sparkSession.range(1).select(F.explode(F.sequence(first, today)).alias("date"))
    return calendar.join(counts, "date", "left").select("date", F.coalesce("found", F.lit(0)).alias("count"))


def record_totals(records: DataFrame, now: Column, created: str = "created_at") -> DataFrame:
    """Total, last 24 hours and last 7 days in one pass."""
    return records.agg(
        F.count(F.lit(1)).alias("total_intelligence"),
        F.count_if(F.col(created) >= now - F.expr("INTERVAL 24 HOURS")).alias("new_last_24_hours"),
        F.count_if(F.col(created) >= now - F.expr("INTERVAL 7 DAYS")).alias("new_last_7_days"),
    )


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count_if(F.col("status") == "enabled").alias("enabled"))


def source_counts(links: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct records per source id. Exact counts group by (source, record) first, so a hot source is spread."""
    known = links.filter(F.col("source_id").isNotNull())
    count = F.approx_count_distinct if approximate else F.count_distinct
    return known.groupBy("source_id").agg(count("threat_intelligence_id").alias("intelligence_count"))


def top_sources(links: DataFrame, sources: DataFrame, limit: int = K.TOP_SOURCES, approximate: bool = False) -> DataFrame:
    """Sources with most records; counted before the join, so the join sees one row per source."""
    named = sources.select(F.col("id").alias("source_id"), "name")
    return (
        source_counts(links, approximate)
        .join(named, "source_id")
        .orderBy(F.desc("intelligence_count"), "name", "source_id")
        .limit(limit)
    )


def overview(records: DataFrame, alerts: DataFrame, sources: DataFrame, links: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The dashboard as named, lazy tables."""
    return {
        "totals": record_totals(records, now),
        "distributions": distributions(records, RECORD_DIMENSIONS),
        "trend": daily_trend(records, "created_at", now),
        "alerts_total": alerts.agg(F.count(F.lit(1)).alias("total")),
        "alerts_by_status": distributions(alerts, {"status": K.ALERT_STATUSES}),
        "alerts_trend": daily_trend(alerts, "triggered_at", now),
        "sources_enabled": enabled_sources(sources),
        "sources_top": top_sources(links, sources),
    }
