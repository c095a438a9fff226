"""Dashboard figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.operators import stats
from fleetsight.plans import fixtures as X
from fleetsight.plans.queries import Queries
from fleetsight.plans.queries.sqltext import cte, values

QUERIES = Queries()
NOW_RECORDS = "2001-07-15 12:00:00"
NOW_EVENTS = "2024-01-30 18:00:00"


def at(text: str):
    return F.lit(text).cast("timestamp")


def _distribution_sql(view: str, dimensions) -> str:
    parts = [
        f"SELECT '{name}' AS dimension, v.value AS value, count(t.{name}) AS count "
        f"FROM (VALUES {values(listed)}) v(value) LEFT JOIN {view} t ON t.{name} = v.value GROUP BY v.value"
        for name, listed in dimensions.items()
    ]
    return cte(view) + " UNION ALL ".join(parts)


@QUERIES.add("severity_distribution", _distribution_sql("records", {"severity": K.SEVERITIES}))
def severity_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distributions(X.records(spark, folder), {"severity": K.SEVERITIES})


@QUERIES.add("record_distributions", _distribution_sql("records", stats.RECORD_DIMENSIONS))
def record_distributions(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distributions(X.records(spark, folder), stats.RECORD_DIMENSIONS)


@QUERIES.add("alert_status_distribution", _distribution_sql("alerts", {"status": K.ALERT_STATUSES}))
def alert_status_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distributions(X.alerts(spark, folder), {"status": K.ALERT_STATUSES})


def _trend_sql(view: str, column: str, now: str) -> str:
    return (
        cte(view)
        + f"""
        , days AS (SELECT CAST(unnest(generate_series(DATE '{now[:10]}' - INTERVAL 29 DAY, DATE '{now[:10]}', INTERVAL 1 DAY)) AS DATE) AS date)
        SELECT d.date AS date, count(t.{column}) AS count
        FROM days d LEFT JOIN {view} t ON CAST(t.{column} AS DATE) = d.date GROUP BY d.date"""
    )


@QUERIES.add("daily_trend_30d", _trend_sql("records", "created_at", NOW_RECORDS))
def daily_trend(spark: SparkSession, folder: str) -> DataFrame:
    return stats.daily_trend(X.records(spark, folder), "created_at", at(NOW_RECORDS))


@QUERIES.add("alert_trend_30d", _trend_sql("alerts", "triggered_at", NOW_EVENTS))
def alert_trend(spark: SparkSession, folder: str) -> DataFrame:
    return stats.daily_trend(X.alerts(spark, folder), "triggered_at", at(NOW_EVENTS))


@QUERIES.add(
    "headline_totals",
    cte("records")
    + f"""
    SELECT count(*) AS total_intelligence,
           count(*) FILTER (created_at >= TIMESTAMP '{NOW_RECORDS}' - INTERVAL 24 HOUR) AS new_last_24_hours,
           count(*) FILTER (created_at >= TIMESTAMP '{NOW_RECORDS}' - INTERVAL 7 DAY) AS new_last_7_days
    FROM records""",
)
def headline_totals(spark: SparkSession, folder: str) -> DataFrame:
    return stats.record_totals(X.records(spark, folder), at(NOW_RECORDS))


@QUERIES.add(
    "enabled_sources", cte("sources") + "SELECT count(*) FILTER (status = 'enabled') AS enabled FROM sources"
)
def enabled_sources(spark: SparkSession, folder: str) -> DataFrame:
    return stats.enabled_sources(X.sources(spark, folder))


@QUERIES.add(
    "source_record_counts",
    cte("links")
    + """
    SELECT source_id, count(DISTINCT threat_intelligence_id) AS intelligence_count
    FROM links WHERE source_id IS NOT NULL GROUP BY source_id""",
)
def source_record_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.source_counts(X.links(spark, folder))


@QUERIES.add(
    "top_sources",
    cte("links", "sources")
    + """
    SELECT s.id AS source_id, s.name AS name, count(DISTINCT l.threat_intelligence_id) AS intelligence_count
    FROM sources s JOIN links l ON l.source_id = s.id
    GROUP BY s.id, s.name ORDER BY intelligence_count DESC, name LIMIT 10""",
)
def top_sources(spark: SparkSession, folder: str) -> DataFrame:
    return stats.top_sources(X.links(spark, folder), X.sources(spark, folder))
