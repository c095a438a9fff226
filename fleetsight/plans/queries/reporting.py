"""Exports and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.operators import exports as E
from fleetsight.operators import search as S
from fleetsight.plans import fixtures as X
from fleetsight.plans.queries import Queries
from fleetsight.plans.queries.searching import _CLEAN_URL
from fleetsight.plans.queries.sqltext import cte, rank, safe
from fleetsight.sources.tables import parts_for

QUERIES = Queries()

_URLS = f"array_to_string(list_filter([{_CLEAN_URL.format('url_1')}, url_2], lambda x: x IS NOT NULL), ' | ')"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S+00:00')"
_ROW = f"""SELECT CAST(id AS STRING) AS id, title, {safe('summary')} AS summary, intelligence_type, cve_id, severity, risk_level, risk_score, status, affected_vendor, affected_product,
        vehicle_component, attack_surface, array_to_string(source_names, ' | ') AS source_names, {_URLS} AS source_urls, {_ISO.format('first_seen_at')} AS first_seen_at,
        {_ISO.format('last_seen_at')} AS last_seen_at FROM records"""


@QUERIES.add("intelligence_report_rows", cte("records") + _ROW)
def intelligence_report_rows(spark: SparkSession, folder: str) -> DataFrame:
    return E.intelligence_rows(X.records(spark, folder))


@QUERIES.add(
    "intelligence_export",
    cte("records")
    + "SELECT "
    + ", ".join(f'{name} AS "{header}"' for name, header in K.INTELLIGENCE_CSV_HEADERS.items())
    + f" FROM ({_ROW} WHERE risk_level = 'high' ORDER BY records.last_seen_at DESC, records.id LIMIT 100)",
)
def intelligence_export(spark: SparkSession, folder: str) -> DataFrame:
    return E.intelligence_export(X.records(spark, folder), X.links(spark, folder), S.SearchParams(risk_level="high"))


_ALERT_ROW = f"""SELECT CAST(a.id AS STRING) AS id, {safe('a.title')} AS title, CAST(a.threat_intelligence_id AS STRING) AS threat_intelligence_id, a.triggering_rule AS triggering_rule,
        a.risk_level AS risk_level, a.status AS status, {safe('a.notes')} AS notes, r.title AS intelligence_title, r.cve_id AS cve_id,
        array_to_string(r.source_names, ' | ') AS source_names FROM alerts a LEFT JOIN records r ON r.id = a.threat_intelligence_id"""


@QUERIES.add("alert_report_rows", cte("records", "alerts") + _ALERT_ROW)
def alert_report_rows(spark: SparkSession, folder: str) -> DataFrame:
    return E.alert_rows(X.alerts(spark, folder), X.records(spark, folder)).drop("triggered_at")


_RISK = f"{rank('a.risk_level', K.RISK_LEVELS)} DESC, a.triggered_at DESC, a.id"
_ALERT_HEADERS = ", ".join(
    f'{name} AS "{header}"' for name, header in K.ALERT_CSV_HEADERS.items() if name != "triggered_at"
)


@QUERIES.add("alert_export", cte("records", "alerts") + f"SELECT {_ALERT_HEADERS} FROM ({_ALERT_ROW} ORDER BY {_RISK} LIMIT 100)")
def alert_export(spark: SparkSession, folder: str) -> DataFrame:
    exported = E.alert_export(X.alerts(spark, folder), X.records(spark, folder), "risk_level")
    return exported.drop(K.ALERT_CSV_HEADERS["triggered_at"])


def _report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of all reports; records and links lie by record id in parts that grow in number, not in rows."""
    parts = parts_for(spark, folder, "orders", "lineitem")
    links = X.links(spark, folder, parts).withColumn("raw_intelligence_id", F.lit(None).cast("string"))
    return E.report_lines(X.records(spark, folder, parts), links, X.alerts(spark, folder))


@QUERIES.add(
    "report_line_counts",
    cte("records", "links", "alerts")
    + """
    , s AS (SELECT threat_intelligence_id AS id, count(*) AS n FROM links GROUP BY 1), a AS (SELECT threat_intelligence_id AS id, count(*) AS n FROM alerts GROUP BY 1)
    SELECT r.id AS id, 17 + 3 + coalesce(s.n, len(r.source_names)) + coalesce(a.n, 1) AS n_lines FROM records r LEFT JOIN s ON s.id = r.id LEFT JOIN a ON a.id = r.id""",
)
def report_line_counts(spark: SparkSession, folder: str) -> DataFrame:
    lines = _report_lines(spark, folder)
    return lines.groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"))


@QUERIES.add(
    "report_alert_lines",
    cte("records", "alerts")
    + f"""
    SELECT a.threat_intelligence_id AS id, '- ' || coalesce({safe('a.title')}, CAST(a.id AS STRING)) || ': ' || a.risk_level || ' / ' || a.status AS line
    FROM alerts a JOIN records r ON r.id = a.threat_intelligence_id
    UNION ALL SELECT r.id, '- 暂无' FROM records r WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE a.threat_intelligence_id = r.id)""",
)
def report_alert_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = _report_lines(spark, folder)
    return lines.filter(F.col("section") == E.ALERT_SECTION).select("id", "line")


_TOP = "SELECT * FROM records ORDER BY risk_score DESC NULLS LAST, last_seen_at DESC, id LIMIT 20"


@QUERIES.add(
    "executive_summary",
    cte("records", "alerts")
    + f"""
    SELECT 'intelligence' AS metric, count(*) AS value FROM records UNION ALL SELECT 'high_risk_intelligence', count(*) FILTER (risk_level IN ('high', 'critical')) FROM records
    UNION ALL SELECT 'alerts', count(*) FROM alerts UNION ALL SELECT 'open_alerts', count(*) FILTER (status = 'open') FROM alerts""",
)
def executive_summary(spark: SparkSession, folder: str) -> DataFrame:
    return E.executive_summary(X.records(spark, folder), X.alerts(spark, folder))["counts"]


@QUERIES.add(
    "executive_top_records",
    cte("records") + f"SELECT id, cve_id, risk_level, title FROM ({_TOP.replace('20', '8')})",
)
def executive_top_records(spark: SparkSession, folder: str) -> DataFrame:
    return E.executive_summary(X.records(spark, folder), X.alerts(spark, folder))["intelligence"]
