"""Alert rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.operators import alerts as A
from fleetsight.plans import fixtures as X
from fleetsight.plans.queries import Queries
from fleetsight.plans.queries.sqltext import cte, in_list, level_at_least

QUERIES = Queries()

_HIGH = f"risk_level IN {in_list(K.HIGH_RISK_LEVELS)}"
_FACTS = (
    cte("records", "links")
    + f"""
    , keyed AS (SELECT *, coalesce(lower(replace(affected_vendor, '-', '_')), '') AS vendor_key,
        coalesce(vehicle_component, attack_surface, '') AS part_key FROM records),
    named AS (SELECT upper(cve_id) AS cve, unnest(source_names) AS value FROM keyed WHERE cve_id IS NOT NULL),
    addressed AS (
        SELECT upper(cve_id) AS cve, unnest(source_urls) AS value FROM keyed WHERE cve_id IS NOT NULL
        UNION ALL SELECT upper(k.cve_id), l.source_url FROM keyed k JOIN links l ON l.threat_intelligence_id = k.id WHERE k.cve_id IS NOT NULL),
    cve_counts AS (
        SELECT cve, max(n) AS source_count FROM (
            SELECT cve, count(DISTINCT value) AS n FROM named GROUP BY cve
            UNION ALL SELECT cve, count(DISTINCT value) FROM addressed GROUP BY cve) GROUP BY cve),
    windows AS (SELECT *,
        count(*) FILTER ({_HIGH}) OVER (PARTITION BY vendor_key ORDER BY first_seen_at RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS vendor_n,
        count(*) FILTER ({_HIGH}) OVER (PARTITION BY part_key ORDER BY first_seen_at RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS part_n
        FROM keyed),
    bursts AS (SELECT *, CASE WHEN vendor_key <> '' AND vendor_n >= 3 THEN 'vendor' WHEN part_key <> '' AND part_n >= 3 THEN 'component' END AS scope FROM windows)
    """
)
_FOUND = f"""
    , found AS (
        SELECT id AS threat_intelligence_id, 'critical-intelligence' AS triggering_rule, 'critical' AS risk_level FROM keyed
            WHERE risk_level = 'critical' OR severity = 'critical'
        UNION ALL SELECT id, 'known-exploited', {level_at_least('risk_level', 'high')} FROM keyed
            WHERE exploit_status = 'exploited' OR coalesce(replace(tag_2, '-', '_') IN {in_list(K.KNOWN_EXPLOITED_TAGS)}, FALSE) OR name_2 IS NOT NULL OR date_added IS NOT NULL
        UNION ALL SELECT id, 'vehicle-critical-' || part_key, {level_at_least('risk_level', 'high')} FROM keyed
            WHERE {_HIGH} AND part_key IN {in_list(K.ALERT_CRITICAL_PARTS)}
        UNION ALL SELECT k.id, 'multi-source-cve-' || c.cve, {level_at_least('k.risk_level', 'medium')} FROM keyed k JOIN cve_counts c ON upper(k.cve_id) = c.cve
            WHERE c.source_count >= 2
        UNION ALL SELECT id, 'burst-' || scope || '-' || CASE scope WHEN 'vendor' THEN vendor_key ELSE part_key END, {level_at_least('risk_level', 'high')} FROM bursts
            WHERE scope IS NOT NULL)
    """
_COLUMNS = "threat_intelligence_id, triggering_rule, risk_level"


@QUERIES.add("alerts_all_rules", _FACTS + _FOUND + f"SELECT {_COLUMNS} FROM found")
def alerts_all_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = A.alert_candidates(X.records(spark, folder), X.links(spark, folder))
    return found.select("threat_intelligence_id", "triggering_rule", "risk_level")


@QUERIES.add(
    "alerts_new_only",
    _FACTS.replace("WITH ", cte("alerts").rstrip() + ", ", 1)
    + _FOUND
    + f"SELECT {_COLUMNS}, 'open' AS status FROM found f WHERE NOT EXISTS (SELECT 1 FROM alerts a "
    "WHERE a.threat_intelligence_id = f.threat_intelligence_id AND a.triggering_rule = f.triggering_rule)",
)
def alerts_new_only(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit("2024-02-01").cast("timestamp")
    fresh = A.evaluate_alerts(X.records(spark, folder), X.links(spark, folder), X.alerts(spark, folder), now)
    return fresh.select("threat_intelligence_id", "triggering_rule", "risk_level", "status")


@QUERIES.add(
    "alerts_for_chosen_ids",
    _FACTS + _FOUND + f"SELECT {_COLUMNS} FROM found WHERE threat_intelligence_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def alerts_for_chosen_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Targeted evaluation: chosen candidates, whole table as context."""
    records = X.records(spark, folder)
    none = X.alerts(spark, folder).filter(F.lit(False))
    ids = records.filter(F.col("severity") == "critical").select("id")
    now = F.lit("2024-02-01").cast("timestamp")
    return A.evaluate_alerts(records, X.links(spark, folder), none, now, ids=ids).select(
        "threat_intelligence_id", "triggering_rule", "risk_level"
    )


@QUERIES.add(
    "alert_payloads",
    _FACTS
    + f"""
    SELECT id AS threat_intelligence_id, 'high-risk vehicle critical component' AS reason, cve_id, CAST(risk_score AS DOUBLE) AS risk_score, risk_level, severity,
        vehicle_component, attack_surface FROM keyed WHERE {_HIGH} AND part_key IN {in_list(K.ALERT_CRITICAL_PARTS)}""",
)
def alert_payloads(spark: SparkSession, folder: str) -> DataFrame:
    records = X.records(spark, folder)
    found = records.select(F.inline(F.array_compact(F.array(A.vehicle_critical_alert()))))
    shown = ("reason", "cve_id", "risk_level", "severity", "vehicle_component", "attack_surface")
    return found.select(
        "threat_intelligence_id",
        F.col("metadata")["risk_score"].cast("double").alias("risk_score"),
        *[F.col("metadata")[name].alias(name) for name in shown],
    )


@QUERIES.add("cve_source_count", _FACTS + "SELECT cve, source_count FROM cve_counts")
def cve_source_count(spark: SparkSession, folder: str) -> DataFrame:
    return A.cve_source_counts(X.records(spark, folder), X.links(spark, folder))


@QUERIES.add(
    "burst_7d",
    _FACTS
    + """
    SELECT DISTINCT 'vendor' AS scope, vendor_key AS value, epoch_us(first_seen_at) AS at, vendor_n AS match_count FROM windows WHERE vendor_key <> ''
    UNION ALL SELECT DISTINCT 'component', part_key, epoch_us(first_seen_at), part_n FROM windows WHERE part_key <> ''""",
)
def burst_7d(spark: SparkSession, folder: str) -> DataFrame:
    records = X.records(spark, folder)
    return A.burst_counts(records, records).select("scope", "value", F.unix_micros("first_seen_at").alias("at"), "match_count")


@QUERIES.add(
    "burst_alerts",
    _FACTS
    + "SELECT id, scope, CASE scope WHEN 'vendor' THEN vendor_key ELSE part_key END AS value, "
    "CASE scope WHEN 'vendor' THEN vendor_n ELSE part_n END AS match_count FROM bursts WHERE scope IS NOT NULL",
)
def burst_alerts(spark: SparkSession, folder: str) -> DataFrame:
    records = X.records(spark, folder)
    return A.bursts(records, records).select("id", "scope", "value", "match_count")


def _members_sql(condition: str) -> str:
    named = "SELECT CASE scope WHEN 'vendor' THEN vendor_key ELSE part_key END FROM bursts WHERE scope = "
    return _FACTS + " UNION ALL ".join(
        f"SELECT '{scope}' AS scope, {key} AS value, id AS matched_intelligence_id, epoch_us(first_seen_at) AS at FROM keyed "
        f"WHERE {_HIGH} AND {key} IN ({named}'{scope}'{condition})"
        for scope, key in (("vendor", "vendor_key"), ("component", "part_key"))
    )


def _members(spark: SparkSession, folder: str, chosen: DataFrame, records: DataFrame) -> DataFrame:
    found = A.burst_rule(chosen, A.Context(records, X.links(spark, folder)))
    return A.burst_members(found, records).withColumn("at", F.unix_micros("first_seen_at")).drop("first_seen_at")


@QUERIES.add("burst_members", _members_sql(""))
def burst_members(spark: SparkSession, folder: str) -> DataFrame:
    records = X.records(spark, folder)
    return _members(spark, folder, records, records)


@QUERIES.add("burst_members_of_open_reviews", _members_sql(" AND status = 'under_review'"))
def burst_members_of_open_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the bursts on records that are under review."""
    records = X.records(spark, folder)
    return _members(spark, folder, records.filter(F.col("status") == "under_review"), records)
