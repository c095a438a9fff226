"""Risk scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.operators import score as S
from fleetsight.plans import fixtures as X
from fleetsight.plans.queries import Queries
from fleetsight.plans.queries.sqltext import any_term, cte, in_list, normalized, quoted

QUERIES = Queries()


def _points(column: str, table, default: float) -> str:
    whens = " ".join(f"WHEN {quoted(key)} THEN {value}" for key, value in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


SIGNALS_SQL = (
    cte("records")
    + f"""
    , texts AS (SELECT *, {normalized("concat_ws(' ', title, summary, array_to_string(source_names, ' '), array_to_string(source_urls, ' '), affected_vendor, affected_product, vehicle_component, attack_surface, exploit_status, array_to_string(tags, ' '), date_added, origin)")} AS t,
        regexp_extract(upper(cvss_vector), '(?:^|/)AV:([A-Z])(?:/|$)', 1) AS av, regexp_extract(upper(cvss_vector), '(?:^|/)PR:([A-Z])(?:/|$)', 1) AS pr
        FROM records),
    signals AS (SELECT *,
        CASE WHEN cvss_score IS NOT NULL THEN round(least(greatest(cvss_score, 0), 10) * 7, 2) ELSE {_points('severity', K.SEVERITY_POINTS, 10.0)} END AS base,
        CASE WHEN exploit_status = 'exploited' OR coalesce(tag_2 IN {in_list(K.KNOWN_EXPLOITED_TAGS)}, FALSE) OR name_2 IS NOT NULL OR date_added IS NOT NULL THEN 25.0
             WHEN exploit_status = 'proof_of_concept' THEN 12.0 ELSE 0.0 END AS exploit,
        CASE WHEN {any_term('t', K.POC_TERMS)} OR coalesce(tag_2 = 'poc', FALSE) THEN 10.0 ELSE 0.0 END AS poc,
        CASE WHEN av = 'N' THEN 10.0 WHEN attack_surface IN {in_list(K.REMOTE_PARTS)} OR vehicle_component IN {in_list(K.REMOTE_PARTS)} THEN 10.0
             WHEN av = 'A' THEN 7.0 WHEN {any_term('t', K.REMOTE_TERMS)} THEN 8.0 ELSE 0.0 END AS remote,
        CASE WHEN pr = 'N' THEN 8.0 WHEN {any_term('t', K.UNAUTHENTICATED_TERMS)} THEN 8.0 WHEN pr = 'L' THEN 3.0 WHEN pr = 'H' THEN -4.0
             WHEN {any_term('t', K.AUTHENTICATED_TERMS)} THEN -4.0 ELSE 0.0 END AS authentication,
        {_points('coalesce(vehicle_component, attack_surface)', K.PART_WEIGHTS, 0.0)} AS part,
        CASE WHEN {any_term('t', K.MULTI_VENDOR_TERMS + K.COMMON_COMPONENT_TERMS)} THEN 8.0 ELSE 0.0 END AS shared,
        {_points('confidence', K.CONFIDENCE_POINTS, 0.0)} AS trust
        FROM texts),
    scores AS (SELECT *, round(least(greatest(base + exploit + poc + remote + authentication + part + shared + trust, 0), 100), 2) AS new_score FROM signals),
    levels AS (SELECT *, CASE WHEN new_score >= 90 THEN 'critical' WHEN new_score >= 70 THEN 'high' WHEN new_score >= 40 THEN 'medium' ELSE 'low' END AS new_level FROM scores)
    """
)


@QUERIES.add(
    "risk_score",
    SIGNALS_SQL
    + "SELECT id, base, exploit, poc, remote, authentication, part, shared, trust, new_score AS risk_score, new_level AS risk_level FROM levels",
)
def risk_score(spark: SparkSession, folder: str) -> DataFrame:
    parts = S.score_parts(X.records(spark, folder))

    def points(signal: str):
        return F.coalesce(F.col(f"{signal}_signal.contribution"), F.lit(0.0))

    return parts.select(
        "id",
        points("base").alias("base"),
        points("exploit").alias("exploit"),
        points("poc").alias("poc"),
        points("remote").alias("remote"),
        points("authentication").alias("authentication"),
        points("part").alias("part"),
        points("shared").alias("shared"),
        points("confidence").alias("trust"),
        F.col("new_score").alias("risk_score"),
        F.col("new_level").alias("risk_level"),
    )


@QUERIES.add(
    "score_explanation",
    SIGNALS_SQL
    + """
    SELECT id, exploit = 25.0 AS known_exploited, poc > 0 AS public_poc, remote > 0 AS remote_exploitability,
        CASE WHEN pr = 'N' OR authentication = 8.0 THEN 'none_required' WHEN pr = 'L' THEN 'low_privilege_required'
             WHEN pr = 'H' THEN 'high_privilege_required' WHEN authentication = -4.0 THEN 'authentication_required' ELSE 'unknown' END AS authentication,
        coalesce(vehicle_component, attack_surface) AS vehicle_component, shared > 0 AS multi_vendor_or_common_component, confidence AS source_confidence,
        2 + CAST(exploit > 0 AS INTEGER) + CAST(poc > 0 AS INTEGER) + CAST(remote > 0 AS INTEGER) + CAST(authentication <> 0 AS INTEGER)
          + CAST(part > 0 AS INTEGER) + CAST(shared > 0 AS INTEGER) AS n_factors
    FROM levels""",
)
def score_explanation(spark: SparkSession, folder: str) -> DataFrame:
    scored = S.score(X.records(spark, folder))
    return scored.select("id", "scoring.signals.*", F.size("scoring.factors").alias("n_factors"))


@QUERIES.add(
    "score_level_counts",
    SIGNALS_SQL + "SELECT new_level AS risk_level, count(*) AS n, round(sum(new_score), 2) AS total FROM levels GROUP BY new_level",
)
def score_level_counts(spark: SparkSession, folder: str) -> DataFrame:
    scored = S.score(X.records(spark, folder))
    return scored.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("risk_score"), 2).alias("total"))


@QUERIES.add(
    "scoring_candidates",
    cte("records") + "SELECT id FROM records WHERE processing_status = 'normalized' AND (risk_score IS NULL OR risk_level = 'info')",
)
def scoring_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return S.candidates(X.records(spark, folder)).select("id")


@QUERIES.add(
    "scoring_priority_100",
    cte("records")
    + """
    SELECT id FROM records ORDER BY CASE WHEN risk_score IS NULL THEN 0 WHEN risk_level = 'info' THEN 1 ELSE 2 END,
        updated_at, created_at, id LIMIT 100""",
)
def scoring_priority(spark: SparkSession, folder: str) -> DataFrame:
    return S.scoring_priority(X.records(spark, folder), 100).select("id")


@QUERIES.add(
    "score_table_actions",
    SIGNALS_SQL
    + """
    SELECT id, CASE WHEN processing_status = 'normalized' AND (risk_score IS NULL OR risk_level = 'info') THEN 'scored' ELSE 'skipped' END AS score_action,
        CASE WHEN processing_status = 'normalized' AND (risk_score IS NULL OR risk_level = 'info') THEN new_score ELSE risk_score END AS risk_score,
        CASE WHEN processing_status = 'normalized' AND (risk_score IS NULL OR risk_level = 'info') THEN new_level ELSE risk_level END AS risk_level
    FROM levels""",
)
def score_table_actions(spark: SparkSession, folder: str) -> DataFrame:
    return S.score_table(X.records(spark, folder)).select("id", "score_action", "risk_score", "risk_level")


@QUERIES.add(
    "rescore_unchanged",
    cte("records") + "SELECT CASE WHEN processing_status = 'normalized' THEN 'unchanged' ELSE 'skipped' END AS score_action, count(*) AS n FROM records GROUP BY 1",
)
def rescore_unchanged(spark: SparkSession, folder: str) -> DataFrame:
    """Scoring everything twice: the second run finds nothing to change."""
    once = S.score_table(X.records(spark, folder), force=True).drop("score_action")
    return S.score_table(once, force=True).groupBy("score_action").agg(F.count(F.lit(1)).alias("n"))
