"""Search, paging and detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.operators import search as S
from fleetsight.plans import fixtures as X
from fleetsight.plans.queries import Queries
from fleetsight.plans.queries.sqltext import cte, rank, sensitive

QUERIES = Queries()

_TEXT = "lower(concat_ws(chr(1), title, summary, cve_id, cwe_id, affected_vendor, affected_product, array_to_string(tags, ' ')))"


def _add_search(name: str, where: str, **params) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return S.search(X.records(spark, folder), X.links(spark, folder), S.SearchParams(**params)).select("id")

    QUERIES.add(name, cte("records", "links") + f"SELECT id FROM records WHERE {where}")(run)


_add_search("search_text", f"contains({_TEXT}, 'auth bypass')", q="Auth Bypass")
_add_search("search_text_in_tags", f"contains({_TEXT}, 'cisa-kev')", q="cisa-kev")
_add_search("search_cve", "lower(cve_id) = 'cve-2024-10042'", cve="cve-2024-10042")
_add_search("search_vendor_product", "contains(lower(affected_vendor), 'vendor-1') AND contains(lower(affected_product), 't 1')", vendor="VENDOR-1", product="T 1")
_add_search("search_wildcards_are_literal", "contains(lower(affected_product), '%_1')", product="%_1")
_add_search("search_tag", "contains(lower(array_to_string(tags, ' ')), '3 kev')", tag="3 KEV")
_add_search(
    "search_enums",
    "vehicle_component = 'tbox' AND risk_level = 'high' AND status = 'active' AND intelligence_type = 'exposure'",
    vehicle_component="tbox", risk_level="high", status="active", intelligence_type="exposure",
)
_add_search("search_surface", "attack_surface = 'usb'", attack_surface="usb")
_add_search(
    "search_source_exists",
    "contains(lower(array_to_string(source_names, ' ')), 'ource 7') OR contains(lower(array_to_string(source_urls, ' ')), 'ource 7') "
    "OR contains(lower(canonical_source_url), 'ource 7') OR EXISTS (SELECT 1 FROM links l WHERE l.threat_intelligence_id = records.id AND "
    "(contains(lower(l.source_name), 'ource 7') OR contains(lower(l.source_url), 'ource 7') OR contains(lower(l.external_id), 'ource 7')))",
    source="ource 7",
)


@QUERIES.add(
    "search_tokens",
    r"""SELECT doc_id FROM documents WHERE list_contains(list_filter(regexp_split_to_array(lower(text), '[^\pL\pN\pM_\p{Pc}]+'), lambda x: x <> ''), 'the')
        AND list_contains(list_filter(regexp_split_to_array(lower(text), '[^\pL\pN\pM_\p{Pc}]+'), lambda x: x <> ''), 'is')""",
)
def search_tokens(spark: SparkSession, folder: str) -> DataFrame:
    from fleetsight.sources.tables import load

    documents = load(spark, folder, "documents").withColumn("words", S.tokens(F.col("text")))
    return documents.filter(S.matches_tokens("words", "The IS")).select("doc_id")


_ORDERS = {
    "recent": "last_seen_at DESC, id",
    "first_seen": "first_seen_at DESC, id",
    "risk_score": "risk_score DESC NULLS LAST, last_seen_at DESC, id",
    "severity": f"{rank('severity', K.SEVERITIES)} DESC, risk_score DESC NULLS LAST, last_seen_at DESC, id",
}


def _add_page(sort: str, order: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        params = S.SearchParams(status="resolved", sort=sort)
        return S.search_page(X.records(spark, folder), X.links(spark, folder), params, 3, 40).select("id", "risk_score")

    sql = cte("records") + f"SELECT id, risk_score FROM records WHERE status = 'resolved' ORDER BY {order} LIMIT 40 OFFSET 80"
    QUERIES.add(f"page_by_{sort}", sql)(run)


for _sort, _order in _ORDERS.items():
    _add_page(_sort, _order)


@QUERIES.add(
    "page_info",
    cte("records")
    + "SELECT 3 AS page, 40 AS \"limit\", count(*) AS total, count(*) > 120 AS has_next FROM records WHERE status = 'resolved'",
)
def page_info(spark: SparkSession, folder: str) -> DataFrame:
    found = S.search(X.records(spark, folder), X.links(spark, folder), S.SearchParams(status="resolved"))
    return S.page_info(found, 3, 40)


@QUERIES.add(
    "filter_alerts",
    cte("alerts")
    + "SELECT id FROM alerts WHERE risk_level = 'high' AND status = 'open' AND contains(triggering_rule, 'burst-')",
)
def filter_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return S.filter_alerts(X.alerts(spark, folder), "high", "open", "BURST-").select("id")


@QUERIES.add(
    "alerts_of_record",
    cte("alerts") + "SELECT id, triggering_rule FROM alerts WHERE threat_intelligence_id = 77",
)
def alerts_of_record(spark: SparkSession, folder: str) -> DataFrame:
    return S.filter_alerts(X.alerts(spark, folder), intelligence_id=77).select("id", "triggering_rule")


def _add_alert_page(sort: str, order: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return S.page(X.alerts(spark, folder), S.ALERT_ORDERS[sort](), 2, 50).select("id", "risk_level")

    sql = cte("alerts") + f"SELECT id, risk_level FROM alerts ORDER BY {order} LIMIT 50 OFFSET 50"
    QUERIES.add(f"alerts_by_{sort}", sql)(run)


_add_alert_page("recent", "triggered_at DESC, id")
_add_alert_page("risk_level", f"{rank('risk_level', K.RISK_LEVELS)} DESC, triggered_at DESC, id")


@QUERIES.add(
    "filter_sources",
    cte("sources") + "SELECT id FROM sources WHERE status = 'enabled' AND source_type = 'rss' AND contains(lower(name), 'supplier#')",
)
def filter_sources(spark: SparkSession, folder: str) -> DataFrame:
    return S.filter_sources(X.sources(spark, folder), "enabled", "rss", "Supplier#").select("id")


@QUERIES.add(
    "public_sources",
    cte("sources")
    + "SELECT id, name, source_type, status, status = 'enabled' AS enabled, 'https://feed' || id || '.example.test/list?page=2' AS base_url FROM sources",
)
def public_sources(spark: SparkSession, folder: str) -> DataFrame:
    return S.public_sources(X.sources(spark, folder))


@QUERIES.add(
    "manual_entries",
    cte("records") + "SELECT id FROM records WHERE list_contains(tags, 'manual') ORDER BY last_seen_at DESC, created_at DESC, id LIMIT 50",
)
def manual_entries(spark: SparkSession, folder: str) -> DataFrame:
    return S.page(S.manual_entries(X.records(spark, folder)), S.MANUAL_ORDER(), 1, 50).select("id")


_CLEAN_URL = "regexp_replace({}, '&token=x$', '')"


@QUERIES.add(
    "detail_sources",
    cte("records", "links")
    + f"""
    , wanted AS (SELECT * FROM records WHERE severity = 'critical'), unlinked AS (SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.threat_intelligence_id = w.id))
    SELECT l.threat_intelligence_id AS id, TRUE AS from_link, l.source_name AS source_name, l.source_url AS source_url, l.external_id AS external_id
    FROM links l JOIN wanted w ON w.id = l.threat_intelligence_id
    UNION ALL SELECT id, FALSE, name_1, {_CLEAN_URL.format('url_1')}, NULL FROM unlinked
    UNION ALL SELECT id, FALSE, name_2, {_CLEAN_URL.format('coalesce(url_2, url_1)')}, NULL FROM unlinked WHERE name_2 IS NOT NULL""",
)
def detail_sources(spark: SparkSession, folder: str) -> DataFrame:
    wanted = X.records(spark, folder).filter(F.col("severity") == "critical")
    links = X.links(spark, folder).withColumn("raw_intelligence_id", F.lit(None).cast("string"))
    return S.detail_sources(wanted, links).select("id", "from_link", "source_name", "source_url", "external_id")


@QUERIES.add(
    "detail_alerts",
    cte("records", "alerts")
    + "SELECT r.id AS id, a.id AS alert_id, a.title AS title, a.status AS status FROM records r JOIN alerts a ON a.threat_intelligence_id = r.id WHERE r.severity = 'critical'",
)
def detail_alerts(spark: SparkSession, folder: str) -> DataFrame:
    wanted = X.records(spark, folder).filter(F.col("severity") == "critical")
    return S.detail_alerts(wanted, X.alerts(spark, folder)).select("id", "alert_id", "title", "status")


@QUERIES.add(
    "detail_header",
    cte("records", "alerts")
    + f"""
    , n AS (SELECT threat_intelligence_id AS id, count(*) AS n FROM alerts GROUP BY 1)
    SELECT r.id AS id, {_CLEAN_URL.format('url_1')} AS canonical_source_url, array_to_string(list_filter([{_CLEAN_URL.format('url_1')}, url_2], lambda x: x IS NOT NULL), ' ') AS urls,
        date_added, coalesce(n.n, 0) AS related_alert_count FROM records r LEFT JOIN n ON n.id = r.id""",
)
def detail_header(spark: SparkSession, folder: str) -> DataFrame:
    shown = S.detail_header(X.records(spark, folder), X.alerts(spark, folder))
    return shown.select(
        "id",
        "canonical_source_url",
        F.array_join("source_urls", " ").alias("urls"),
        F.col("metadata")["date_added"].alias("date_added"),
        "related_alert_count",
    )


@QUERIES.add(
    "alert_details",
    cte("records", "alerts")
    + f"""
    SELECT a.id AS id, a.triggering_rule AS triggering_rule, CASE WHEN {sensitive('a.notes')} THEN NULL ELSE a.notes END AS notes, r.title AS intelligence_title,
        r.cve_id AS cve_id, r.severity AS severity FROM alerts a LEFT JOIN records r ON r.id = a.threat_intelligence_id""",
)
def alert_details(spark: SparkSession, folder: str) -> DataFrame:
    details = S.alert_details(X.alerts(spark, folder), X.records(spark, folder))
    return details.select("id", "triggering_rule", "notes", "intelligence_title", "cve_id", "severity")
