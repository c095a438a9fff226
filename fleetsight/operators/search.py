"""Search, ordering, paging and detail over records, alerts, sources and jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.functions.dates import rank_of
from fleetsight.functions.nested import score_explanation, score_metadata
from fleetsight.functions.redact import safe_metadata, safe_text
from fleetsight.functions.text import contains_ignoring_case, none_if_blank
from fleetsight.functions.urls import safe_url

MAX_PAGE = 100


@dataclass(frozen=True)
class SearchParams:
    q: str | None = None
    cve: str | None = None
    vendor: str | None = None
    product: str | None = None
    vehicle_component: str | None = None
    attack_surface: str | None = None
    risk_level: str | None = None
    tag: str | None = None
    source: str | None = None
    status: str | None = None
    intelligence_type: str | None = None
    sort: str = "recent"


def _clean(value: str | None) -> str | None:
    return (value or "").strip() or None


def _joined(values: str) -> Column:
    return F.array_join(values, " ")


def tokens(text: Column) -> Column:
    """Lower-case words, for token search."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda word: word != "")


def matches_tokens(document_tokens: Column | str, query: str) -> Column:
    """All words of the query occur in a token array."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    document = F.col(document_tokens) if isinstance(document_tokens, str) else document_tokens
    return F.coalesce((F.size(wanted) > 0) & (F.size(F.array_except(wanted, document)) == 0), F.lit(False))


TEXT_COLUMNS = ("title", "summary", "cve_id", "cwe_id", "affected_vendor", "affected_product")


def matches_text(query: str, search_vector: str | None = None) -> Column:
    hit = contains_ignoring_case(_joined("tags"), query)
    for name in TEXT_COLUMNS:
        hit = hit | contains_ignoring_case(name, query)
    return hit if search_vector is None else hit | matches_tokens(search_vector, query)


def record_filter(params: SearchParams) -> Column:
    """Everything of a search that one record can answer on its own, apart from the source."""
    conditions = [F.lit(True)]
    if q := _clean(params.q):
        conditions.append(matches_text(q))
    if cve := _clean(params.cve):
        conditions.append(F.lower("cve_id") == cve.lower())
    if vendor := _clean(params.vendor):
        conditions.append(contains_ignoring_case("affected_vendor", vendor))
    if product := _clean(params.product):
        conditions.append(contains_ignoring_case("affected_product", product))
    if tag := _clean(params.tag):
        conditions.append(contains_ignoring_case(_joined("tags"), tag))
    for name in ("vehicle_component", "attack_surface", "risk_level", "status", "intelligence_type"):
        if value := _clean(getattr(params, name)):
            conditions.append(F.col(name) == value)
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


def linked_ids(links: DataFrame, source: str) -> DataFrame:
    """Ids of records with a link that matches the source text; distinct before any join."""
    hit = F.lit(False)
    for name in ("source_name", "source_url", "external_id"):
        hit = hit | contains_ignoring_case(name, source)
    return links.filter(hit).select(F.col("threat_intelligence_id").alias("id")).distinct()


def filter_by_source(records: DataFrame, links: DataFrame, source: str) -> DataFrame:
    """Match in the record's own source fields, or in one of its links."""
    own = contains_ignoring_case(_joined("source_names"), source)
    own = own | contains_ignoring_case(_joined("source_urls"), source)
    own = own | contains_ignoring_case("canonical_source_url", source)
    marked = linked_ids(links, source).withColumn("linked", F.lit(True))
    return records.join(marked, "id", "left").filter(own | F.col("linked").isNotNull()).drop("linked")


def severity_rank() -> Column:
    return rank_of("severity", K.SEVERITIES)


RECORD_ORDERS = {
    "recent": lambda: [F.desc("last_seen_at"), F.asc("id")],
    "first_seen": lambda: [F.desc("first_seen_at"), F.asc("id")],
    "risk_score": lambda: [F.desc_nulls_last("risk_score"), F.desc("last_seen_at"), F.asc("id")],
    "severity": lambda: [
        severity_rank().desc(), F.desc_nulls_last("risk_score"), F.desc("last_seen_at"), F.asc("id"),
    ],
}
ALERT_ORDERS = {
    "recent": lambda: [F.desc("triggered_at"), F.asc("id")],
    "risk_level": lambda: [rank_of("risk_level", K.RISK_LEVELS).desc(), F.desc("triggered_at"), F.asc("id")],
}
SOURCE_ORDERS = {
    "name": lambda: [F.asc("name"), F.asc("id")],
    "recent": lambda: [F.desc("updated_at"), F.asc("name"), F.asc("id")],
    "failures": lambda: [F.desc_nulls_last("last_error_at"), F.desc("updated_at"), F.asc("name"), F.asc("id")],
}
JOB_ORDERS = {
    "recent": lambda: [F.desc_nulls_last("finished_at"), F.desc_nulls_last("started_at"), F.asc("id")],
    "started": lambda: [F.desc_nulls_last("started_at"), F.asc("id")],
}


def search(records: DataFrame, links: DataFrame, params: SearchParams) -> DataFrame:
    """Matching records, not yet ordered: the total is a count of this."""
    found = records.filter(record_filter(params))
    if source := _clean(params.source):
        found = filter_by_source(found, links, source)
    return found


def page(found: DataFrame, order: list[Column], number: int = 1, limit: int = 25, maximum: int = MAX_PAGE) -> DataFrame:
    """One page; Spark keeps the top rows per task and merges those, so nothing is fully sorted."""
    if number < 1 or not 1 <= limit <= maximum:
        raise ValueError(f"page starts at 1 and limit is between 1 and {maximum}")
    return found.orderBy(*order).offset((number - 1) * limit).limit(limit)


def page_info(found: DataFrame, number: int = 1, limit: int = 25) -> DataFrame:
    """Total and whether there is a next page."""
    return found.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(number).alias("page"), F.lit(limit).alias("limit"), "total", (F.col("total") > number * limit).alias("has_next")
    )


def search_page(records: DataFrame, links: DataFrame, params: SearchParams, number: int = 1, limit: int = 25) -> DataFrame:
    return page(search(records, links, params), RECORD_ORDERS[params.sort](), number, limit)


def filter_alerts(
    alerts: DataFrame, risk_level: str | None = None, status: str | None = None, rule: str | None = None, intelligence_id=None
) -> DataFrame:
    if risk_level:
        alerts = alerts.filter(F.col("risk_level") == risk_level)
    if status:
        alerts = alerts.filter(F.col("status") == status)
    if rule := _clean(rule):
        alerts = alerts.filter(contains_ignoring_case("triggering_rule", rule))
    if intelligence_id is not None:
        alerts = alerts.filter(F.col("threat_intelligence_id") == intelligence_id)
    return alerts


def filter_sources(sources: DataFrame, status: str | None = None, source_type: str | None = None, q: str | None = None) -> DataFrame:
    if status:
        sources = sources.filter(F.col("status") == status)
    if source_type:
        sources = sources.filter(F.col("source_type") == source_type)
    if q := _clean(q):
        sources = sources.filter(contains_ignoring_case("name", q))
    return sources


def is_manual() -> Column:
    origin = F.try_element_at("metadata", F.lit("entry_origin"))
    return F.coalesce(origin == "manual", F.lit(False)) | F.array_contains("tags", "manual")


def manual_entries(records: DataFrame) -> DataFrame:
    """Records with the tag; the order is newest first."""
    return records.filter(F.array_contains("tags", "manual") & is_manual())


MANUAL_ORDER = (lambda: [F.desc("last_seen_at"), F.desc("created_at"), F.asc("id")])


def public_sources(sources: DataFrame) -> DataFrame:
    """What a reader without an account may see of a source."""
    return sources.select(
        "id", "name", "source_type", "status", (F.col("status") == "enabled").alias("enabled"), safe_url("base_url").alias("base_url")
    )


def detail_sources(records: DataFrame, links: DataFrame) -> DataFrame:
    """One row per source of a record: its links, or name/address pairs when it has none."""
    mine = links.withColumn("record_id", F.col("threat_intelligence_id")).join(
        records.select(F.col("id").alias("record_id")), "record_id", "left_semi"
    )
    linked = mine.select(
        F.col("record_id").alias("id"),
        F.lit(True).alias("from_link"),
        "source_id",
        "raw_intelligence_id",
        "source_name",
        F.coalesce(safe_url("source_url"), F.lit("")).alias("source_url"),
        safe_text("external_id").alias("external_id"),
        "first_seen_at",
        "last_seen_at",
    )
    unlinked = records.join(links.select(F.col("threat_intelligence_id").alias("id")).distinct(), "id", "left_anti")
    paired = unlinked.select("*", F.posexplode("source_names").alias("position", "name"))
    address = F.coalesce(F.get("source_urls", F.col("position")), F.col("canonical_source_url"))
    fallback = paired.withColumn("address", address).filter(none_if_blank("address").isNotNull()).select(
        "id",
        F.lit(False).alias("from_link"),
        F.lit(None).alias("source_id"),
        "raw_intelligence_id",
        F.col("name").alias("source_name"),
        F.coalesce(safe_url("address"), F.lit("")).alias("source_url"),
        F.lit(None).cast("string").alias("external_id"),
        "first_seen_at",
        "last_seen_at",
    )
    return linked.unionByName(fallback)


def detail_alerts(records: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per alert of a record. Readers order it by time, newest first."""
    return alerts.select(
        F.col("threat_intelligence_id").alias("id"),
        F.col("id").alias("alert_id"),
        "title",
        "risk_level",
        "status",
        "triggered_at",
    ).join(records.select("id"), "id", "left_semi")


def detail_header(records: DataFrame, alerts: DataFrame) -> DataFrame:
    """Record facts as shown: redacted addresses and metadata, score lookups, number of alerts."""
    counts = alerts.groupBy(F.col("threat_intelligence_id").alias("id")).agg(F.count(F.lit(1)).alias("related_alert_count"))
    shown = records.withColumns(
        {
            "score_metadata": score_metadata("metadata"),
            "score_explanation": score_explanation("metadata"),
            "metadata": safe_metadata("metadata"),
            "source_urls": F.filter(F.transform("source_urls", safe_url), lambda url: none_if_blank(url).isNotNull()),
            "canonical_source_url": safe_url("canonical_source_url"),
        }
    )
    return shown.join(counts, "id", "left").withColumn("related_alert_count", F.coalesce("related_alert_count", F.lit(0)))


def alert_details(alerts: DataFrame, records: DataFrame) -> DataFrame:
    """Alerts beside a summary of their record; an alert without a record stays."""
    summary = records.select(
        F.col("id").alias("threat_intelligence_id"),
        F.col("title").alias("intelligence_title"),
        "intelligence_type",
        "cve_id",
        "severity",
        "affected_vendor",
        "affected_product",
        F.col("risk_score").alias("intelligence_risk_score"),
        F.col("risk_level").alias("intelligence_risk_level"),
        "source_names",
    )
    return alerts.withColumn("notes", safe_text("notes")).join(summary, "threat_intelligence_id", "left")
