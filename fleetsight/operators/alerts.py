"""Alert rules, two of them across records.

Rules are functions ``(candidates, context) -> alert rows``. Cross-record facts are computed
once for the whole context as grouped counts, never by comparing records with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.functions.dates import at_least_risk
from fleetsight.functions.nested import filled
from fleetsight.functions.text import alert_key, none_if_blank
from fleetsight.operators.running import trailing_count
from fleetsight.sources.envelope import string_map

DAY_MICROS = 86_400 * 1_000_000


@dataclass(frozen=True)
class Context:
    """Records and links the cross-record rules look at."""

    records: DataFrame
    links: DataFrame


Rule = Callable[[DataFrame, Context], DataFrame]


def scoring_json() -> Column:
    return F.coalesce(
        *[
            F.when(F.try_element_at("metadata", F.lit(key)).startswith("{"), F.try_element_at("metadata", F.lit(key)))
            for key in ("scoring", "score_metadata")
        ]
    )


def component_key() -> Column:
    return F.coalesce(none_if_blank(alert_key("vehicle_component")), alert_key("attack_surface"))


def _alert(rule: Column, kind: str, level: Column, extra: dict[str, Column] | None = None) -> list[Column]:
    fields = {
        "reason": F.lit(K.ALERT_REASONS[kind]),
        "intelligence_id": F.col("id"),
        "cve_id": F.col("cve_id"),
        "risk_score": F.col("risk_score").cast("double"),
        "risk_level": F.col("risk_level"),
        "severity": F.col("severity"),
        "vehicle_component": F.col("vehicle_component"),
        "attack_surface": F.col("attack_surface"),
        "scoring": F.coalesce(scoring_json(), F.lit("{}")),
        **(extra or {}),
    }
    return [
        F.col("id").alias("threat_intelligence_id"),
        rule.alias("triggering_rule"),
        F.lit(K.ALERT_TITLES[kind]).alias("title"),
        level.alias("risk_level"),
        string_map(fields).alias("metadata"),
    ]


def is_critical() -> Column:
    return (F.col("risk_level") == "critical") | (F.col("severity") == "critical")


def is_known_exploited() -> Column:
    tags = F.transform(filled("tags"), alert_key)
    names = F.transform(filled("source_names"), alert_key)
    catalogue = F.lit(False)
    for key in K.CATALOGUE_KEYS:
        catalogue = catalogue | F.coalesce(F.try_element_at("metadata", F.lit(key)) != "", F.lit(False))
    signal = F.get_json_object(scoring_json(), "$.signals.known_exploited") == "true"
    return (
        (F.col("exploit_status") == "exploited")
        | F.coalesce(signal, F.lit(False))
        | F.arrays_overlap(tags, F.array(*[F.lit(tag) for tag in K.KNOWN_EXPLOITED_TAGS]))
        | F.arrays_overlap(names, F.array(*[F.lit(name) for name in K.KNOWN_EXPLOITED_SOURCES]))
        | catalogue
    )


def is_vehicle_critical() -> Column:
    return F.col("risk_level").isin(*K.HIGH_RISK_LEVELS) & component_key().isin(*K.ALERT_CRITICAL_PARTS)


def critical_alert() -> Column:
    return F.when(is_critical(), F.struct(*_alert(F.lit("critical-intelligence"), "critical", F.lit("critical"))))


def known_exploited_alert() -> Column:
    level = at_least_risk("risk_level", "high")
    return F.when(is_known_exploited(), F.struct(*_alert(F.lit("known-exploited"), "exploited", level)))


def vehicle_critical_alert() -> Column:
    rule = F.concat(F.lit("vehicle-critical-"), component_key())
    return F.when(is_vehicle_critical(), F.struct(*_alert(rule, "vehicle", at_least_risk("risk_level", "high"))))


def record_rules(candidates: DataFrame, _context: Context) -> DataFrame:
    """The rules that look at one record only, in one pass over the candidates."""
    found = F.array(critical_alert(), known_exploited_alert(), vehicle_critical_alert())
    return candidates.select(F.inline(F.array_compact(found)))


def cve_source_counts(records: DataFrame, links: DataFrame) -> DataFrame:
    """Per CVE the larger of its distinct source names and distinct addresses.

    The first grouping holds the value, so a CVE with very many sightings is spread over all
    tasks; the second one only counts.
    """
    with_cve = records.filter(none_if_blank("cve_id").isNotNull()).select(
        "id", F.upper("cve_id").alias("cve"), "source_names", "source_urls"
    )

    def named(kind: str, values: str) -> Column:
        return F.transform(
            filled(values), lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        )

    own = with_cve.select(
        "cve", F.explode(F.concat(named("name", "source_names"), named("url", "source_urls"))).alias("entry")
    ).select("cve", "entry.kind", "entry.value")
    linked = (
        links.filter(none_if_blank("source_url").isNotNull())
        .select(F.col("threat_intelligence_id").alias("id"), F.col("source_url").alias("value"))
        .join(with_cve.select("id", "cve"), "id")
        .select("cve", F.lit("url").alias("kind"), "value")
    )
    return (
        own.unionByName(linked)
        .distinct()
        .groupBy("cve")
        .agg(F.count_if(F.col("kind") == "name").alias("names"), F.count_if(F.col("kind") == "url").alias("urls"))
        .select("cve", F.greatest("names", "urls").alias("source_count"))
    )


def multi_source_rule(candidates: DataFrame, context: Context) -> DataFrame:
    counts = cve_source_counts(context.records, context.links).filter(F.col("source_count") >= 2)
    matched = candidates.withColumn("cve", F.upper(none_if_blank("cve_id"))).join(counts, "cve")
    return matched.select(
        *_alert(
            F.concat(F.lit("multi-source-cve-"), "cve"),
            "multi_source",
            at_least_risk("risk_level", "medium"),
            {"source_count": F.col("source_count")},
        )
    )


def _scopes(records: DataFrame, *columns: str) -> DataFrame:
    """One row per record and burst scope with a value."""
    scopes = F.array(
        F.struct(F.lit("vendor").alias("scope"), alert_key("affected_vendor").alias("value")),
        F.struct(F.lit("component").alias("scope"), component_key().alias("value")),
    )
    return (
        records.filter(F.col("first_seen_at").isNotNull())
        .select(*columns, "first_seen_at", F.explode(scopes).alias("s"))
        .select(*columns, "first_seen_at", "s.scope", "s.value")
        .filter(F.col("value") != "")
    )


def burst_counts(candidates: DataFrame, records: DataFrame, days: int = K.BURST_DAYS) -> DataFrame:
    """High-risk records per (scope, value) in the trailing days of every candidate time."""
    high = F.coalesce(F.col("risk_level").isin(*K.HIGH_RISK_LEVELS), F.lit(False))
    flags = ("is_event", "is_probe")
    if candidates is records:
        rows = _scopes(records.withColumns({"is_event": high, "is_probe": F.lit(True)}), *flags)
    else:
        asked = _scopes(candidates.withColumns({"is_event": F.lit(False), "is_probe": F.lit(True)}), *flags)
        counted = records.filter(high).withColumns({"is_event": F.lit(True), "is_probe": F.lit(False)})
        rows = asked.unionByName(_scopes(counted, *flags))
    return trailing_count(rows, ["scope", "value"], "first_seen_at", days * DAY_MICROS, "match_count", *flags)


def bursts(candidates: DataFrame, records: DataFrame, days: int = K.BURST_DAYS, minimum: int = K.BURST_MIN_ITEMS) -> DataFrame:
    """Candidate ids in a burst with the scope that applies: vendor before component."""
    counts = burst_counts(candidates, records, days).filter(F.col("match_count") >= minimum)
    matched = _scopes(candidates, "id").join(counts, ["scope", "value", "first_seen_at"])
    vendor_first = F.when(F.col("scope") == "vendor", 0).otherwise(1)
    return (
        matched.groupBy("id")
        .agg(F.min_by(F.struct("scope", "value", "match_count", "first_seen_at"), vendor_first).alias("burst"))
        .select("id", "burst.*")
    )


def burst_rule(candidates: DataFrame, context: Context) -> DataFrame:
    """The records of a burst are described by scope, value and time range.

    Listing them in every alert would write all pairs of a busy vendor; :func:`burst_members`
    lists them for the alerts that are asked for.
    """
    found = bursts(candidates, context.records).withColumnsRenamed({"value": "burst_value", "first_seen_at": "burst_end"})
    start = F.timestamp_micros(F.unix_micros("burst_end") - K.BURST_DAYS * DAY_MICROS)
    return candidates.join(found, "id").select(
        *_alert(
            F.concat(F.lit("burst-"), "scope", F.lit("-"), "burst_value"),
            "burst",
            at_least_risk("risk_level", "high"),
            {
                "scope": F.col("scope"),
                "value": F.col("burst_value"),
                "lookback_days": F.lit(K.BURST_DAYS),
                "match_count": F.col("match_count"),
                "window_start": start,
                "window_end": F.col("burst_end"),
            },
        )
    )


def burst_members(alerts: DataFrame, records: DataFrame) -> DataFrame:
    """High-risk records, as rows, of every (scope, value) that the burst alerts passed in name.

    One row per record and scope, whatever the number of alerts: an alert's own members are those
    with a time in its ``window_start`` to ``window_end``.
    """
    named = alerts.filter(F.col("triggering_rule").startswith("burst-")).select(
        F.col("metadata")["scope"].alias("scope"), F.col("metadata")["value"].alias("value")
    )
    high = _scopes(records.filter(F.col("risk_level").isin(*K.HIGH_RISK_LEVELS)), "id")
    return high.join(named.distinct(), ["scope", "value"], "left_semi").select(
        "scope", "value", F.col("id").alias("matched_intelligence_id"), "first_seen_at"
    )


RULES: tuple[Rule, ...] = (record_rules, multi_source_rule, burst_rule)


def newest(records: DataFrame, limit: int) -> DataFrame:
    return records.orderBy(F.desc("last_seen_at"), "id").limit(limit)


def alert_candidates(
    records: DataFrame, links: DataFrame, context: DataFrame | None = None, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """All alerts the rules give for ``records``, whether raised before or not."""
    looked_at = Context(records if context is None else context, links)
    return reduce(DataFrame.unionByName, [rule(records, looked_at) for rule in rules])


def alert_id() -> Column:
    return F.sha2(F.concat_ws("|", F.lit("alert"), F.col("threat_intelligence_id").cast("string"), "triggering_rule"), 256)


def evaluate_alerts(
    records: DataFrame,
    links: DataFrame,
    existing: DataFrame,
    now: Column,
    ids: DataFrame | None = None,
    limit: int | None = None,
    context_limit: int | None = None,
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """New open alerts. Without limits the whole table is both candidate and context."""
    chosen = records
    if ids is not None:
        chosen = records.join(ids.select("id").distinct(), "id", "left_semi")
    elif limit is not None:
        chosen = newest(records, limit)
    context = records
    if context_limit is not None:
        context = newest(records, max(context_limit, limit or 0)).union(chosen).dropDuplicates(["id"])
    found = alert_candidates(chosen, links, context, rules)
    fresh = found.join(
        existing.select("threat_intelligence_id", "triggering_rule"),
        ["threat_intelligence_id", "triggering_rule"],
        "left_anti",
    )
    return fresh.select(
        alert_id().alias("id"),
        "threat_intelligence_id",
        "triggering_rule",
        "title",
        "risk_level",
        now.alias("triggered_at"),
        F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("notes"),
        "metadata",
    )
