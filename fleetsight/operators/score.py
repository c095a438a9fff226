"""Risk score 0..100 with a level and an explanation; every factor is a column expression."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.functions import text as T
from fleetsight.functions.dates import bounded_score, risk_level_for_score
from fleetsight.functions.keys import canonical_json, escape_non_ascii, sha256
from fleetsight.functions.nested import filled


@dataclass(frozen=True)
class ScoringConfig:
    """The rule tables; replace a field to try other weights."""

    rule_version: str = K.RULE_VERSION
    severity_points: Mapping[str, float] = field(default_factory=lambda: dict(K.SEVERITY_POINTS))
    confidence_points: Mapping[str, float] = field(default_factory=lambda: dict(K.CONFIDENCE_POINTS))
    part_weights: Mapping[str, float] = field(default_factory=lambda: dict(K.PART_WEIGHTS))
    remote_parts: tuple[str, ...] = K.REMOTE_PARTS
    poc_terms: tuple[str, ...] = K.POC_TERMS
    remote_terms: tuple[str, ...] = K.REMOTE_TERMS
    unauthenticated_terms: tuple[str, ...] = K.UNAUTHENTICATED_TERMS
    authenticated_terms: tuple[str, ...] = K.AUTHENTICATED_TERMS
    shared_terms: tuple[str, ...] = K.MULTI_VENDOR_TERMS + K.COMMON_COMPONENT_TERMS


def _signal(contribution: Column, evidence: Column) -> Column:
    return F.struct(contribution.cast("double").alias("contribution"), evidence.cast("string").alias("evidence"))


def _fixed(contribution: float, evidence: str) -> Column:
    return _signal(F.lit(contribution), F.lit(evidence))


def plain_metadata(metadata: Column | str = "metadata") -> Column:
    """Metadata without earlier scoring, which rules must not read."""
    return F.map_filter(T.col(metadata), lambda key, _value: key != "scoring")


def searchable_text() -> Column:
    """Twelve fields flattened to one normalised text."""
    external = F.flatten(F.map_values("external_ids"))
    metadata = F.filter(F.map_values(plain_metadata()), lambda value: value.isNotNull())
    return T.normalize_text(
        F.concat_ws(
            " ", "title", "summary", "source_names", "source_urls", external, "affected_vendor", "affected_product",
            "vehicle_component", "attack_surface", "exploit_status", "tags", metadata,
        )
    )


def folded_tags() -> Column:
    return F.transform(filled("tags"), lambda tag: F.replace(T.normalize_text(tag), F.lit(" "), F.lit("_")))


def _catalogue_metadata() -> Column:
    present = F.lit(False)
    for key in K.CATALOGUE_KEYS:
        present = present | F.coalesce(F.try_element_at("metadata", F.lit(key)) != "", F.lit(False))
    return present


def known_exploited() -> Column:
    names = F.transform(filled("source_names"), T.scoring_key)
    return (
        (T.scoring_key("exploit_status") == "exploited")
        | F.arrays_overlap(folded_tags(), F.array(*[F.lit(tag) for tag in K.KNOWN_EXPLOITED_TAGS]))
        | F.arrays_overlap(names, F.array(*[F.lit(name) for name in K.KNOWN_EXPLOITED_SOURCES]))
        | _catalogue_metadata()
    )


def _base_signal(config: ScoringConfig) -> Column:
    bounded = F.least(F.greatest(F.col("cvss_score").cast("double"), F.lit(0.0)), F.lit(10.0))
    severity = F.coalesce(T.none_if_blank(T.scoring_key("severity")), F.lit("unknown"))
    points = T.lookup(severity, config.severity_points, config.severity_points["unknown"])
    return F.when(F.col("cvss_score").isNotNull(), _signal(F.round(bounded * 7.0, 2), F.round(bounded, 1))).otherwise(
        _signal(points, severity)
    )


def _remote_signal(config: ScoringConfig) -> Column:
    access = F.col("access")
    surface, component = F.col("surface_key"), F.col("component_key")
    remote_part = surface.isin(*config.remote_parts) | component.isin(*config.remote_parts)
    return (
        F.when(access == "N", _fixed(10.0, "network"))
        .when(remote_part, _signal(F.lit(10.0), F.coalesce(T.none_if_blank(surface), component)))
        .when(access == "A", _fixed(7.0, "adjacent_network"))
        .when(T.contains_any(F.col("signal_text"), config.remote_terms), _fixed(8.0, "text"))
    )


def _authentication_signal(config: ScoringConfig) -> Column:
    privileges = F.col("privileges")
    text = F.col("signal_text")
    return (
        F.when(privileges == "N", _fixed(8.0, "none_required"))
        .when(T.contains_any(text, config.unauthenticated_terms), _fixed(8.0, "none_required"))
        .when(privileges == "L", _fixed(3.0, "low_privilege_required"))
        .when(privileges == "H", _fixed(-4.0, "high_privilege_required"))
        .when(T.contains_any(text, config.authenticated_terms), _fixed(-4.0, "authentication_required"))
    )


def _part_signal(config: ScoringConfig) -> Column:
    weighted = tuple(config.part_weights)
    part = F.when(F.col("component_key").isin(*weighted), F.col("component_key")).otherwise(F.col("surface_key"))
    return F.when(part.isin(*weighted), _signal(T.lookup(part, config.part_weights), part))


def _shared_by_many(config: ScoringConfig) -> Column:
    """Looks at vendor, product and the searchable text, in that order, as one text."""
    return F.col("vendor_text").isin(*K.MULTI_VENDOR_NAMES) | T.contains_any(F.col("maker_text"), config.shared_terms)


def _confidence_key() -> Column:
    return F.coalesce(T.none_if_blank(T.scoring_key("confidence")), F.lit("medium"))


def _factor(key: Column | str, signal: Column) -> Column:
    name = F.lit(key) if isinstance(key, str) else key
    return F.when(
        signal.isNotNull(),
        F.struct(
            name.alias("key"),
            T.lookup(name, K.FACTOR_LABELS).alias("label"),
            F.round(signal["contribution"], 2).alias("contribution"),
            signal["evidence"].alias("evidence"),
        ),
    )


SCORING_INPUTS = (
    "title", "summary", "intelligence_type", "cve_id", "cwe_id", "cvss_score", "cvss_vector", "severity",
    "affected_vendor", "affected_product", "affected_version", "vehicle_component", "attack_surface",
    "exploit_status", "confidence",
)


def source_fingerprint(config: ScoringConfig = ScoringConfig()) -> Column:
    """Hash of the scoring inputs, to notice that a record changed."""

    def sorted_map(column: Column) -> Column:
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))), {"ignoreNullFields": "false"})

    fields = {name: F.col(name) for name in SCORING_INPUTS}
    fields["rule_version"] = F.lit(config.rule_version)
    fields["source_names"] = F.array_sort(filled("source_names"))
    fields["tags"] = F.array_sort(filled("tags"))
    encoded = {"external_ids": sorted_map(F.col("external_ids")), "metadata": sorted_map(plain_metadata())}
    return sha256(escape_non_ascii(canonical_json(fields, encoded)))


_SIGNALS = (
    "base_signal", "exploit_signal", "poc_signal", "remote_signal", "authentication_signal", "part_signal",
    "shared_signal", "confidence_signal",
)


def score_parts(records: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Records with ``factors`` (array), ``new_score``, ``new_level`` and the signal columns. No shuffle."""
    vendor, product = T.normalize_text("affected_vendor"), T.normalize_text("affected_product")
    texted = records.withColumn("signal_text", searchable_text())
    prepared = texted.withColumns(
        {
            "access": T.cvss_metric("cvss_vector", "AV"),
            "privileges": T.cvss_metric("cvss_vector", "PR"),
            "vendor_text": vendor,
            "maker_text": F.concat_ws(" ", T.none_if_blank(vendor), T.none_if_blank(product), "signal_text"),
            "surface_key": T.scoring_key("attack_surface"),
            "component_key": T.scoring_key("vehicle_component"),
            "tag_keys": folded_tags(),
            "is_known_exploited": known_exploited(),
        }
    )
    proof_status = T.scoring_key("exploit_status") == "proof_of_concept"
    public_poc = T.contains_any(F.col("signal_text"), config.poc_terms) | F.arrays_overlap(
        "tag_keys", F.array(*[F.lit(tag) for tag in K.POC_TAGS])
    )
    signals = prepared.withColumns(
        {
            "base_signal": _base_signal(config),
            "exploit_signal": F.when(F.col("is_known_exploited"), _fixed(25.0, "true")).when(
                proof_status, _fixed(12.0, "proof_of_concept")
            ),
            "poc_signal": F.when(public_poc, _fixed(10.0, "true")),
            "remote_signal": _remote_signal(config),
            "authentication_signal": _authentication_signal(config),
            "part_signal": _part_signal(config),
            "shared_signal": F.when(_shared_by_many(config), _fixed(8.0, "true")),
            "confidence_signal": _signal(
                T.lookup(_confidence_key(), config.confidence_points, 0.0), _confidence_key()
            ),
        }
    )
    base_key = F.when(F.col("cvss_score").isNotNull(), F.lit("cvss")).otherwise(F.lit("severity"))
    exploit_key = F.when(F.col("is_known_exploited"), F.lit("known_exploited")).otherwise(F.lit("exploit_status"))
    factors = F.array_compact(
        F.array(
            _factor(base_key, F.col("base_signal")),
            _factor(exploit_key, F.col("exploit_signal")),
            _factor("public_poc", F.col("poc_signal")),
            _factor("remote_exploitability", F.col("remote_signal")),
            _factor("authentication_requirement", F.col("authentication_signal")),
            _factor("vehicle_critical_component", F.col("part_signal")),
            _factor("multi_vendor_common_component", F.col("shared_signal")),
            _factor("source_confidence", F.col("confidence_signal")),
        )
    )
    total = F.lit(0.0)
    for name in _SIGNALS:
        total = total + F.coalesce(F.round(F.col(f"{name}.contribution"), 2), F.lit(0.0))
    return signals.withColumns({"factors": factors, "new_score": bounded_score(total)}).withColumn(
        "new_level", risk_level_for_score("new_score")
    )


_WORK = (
    "access", "privileges", "vendor_text", "maker_text", "signal_text", "surface_key", "component_key", "tag_keys", "is_known_exploited", *_SIGNALS, "factors",
    "new_score", "new_level",
)


def _explanation(config: ScoringConfig) -> Column:
    return F.struct(
        F.lit(config.rule_version).alias("rule_version"),
        source_fingerprint(config).alias("source_fingerprint"),
        F.col("new_score").alias("score"),
        F.col("new_level").alias("level"),
        F.col("factors"),
        F.struct(
            F.col("is_known_exploited").alias("known_exploited"),
            F.col("poc_signal").isNotNull().alias("public_poc"),
            F.col("remote_signal").isNotNull().alias("remote_exploitability"),
            F.coalesce("authentication_signal.evidence", F.lit("unknown")).alias("authentication"),
            F.col("part_signal.evidence").alias("vehicle_component"),
            F.col("shared_signal").isNotNull().alias("multi_vendor_or_common_component"),
            F.col("confidence_signal.evidence").alias("source_confidence"),
        ).alias("signals"),
    )


def score(records: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Records with new risk_score, risk_level and a ``scoring`` struct."""
    scored = score_parts(records, config).withColumn("scoring", _explanation(config))
    return scored.withColumns({"risk_score": F.col("new_score"), "risk_level": F.col("new_level")}).drop(*_WORK)


def candidates(records: DataFrame, force: bool = False) -> DataFrame:
    """Normalised records without a score, or all normalised records when forced."""
    normalized = records.filter(F.col("processing_status") == "normalized")
    return normalized if force else normalized.filter(unscored())


def unscored() -> Column:
    return F.col("risk_score").isNull() | (F.col("risk_level") == "info")


def scoring_priority(records: DataFrame, limit: int) -> DataFrame:
    """Bounded runs: unscored first, then ``info``, then the longest untouched."""
    priority = F.when(F.col("risk_score").isNull(), 0).when(F.col("risk_level") == "info", 1).otherwise(2)
    return records.orderBy(priority, "updated_at", "created_at", "id").limit(limit)


def score_table(records: DataFrame, config: ScoringConfig = ScoringConfig(), force: bool = False, now: Column | None = None) -> DataFrame:
    """The whole table with candidates scored in place and ``score_action`` per row.

    One projection over one scan: rows that are no candidates keep their values.
    """
    eligible = F.col("processing_status") == "normalized"
    if not force:
        eligible = eligible & unscored()
    parts = score_parts(records, config).withColumns({"eligible": eligible, "scoring_json": F.to_json(_explanation(config))})
    same_score = F.abs(F.col("risk_score").cast("double") - F.col("new_score")) < 0.005
    current = F.coalesce(
        same_score
        & (F.col("risk_level") == F.col("new_level"))
        & (F.try_element_at("metadata", F.lit("scoring")) == F.col("scoring_json")),
        F.lit(False),
    )
    action = (
        F.when(~F.col("eligible"), F.lit("skipped")).when(current, F.lit("unchanged")).otherwise(F.lit("scored"))
    )
    changed = F.col("score_action") == "scored"
    others = plain_metadata()
    rescored = F.map_concat(others, F.create_map(F.lit("scoring"), F.col("scoring_json")))
    updated = F.col("updated_at") if now is None else F.when(changed, now).otherwise(F.col("updated_at"))
    return (
        parts.withColumn("score_action", action)
        .withColumns(
            {
                "risk_score": F.when(changed, F.col("new_score")).otherwise(F.col("risk_score")),
                "risk_level": F.when(changed, F.col("new_level")).otherwise(F.col("risk_level")),
                "metadata": F.when(changed, rescored).otherwise(F.col("metadata")),
                "updated_at": updated,
            }
        )
        .drop(*_WORK, "eligible", "scoring_json")
    )
