"""Batches of changes to alerts, sources and manual records, with an audit trail.

Several changes to one entity in a batch are folded in arrival order into one change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.functions import text as T
from fleetsight.functions.keys import manual_key, stable_hash
from fleetsight.functions.redact import looks_sensitive, safe_text
from fleetsight.functions.urls import safe_url
from fleetsight.session import checkpointed
from fleetsight.sources.batches import check_patch, split_valid, strip_to_null
from fleetsight.sources.envelope import string_map


def audit(
    changes: DataFrame,
    *,
    action: Column,
    entity_type: str,
    entity_id: Column,
    summary: Column,
    now: Column,
    before: Column | None = None,
    after: Column | None = None,
    metadata: Column | None = None,
) -> DataFrame:
    """Append-only audit rows with the state before and after as JSON."""

    def as_json(state: Column | None) -> Column:
        return F.lit(None).cast("string") if state is None else F.to_json(state, {"ignoreNullFields": "false"})

    nothing = F.create_map().cast("map<string,string>")
    return changes.select(
        action.alias("action"),
        F.lit(entity_type).alias("entity_type"),
        entity_id.cast("string").alias("entity_id"),
        summary.alias("summary"),
        as_json(before).alias("before"),
        as_json(after).alias("after"),
        (nothing if metadata is None else metadata).alias("metadata"),
        now.alias("occurred_at"),
    )


def _last(changes: DataFrame, name: str, supplied: Column | None = None) -> Column:
    order = F.col("arrival") if supplied is None else F.when(supplied, F.col("arrival"))
    return F.max_by(name, order).alias(f"new_{name}")


def unknown_ids(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes to entities that are not there, which nothing else would name; a null id is none."""
    return changes.join(entities.select("id"), "id", "left_anti")


NOTES_LENGTH = 2000


def apply_alert_status(
    alerts: DataFrame, changes: DataFrame, now: Column, sizes: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alerts, audit events, rejected changes).

    ``changes`` has id, status, notes, notes_supplied and arrival. Notes are replaced only when
    supplied, and a supplied null clears them. Notes that look like credentials and unknown statuses are
    rejected, with ``sizes`` also notes over ``NOTES_LENGTH`` characters. Changes to ids that no alert has
    change nothing; :func:`unknown_ids` lists them.
    """
    cleaned = changes.withColumn("notes", strip_to_null("notes"))
    bad = (
        looks_sensitive("notes")
        | F.coalesce(F.lit(sizes) & (F.length("notes") > NOTES_LENGTH), F.lit(False))
        | ~F.coalesce(F.col("status").isin("open", "acknowledged", "closed"), F.lit(False))
    )
    rejected, valid = cleaned.filter(bad), cleaned.filter(~bad)
    folded = valid.groupBy("id").agg(
        _last(valid, "status"), _last(valid, "notes", F.col("notes_supplied")), F.max("notes_supplied").alias("has_notes")
    )
    joined = alerts.join(folded, "id", "left").withColumns(
        {
            "changed": F.col("new_status").isNotNull(),
            "next_status": F.coalesce("new_status", "status"),
            "next_notes": F.when(F.col("has_notes"), F.col("new_notes")).otherwise(F.col("notes")),
        }
    )

    def snapshot(status: str, notes: str) -> Column:
        return F.struct(
            F.col("id"), F.col(status).alias("status"), safe_text(notes).alias("notes"), F.col("triggering_rule"), F.col("threat_intelligence_id")
        )

    events = audit(
        joined.filter("changed"),
        action=F.when(F.col("next_status") == "closed", F.lit("alert_closure")).otherwise(F.lit("status_change")),
        entity_type="alert",
        entity_id=F.col("id"),
        summary=F.lit("alert status set"),
        before=snapshot("status", "notes"),
        after=snapshot("next_status", "next_notes"),
        metadata=string_map(
            {"triggering_rule": F.col("triggering_rule"), "threat_intelligence_id": F.col("threat_intelligence_id")}
        ),
        now=now,
    )
    after = joined.withColumns({"status": F.col("next_status"), "notes": F.col("next_notes")}).select(*alerts.columns)
    return after, events, rejected


def _source_status_known() -> Column:
    return F.coalesce(F.col("status").isin("enabled", "disabled", "error"), F.lit(False))


def rejected_source_status(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that :func:`apply_source_status` does not apply, each once with its ``problem``."""
    odd = changes.filter(~_source_status_known()).withColumn("problem", F.lit("unknown status"))
    lost = unknown_ids(sources, changes.filter(_source_status_known())).withColumn("problem", F.lit("unknown source"))
    return odd.unionByName(lost)


def apply_source_status(sources: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(sources, audit events). ``changes`` has id, status, reason and arrival; the error text survives only ``error``."""
    valid = changes.filter(_source_status_known())
    folded = valid.groupBy("id").agg(_last(valid, "status"), _last(valid, "reason"))
    joined = sources.join(folded, "id", "left").withColumn("next_status", F.coalesce("new_status", "status"))
    changed = F.col("new_status").isNotNull()

    def snapshot(status: str) -> Column:
        return F.struct(F.col("id"), F.col("name"), F.col(status).alias("status"), safe_url("base_url").alias("base_url"))

    events = audit(
        joined.filter(changed),
        action=F.lit("status_change"),
        entity_type="source",
        entity_id=F.col("id"),
        summary=F.lit("source status set"),
        before=snapshot("status"),
        after=snapshot("next_status"),
        metadata=string_map({"reason": safe_text("new_reason"), "source_name": F.col("name")}),
        now=now,
    )
    after = joined.withColumns(
        {
            "last_error_message": F.when(changed & (F.col("next_status") != "error"), F.lit(None)).otherwise(
                F.col("last_error_message")
            ),
            "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
            "status": F.col("next_status"),
        }
    ).select(*sources.columns)
    return after, events


PLAIN_FIELDS = (
    "title", "summary", "cve_id", "cwe_id", "cvss_score", "cvss_vector", "severity", "affected_vendor",
    "affected_product", "affected_version", "vehicle_component", "attack_surface", "exploit_status", "confidence",
    "risk_score", "risk_level", "status",
)


def entry_category() -> Column:
    """Category of a manual record: metadata, else the lead tag, else its type."""
    given = T.none_if_blank(F.try_element_at("metadata", F.lit("manual_entry_category")))
    return F.coalesce(
        given, F.when(F.array_contains("tags", "research_lead"), F.lit("research_lead")), F.col("intelligence_type")
    )


def _first_or_default(values: str) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit("manual://entry"))


def _entry_snapshot() -> Column:
    return F.struct(
        F.col("id"),
        F.col("category"),
        F.col("title"),
        F.col("status"),
        F.col("dedup_key"),
        F.col("cve_id"),
        _first_or_default("source_names").alias("source_name"),
        _first_or_default("source_urls").alias("source_url"),
    )


def apply_manual_patch(
    records: DataFrame, raw: DataFrame, links: DataFrame, patches: DataFrame, now: Column
) -> dict[str, DataFrame]:
    """Records, raw rows, links and audit events after patches to manual records.

    ``patches`` has id, ``supplied`` (names of the fields that are set), the fields, and arrival. Only
    supplied fields change. A patch whose new key belongs to another record is rejected, as are
    invalid patches and patches to records that are not manual.
    """
    from fleetsight.operators.ingest import manual_tags
    from fleetsight.operators.search import is_manual

    valid, invalid = split_valid(check_patch(patches))
    fields = (*PLAIN_FIELDS, "source_name", "source_url", "tags")
    folded = valid.groupBy("id").agg(
        *[
            F.max_by(F.struct(F.col(name).alias("value")), F.when(F.array_contains("supplied", name), F.col("arrival"))).alias(
                f"new_{name}"
            )
            for name in fields
        ]
    )
    joined = records.join(folded, "id").filter(is_manual()).withColumn("category", entry_category())

    def supplied(name: str) -> Column:
        return F.col(f"new_{name}").isNotNull()

    def value(name: str, otherwise: Column) -> Column:
        return F.when(supplied(name), F.col(f"new_{name}.value")).otherwise(otherwise)

    moved = supplied("source_name") | supplied("source_url")
    name_in = value("source_name", _first_or_default("source_names"))
    url_in = value("source_url", _first_or_default("source_urls"))
    new_name = T.default_source_name(name_in, url_in)
    new_url = T.default_source_url(url_in, new_name)
    before = joined.withColumns({"before": _entry_snapshot(), "old_status": F.col("status"), "old_key": F.col("dedup_key")})
    patched = before.withColumns(
        {
            **{name: value(name, F.col(name)) for name in PLAIN_FIELDS},
            "tags": F.when(supplied("tags"), manual_tags(F.col("category"), "new_tags.value")).otherwise(F.col("tags")),
            "source_names": F.when(moved, F.array(new_name)).otherwise(F.col("source_names")),
            "source_urls": F.when(moved, F.array(new_url)).otherwise(F.col("source_urls")),
            "canonical_source_url": F.when(moved, new_url).otherwise(F.col("canonical_source_url")),
            "last_seen_at": now,
            "updated_at": now,
        }
    )
    keyed = patched.withColumn(
        "dedup_key",
        manual_key(
            F.col("category"), F.col("cve_id"), F.col("title"), _first_or_default("source_names"), _first_or_default("source_urls")
        ),
    )
    keyed = checkpointed(keyed)
    # A new key must be free in the table, and only the first patch of the batch may take it.
    holders = records.join(keyed.select("dedup_key").distinct(), "dedup_key", "left_semi").select(
        "dedup_key", F.col("id").alias("holder")
    )
    firsts = keyed.groupBy("dedup_key").agg(F.min("id").alias("first_id"))
    checked = keyed.join(holders, "dedup_key", "left").join(firsts, "dedup_key")
    changed_key = F.col("dedup_key") != F.col("old_key")
    collides = changed_key & (
        F.coalesce(F.col("holder") != F.col("id"), F.lit(False)) | (F.col("first_id") != F.col("id"))
    )
    accepted = checked.filter(~collides)
    snapshot = {field: F.col(f"after.{field}") for field in ("id", "category", "title", "status", "dedup_key", "cve_id", "source_name", "source_url")}
    accepted = accepted.withColumn("after", _entry_snapshot()).withColumn("normalized_text_hash", stable_hash(snapshot))
    after_records = records.join(accepted.select("id"), "id", "left_anti").unionByName(accepted.select(*records.columns))

    facts = accepted.select(
        F.col("id").alias("record_id"),
        "raw_intelligence_id",
        F.col("title").alias("p_title"),
        F.col("summary").alias("p_summary"),
        F.col("after.source_name").alias("p_name"),
        F.col("after.source_url").alias("p_url"),
        F.col("dedup_key").alias("p_key"),
        F.col("normalized_text_hash").alias("p_hash"),
    )
    hit = F.col("record_id").isNotNull()

    def take(new: Column, old: str) -> Column:
        return F.when(hit, new).otherwise(F.col(old))

    after_raw = raw.join(
        facts.withColumnRenamed("raw_intelligence_id", "id"), "id", "left"
    ).withColumns(
        {
            "title": take(F.col("p_title"), "title"),
            "summary": take(F.col("p_summary"), "summary"),
            "snippet": take(F.col("p_summary"), "snippet"),
            "source_name": take(F.col("p_name"), "source_name"),
            "source_url": take(F.col("p_url"), "source_url"),
            "content_hash": take(F.col("p_hash"), "content_hash"),
        }
    ).select(*raw.columns)
    # Only the first link of a record follows the patch.
    first_links = links.groupBy("threat_intelligence_id").agg(F.min("id").alias("id"))
    marked = first_links.join(facts.drop("raw_intelligence_id").withColumnRenamed("record_id", "threat_intelligence_id"), "threat_intelligence_id").drop(
        "threat_intelligence_id"
    ).withColumn("record_id", F.lit(True))
    after_links = links.join(marked, "id", "left").withColumns(
        {
            "source_name": take(F.col("p_name"), "source_name"),
            "source_url": take(F.col("p_url"), "source_url"),
            "external_id": take(F.col("p_key"), "external_id"),
            "last_seen_at": take(now, "last_seen_at"),
        }
    ).select(*links.columns)
    status_changed = F.col("old_status") != F.col("status")
    events = audit(
        accepted,
        action=F.when(status_changed, F.lit("status_change")).otherwise(F.lit("manual_entry")),
        entity_type="threat_intelligence",
        entity_id=F.col("id"),
        summary=F.when(status_changed, F.lit("manual record: status set")).otherwise(F.lit("manual record: fields set")),
        before=F.col("before"),
        after=F.col("after"),
        metadata=string_map({"dedup_key": F.col("dedup_key")}),
        now=now,
    )
    return {
        "records": after_records,
        "raw": after_raw,
        "links": after_links,
        "audit": events,
        "rejected": checked.filter(collides).select("id", F.col("dedup_key").alias("wanted_key")),
        "invalid": invalid,
    }
