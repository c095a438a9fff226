"""The raw envelope every reader ends in, its retention rules and high-water marks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.functions.keys import envelope_hash
from fleetsight.functions.text import none_if_blank


@dataclass(frozen=True)
class SourceInfo:
    """What a reader has to know about the feed it reads for."""

    name: str
    source_type: str = "api"
    base_url: str | None = None
    source_id: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)


def string_map(fields: dict[str, Column]) -> Column:
    """Map with every key present; a missing value is a null entry, not a missing key."""
    entries: list[Column] = []
    for key, value in fields.items():
        entries += [F.lit(key), value.cast("string")]
    return F.create_map(*entries)


def apply_retention(raw: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Drop payloads of document types, and those over ``max_bytes`` if there is a limit; say so in the metadata.

    Normalising reads the payload, so a limit belongs after it.
    """
    by_type = F.col("source_type").isin(*K.PAYLOAD_DROPPING_TYPES)
    too_large = F.lit(False) if max_bytes is None else F.coalesce(F.octet_length("raw_content") > max_bytes, F.lit(False))
    reason = F.when(by_type, F.lit("metadata_only")).when(too_large, F.lit("raw_content_too_large"))
    metadata = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    others = F.map_filter(metadata, lambda key, _value: key != "retention_enforced")
    return raw.withColumns(
        {
            "raw_content": F.when(reason.isNull(), F.col("raw_content")),
            "retained_payload_mode": F.when(reason.isNull(), F.col("retained_payload_mode")).otherwise(
                F.lit("metadata_only")
            ),
            "metadata": F.when(reason.isNull(), F.col("metadata")).otherwise(
                F.map_concat(others, F.create_map(F.lit("retention_enforced"), reason))
            ),
        }
    )


def to_raw(items: DataFrame, source: SourceInfo, retained: str | None = None) -> DataFrame:
    """Envelope with content and raw hashes, defaults and initial statuses.

    ``items`` has source_url, external_id, title, summary, snippet, raw_content (JSON text),
    first_seen_at, fetched_at, metadata and optionally error_message.
    """
    fallback_url = source.base_url or f"source://{source.name}"
    default_mode = "raw_payload" if source.source_type in K.PAYLOAD_RETAINING_TYPES else "metadata_only"
    error = F.col("error_message") if "error_message" in items.columns else F.lit(None).cast("string")
    addressed = items.withColumns(
        {
            "source_url": F.coalesce(none_if_blank("source_url"), F.lit(fallback_url)),
            "first_seen_at": F.coalesce("first_seen_at", "fetched_at"),
            "error_message": error,
        }
    )
    content_fields = {name: F.col(name) for name in ("source_url", "external_id", "title", "summary", "snippet")}
    hashed = addressed.withColumn("content_hash", envelope_hash(content_fields, {"raw_content": F.col("raw_content")}))
    identity = {
        "source_name": F.lit(source.name),
        "source_type": F.lit(source.source_type),
        "source_url": F.col("source_url"),
        "external_id": F.col("external_id"),
        "content_hash": F.col("content_hash"),
    }
    return apply_retention(
        hashed.withColumn("raw_hash", envelope_hash(identity)).select(
            F.col("raw_hash").alias("id"),
            F.lit(source.source_id).cast("string").alias("source_id"),
            F.lit(source.name).alias("source_name"),
            F.lit(source.source_type).alias("source_type"),
            "source_url",
            "external_id",
            "fetched_at",
            "first_seen_at",
            "title",
            "summary",
            "snippet",
            "raw_content",
            "raw_hash",
            "content_hash",
            F.lit("pending").alias("parsing_status"),
            F.lit("collected").alias("processing_status"),
            "error_message",
            "metadata",
            F.lit(retained or default_mode).alias("retained_payload_mode"),
            F.col("fetched_at").alias("created_at"),
            F.col("fetched_at").alias("updated_at"),
        )
    )


PAGE_ERROR = "page does not parse"


def page_entries(pages: DataFrame, entries: str, parsed: str = "") -> DataFrame:
    """``pages`` with one row per element of ``entries`` as ``entry``, and ``unread``.

    A page that does not parse gives one row with a null entry that is ``unread``; a page without entries none.
    """
    unread = F.col(entries).isNull() & F.col(f"{parsed}_corrupt_record").isNotNull()
    nothing = F.array(F.get(F.col(entries), F.lit(0)))
    marked = pages.withColumn("unread", unread)
    return marked.withColumn("entry", F.explode(F.when(F.col("unread"), nothing).otherwise(F.col(entries))))


def split_errors(frame: DataFrame, column: str = "error_message") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). Both are filters over one plan; nothing is dropped."""
    return frame.filter(F.col(column).isNull()), frame.filter(F.col(column).isNotNull())


def since(frame: DataFrame, column: Column, cursor: Column | None, now: Column, days: int = K.CVE_WINDOW_DAYS) -> DataFrame:
    """Rows changed in ``[cursor or now - days, now]``; a plain range filter that prunes files."""
    default = now - F.make_interval(days=F.lit(days))
    return frame.filter(column.between(default if cursor is None else F.coalesce(cursor, default), now))


def next_cursor(frame: DataFrame, column: str, *keys: str) -> DataFrame:
    """Highest value seen, per key when keys are given."""
    return frame.groupBy(*keys).agg(F.max(column).alias("next_cursor"))


def page_hashes(raw: DataFrame) -> DataFrame:
    """Cursor of the page reader: the set of content hashes, as rows."""
    return raw.select("source_name", "content_hash").distinct()
