"""Canonical JSON, hashes and merge keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetsight.functions.text import col, none_if_blank, normalize_text
from fleetsight.functions.urls import canonical_url


def json_value(value: Column | str) -> Column:
    """JSON text of one scalar or array column; null becomes ``null``."""
    wrapped = F.to_json(F.array(col(value)), {"ignoreNullFields": "false"})
    return F.when(col(value).isNull(), F.lit("null")).otherwise(
        F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
    )


def canonical_json(fields: dict[str, Column], encoded: dict[str, Column] | None = None) -> Column:
    """Compact JSON object with sorted keys. ``encoded`` holds values that are JSON text already."""
    if not encoded:
        return F.to_json(F.struct(*[fields[key].alias(key) for key in sorted(fields)]), {"ignoreNullFields": "false"})
    parts = {key: json_value(value) for key, value in fields.items()}
    parts.update({key: F.coalesce(value, F.lit("null")) for key, value in (encoded or {}).items()})
    pieces: list[Column] = []
    for position, key in enumerate(sorted(parts)):
        pieces += [F.lit(f'{"," if position else "{"}"{key}":'), parts[key]]
    return F.concat(*pieces, F.lit("}"))


def _escape_char(char: Column) -> Column:
    code_units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
    return F.when(char.rlike("^[^\\x00-\\x7f]"), F.regexp_replace(code_units, "([0-9a-f]{4})", r"\\u$1")).otherwise(char)


def escape_non_ascii(text: Column) -> Column:
    """Non-ASCII characters as ``\\uXXXX`` code units; ASCII text is passed through."""
    escaped = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), _escape_char), "")
    return F.when(F.length(text) != F.octet_length(text), escaped).otherwise(text)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_hash(fields: dict[str, Column], encoded: dict[str, Column] | None = None) -> Column:
    """Hash of the canonical JSON with non-ASCII escaped: the form used by merge keys."""
    return sha256(escape_non_ascii(canonical_json(fields, encoded)))


def envelope_hash(fields: dict[str, Column], encoded: dict[str, Column] | None = None) -> Column:
    """Hash of the canonical JSON with non-ASCII kept: the form used by raw envelopes."""
    return sha256(canonical_json(fields, encoded))


def text_hash(value: Column | str) -> Column:
    return sha256(normalize_text(value))


def short_hash(fields: dict[str, Column], length: int = 48) -> Column:
    return F.substring(stable_hash(fields), 1, length)


def _prefixed(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value)


def record_key(
    cve_id: Column, source_url: Column, title: Column, source_name: Column, content_hash: Column, normalized_hash: Column
) -> Column:
    """CVE, else address, else title with source, else content hash, else text hash, else a fallback hash."""
    url = canonical_url(source_url)
    title_text, source_text = none_if_blank(normalize_text(title)), none_if_blank(normalize_text(source_name))
    return F.coalesce(
        _prefixed("cve:", F.upper(none_if_blank(cve_id))),
        F.when(url.isNotNull(), _prefixed("url:", short_hash({"url": url}))),
        F.when(
            title_text.isNotNull() & source_text.isNotNull(),
            _prefixed("title-source:", short_hash({"title": title_text, "source_name": source_text})),
        ),
        _prefixed("content:", none_if_blank(content_hash)),
        _prefixed("text:", none_if_blank(normalized_hash)),
        _prefixed("fallback:", short_hash({"title": title, "source": source_name})),
    )


def external_key(
    cve_id: Column,
    supplied_key: Column,
    external_id: Column,
    source_name: Column,
    source_url: Column,
    content_hash: Column,
    normalized_hash: Column,
) -> Column:
    """CVE, else supplied key, else source with external id, else content hash, else address, else text hash."""
    key, external, url = none_if_blank(supplied_key), none_if_blank(external_id), none_if_blank(source_url)
    return F.coalesce(
        _prefixed("cve:", F.upper(none_if_blank(cve_id))),
        F.when(key.isNotNull(), _prefixed("external:", short_hash({"dedup_key": key}))),
        F.when(
            external.isNotNull(),
            _prefixed("external:", short_hash({"source_name": source_name, "external_id": external})),
        ),
        _prefixed("content:", none_if_blank(content_hash)),
        F.when(url.isNotNull(), _prefixed("url:", short_hash({"url": url}))),
        _prefixed("text:", normalized_hash),
    )


def manual_key(category: Column, cve_id: Column, title: Column, source_name: Column, source_url: Column) -> Column:
    signature = stable_hash(
        {
            "category": category,
            "title": normalize_text(title),
            "source_name": normalize_text(source_name),
            "source_url": F.lower(source_url),
        }
    )
    return F.coalesce(
        _prefixed("manual:cve:", F.upper(none_if_blank(cve_id))),
        F.concat(F.lit("manual:"), category, F.lit(":"), F.substring(signature, 1, 32)),
    )


def record_id(dedup_key: Column | str) -> Column:
    """Deterministic id, so that a replay or a retried task gives the same record."""
    return sha256(F.concat(F.lit("record:"), col(dedup_key)))
