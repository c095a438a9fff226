"""External and manual batches: validation with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.functions.redact import MANUAL_SENSITIVE_ASSIGNMENT, SENSITIVE_ASSIGNMENT, assigns
from fleetsight.session import checkpointed
from fleetsight.functions.text import lookup, none_if_blank, strip

ERRORS = "validation_errors"
_CVE = r"^CVE-\d{4}-\d{4,}$"


def strip_to_null(value: Column | str) -> Column:
    return none_if_blank(strip(value))


def _when(condition: Column, code: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(code))


def _clean_list(values: str) -> Column:
    """Lowered, trimmed, distinct, sorted; a null list is an empty one."""
    stripped = F.transform(values, lambda item: strip_to_null(F.lower(item)))
    kept = F.sort_array(F.array_distinct(F.filter(stripped, lambda item: item.isNotNull())))
    return F.coalesce(kept, F.array().cast("array<string>"))


def _with_errors(frame: DataFrame, checks: list[Column]) -> DataFrame:
    return frame.withColumn(ERRORS, F.array_compact(F.array(*checks)))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid without the error column, rejected with it), from one written stage.

    Filtering on the reasons before they are written would evaluate every check inside the
    filter, once per use.
    """
    checked = checkpointed(checked)
    return (
        checked.filter(F.size(ERRORS) == 0).drop(ERRORS),
        checked.filter(F.size(ERRORS) > 0),
    )


def check_external(batch: DataFrame, sizes: bool = False) -> DataFrame:
    """Cleaned external rows with the list of reasons why a row is refused.

    ``sizes`` also refuses rows over the size limits of :mod:`constants`; by default no row is refused for its size.
    """
    texts = [name for name in K.EXTERNAL_TEXT_LIMITS if name != "cve_id"]
    severity = F.lower(strip_to_null("severity"))
    cleaned = batch.withColumns(
        {
            **{name: strip_to_null(name) for name in texts},
            "cve_id": F.upper(F.trim("cve_id")),
            "severity": F.coalesce(lookup(severity, K.SEVERITY_ALIASES), severity, F.lit("unknown")),
            **{name: _clean_list(name) for name in K.EXTERNAL_LIST_LIMITS},
            "given_counts": F.struct(*[F.size(F.coalesce(name, F.array())).alias(name) for name in K.EXTERNAL_LIST_LIMITS]),
        }
    )
    secret_checked = [name for name in texts if name != "source_url"]
    checks = [_when(F.col(name).isNull(), f"missing:{name}") for name in ("source_name", "source_url", "title", "summary")]
    if sizes:
        checks += [_when(F.length(name) > size, f"too_long:{name}") for name, size in K.EXTERNAL_TEXT_LIMITS.items()]
    checks += [_when(F.length("title") < 3, "too_short:title")]
    checks += [_when(assigns(name, SENSITIVE_ASSIGNMENT), f"secret:{name}") for name in secret_checked]
    checks += [
        _when(F.col("source_url").contains(" ") | ~F.col("source_url").contains("://"), "invalid:source_url"),
        _when(~F.col("cve_id").rlike(_CVE), "invalid:cve_id"),
        _when(~F.col("severity").isin(*K.SEVERITIES), "invalid:severity"),
        _when(~F.col("external_score").between(0, 100), "invalid:external_score"),
    ]
    if sizes:
        checks += [_when(F.length("raw_payload") > K.EXTERNAL_PAYLOAD_LENGTH, "too_long:raw_payload")]
    for name, size in K.EXTERNAL_LIST_LIMITS.items():
        if sizes:
            checks += [
                _when(F.col(f"given_counts.{name}") > size, f"too_many:{name}"),
                _when(F.exists(name, lambda item: F.length(item) > K.EXTERNAL_ITEM_LENGTH), f"too_long:{name}"),
            ]
        checks += [_when(F.exists(name, lambda item: assigns(item, SENSITIVE_ASSIGNMENT)), f"secret:{name}")]
    return _with_errors(cleaned, checks).drop("given_counts")


def validate_external(batch: DataFrame, sizes: bool = False) -> tuple[DataFrame, DataFrame]:
    return split_valid(check_external(batch, sizes))


_MANUAL_ENUMS = {
    "severity": K.SEVERITIES,
    "vehicle_component": K.VEHICLE_PARTS,
    "attack_surface": K.VEHICLE_PARTS,
    "exploit_status": K.EXPLOIT_STATUSES,
    "confidence": K.CONFIDENCES,
    "risk_level": K.RISK_LEVELS,
    "status": K.RECORD_STATUSES,
}
_MANUAL_STRIPPED = (
    "title", "summary", "source_name", "source_url", "cwe_id", "cvss_vector", "affected_vendor", "affected_product",
    "affected_version",
)


def _manual_cleaning() -> dict[str, Column]:
    return {
        **{name: strip_to_null(name) for name in _MANUAL_STRIPPED},
        "cve_id": F.upper(F.trim("cve_id")),
        "cwe_id": F.upper(strip_to_null("cwe_id")),
    }


def _manual_checks(sizes: bool) -> list[Column]:
    checks = []
    if sizes:
        checks += [_when(F.length(name) > size, f"too_long:{name}") for name, size in K.MANUAL_TEXT_LIMITS.items()]
        checks += [
            _when(F.col("given_tags") > K.MANUAL_TAG_LIMIT, "too_many:tags"),
            _when(F.exists("tags", lambda tag: F.length(tag) > K.MANUAL_TAG_LENGTH), "too_long:tags"),
        ]
    checks += [
        _when(assigns(name, MANUAL_SENSITIVE_ASSIGNMENT), f"secret:{name}")
        for name in ("title", "summary", "source_name", "source_url")
    ]
    checks += [_when(~F.col(name).isin(*values), f"invalid:{name}") for name, values in _MANUAL_ENUMS.items()]
    return checks + [
        _when(F.length("title") < 3, "too_short:title"),
        _when(F.col("source_url").contains(" ") | ~F.col("source_url").contains("://"), "invalid:source_url"),
        _when(~F.col("cve_id").rlike(_CVE), "invalid:cve_id"),
        _when(~F.col("cvss_score").between(0, 10), "invalid:cvss_score"),
        _when(~F.col("risk_score").between(0, 100), "invalid:risk_score"),
        _when(F.exists("tags", lambda tag: assigns(tag, MANUAL_SENSITIVE_ASSIGNMENT)), "secret:tags"),
    ]


def check_manual(batch: DataFrame, sizes: bool = False) -> DataFrame:
    """Cleaned manual rows with the list of reasons why a row is refused; ``sizes`` as for external rows."""
    category = F.lower(strip_to_null("category"))
    defaults = {"severity": "unknown", "exploit_status": "unknown", "confidence": "medium", "risk_level": "info"}
    cleaned = batch.withColumns(
        {
            **_manual_cleaning(),
            **{name: F.coalesce(name, F.lit(value)) for name, value in defaults.items()},
            "category": F.coalesce(lookup(category, K.CATEGORY_ALIASES), category),
            "given_tags": F.size(F.coalesce("tags", F.array())),
            "tags": _clean_list("tags"),
        }
    )
    checks = _manual_checks(sizes) + [
        _when(F.col("title").isNull(), "missing:title"),
        _when(F.col("summary").isNull(), "missing:summary"),
        _when(F.col("category").isNull() | ~F.col("category").isin(*K.MANUAL_CATEGORIES), "invalid:category"),
        _when(F.col("source_name").isNull() & F.col("source_url").isNull(), "missing:source"),
    ]
    return _with_errors(cleaned, checks).drop("given_tags")


def validate_manual(batch: DataFrame, sizes: bool = False) -> tuple[DataFrame, DataFrame]:
    return split_valid(check_manual(batch, sizes))


PATCH_FIELDS = (*_MANUAL_STRIPPED, "cve_id", "cvss_score", "risk_score", "tags", *_MANUAL_ENUMS)


def check_patch(patches: DataFrame, sizes: bool = False) -> DataFrame:
    """Cleaned patch rows; a field counts only when it is listed in ``supplied``. ``sizes`` as for external rows."""
    given = patches.withColumns(
        {name: F.when(F.array_contains("supplied", name), F.col(name)) for name in PATCH_FIELDS}
    )
    cleaned = given.withColumns(
        {
            **_manual_cleaning(),
            "given_tags": F.size(F.coalesce("tags", F.array())),
            "tags": _clean_list("tags"),
        }
    )
    return _with_errors(cleaned, _manual_checks(sizes)).drop("given_tags")
