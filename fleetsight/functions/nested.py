"""Picking values out of nested feed entries, maps and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetsight.functions.text import col, none_if_blank

CPE_PART = {"vendor": 3, "product": 4, "version": 5}


def best_description(descriptions: Column | str) -> Column:
    filled = F.filter(col(descriptions), lambda item: none_if_blank(item["value"]).isNotNull())
    english = F.filter(filled, lambda item: item["lang"] == "en")
    return F.coalesce(F.get(english, F.lit(0))["value"], F.get(filled, F.lit(0))["value"])


def pick_cvss(metrics: Column | str) -> Column:
    """First entry of version 3.1, else 3.0, else 2, as one struct."""

    def reading(entries: Column) -> Column:
        first = F.get(entries, F.lit(0))
        data = first["cvssData"]
        return F.when(
            data.isNotNull(),
            F.struct(
                data["version"].alias("version"),
                data["baseScore"].alias("base_score"),
                F.coalesce(none_if_blank(data["baseSeverity"]), first["baseSeverity"]).alias("base_severity"),
                data["vectorString"].alias("vector_string"),
            ),
        )

    group = col(metrics)
    return F.coalesce(*[reading(group[name]) for name in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])


def cwe_list(weaknesses: Column | str) -> Column:
    values = F.flatten(
        F.transform(col(weaknesses), lambda item: F.transform(item["description"], lambda part: part["value"]))
    )
    found = F.array_distinct(F.filter(values, lambda value: value.startswith("CWE-")))
    return F.coalesce(found, F.array().cast("array<string>"))


def cpe_criteria(configurations: Column | str) -> Column:
    """All match criteria of an entry, in order."""
    nodes = F.flatten(F.transform(col(configurations), lambda item: item["nodes"]))
    return F.flatten(F.transform(nodes, lambda node: F.transform(node["cpeMatch"], lambda match: match["criteria"])))


def first_cpe_part(criteria: Column | str, part: str) -> Column:
    """First usable vendor, product or version; each part is looked up on its own."""
    names = F.filter(col(criteria), lambda text: text.startswith("cpe:"))
    parts = F.transform(names, lambda text: F.get(F.split(text, ":"), F.lit(CPE_PART[part])))
    return F.get(F.filter(parts, lambda text: text.isNotNull() & ~text.isin("*", "-", "")), F.lit(0))


def filled(values: Column | str) -> Column:
    """Members that are neither null nor empty; a null list counts as empty."""
    kept = F.filter(col(values), lambda value: value.isNotNull() & (value != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def unique_values(*arrays: Column | str) -> Column:
    """Concatenate, drop empties, keep first occurrences."""
    return F.array_distinct(F.concat(*[filled(array) for array in arrays]))


def sorted_tags(*arrays: Column | str) -> Column:
    return F.sort_array(unique_values(*arrays))


def is_empty(value: Column | str) -> Column:
    return col(value).isNull() | (col(value).cast("string") == "")


def first_key(metadata: Column | str, keys: Sequence[str]) -> Column:
    """Value of the first key that is present and filled."""
    return F.coalesce(*[none_if_blank(F.try_element_at(col(metadata), F.lit(key))) for key in keys])


SCORE_METADATA_KEYS = ("score_metadata", "scoring", "risk_scoring", "score")
SCORE_EXPLANATION_KEYS = ("score_explanation", "scoring_explanation", "risk_explanation", "explanation")


def score_metadata(metadata: Column | str) -> Column:
    """First of the four keys that holds a JSON object."""
    candidates = [F.try_element_at(col(metadata), F.lit(key)) for key in SCORE_METADATA_KEYS]
    return F.coalesce(*[F.when(value.startswith("{"), value) for value in candidates])


def score_explanation(metadata: Column | str) -> Column:
    """First of the four keys with text that is not sensitive; a JSON list is joined by ``; ``."""
    from fleetsight.functions.redact import safe_text

    readings = []
    for key in SCORE_EXPLANATION_KEYS:
        value = F.try_element_at(col(metadata), F.lit(key))
        members = F.from_json(F.when(value.startswith("["), value), "array<string>")
        joined = none_if_blank(F.array_join(F.filter(members, lambda item: item.isNotNull()), "; "))
        readings += [
            F.when(value.startswith("["), safe_text(joined)).when(
                ~value.startswith("{"), safe_text(value)
            )
        ]
    return F.coalesce(*readings)


def job_flag(metadata: Column | str, key: str) -> Column:
    """Boolean field of JSON job metadata; null when absent."""
    return F.get_json_object(col(metadata), f"$.{key}").try_cast("boolean")


def job_text(metadata: Column | str, key: str) -> Column:
    return F.get_json_object(col(metadata), f"$.{key}")


def job_int(metadata: Column | str, key: str) -> Column:
    return F.get_json_object(col(metadata), f"$.{key}").try_cast("int")
