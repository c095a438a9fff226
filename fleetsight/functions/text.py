"""Text functions: normalisation, identifiers, hints and term tests."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from fleetsight import constants as K

# Unicode white space and the four separators next to it.
BLANK = r"\s\x1c-\x1f"
# Runs of blanks except a single space, which is what they become.
BLANKS = f"(?U)[{BLANK}&&[^ ]][{BLANK}]*| [{BLANK}]+"
EDGE_BLANKS = f"(?U)^[{BLANK}]+|[{BLANK}]+$"
CVE_PATTERN = r"(?iU)\bCVE-\d{4}-\d{4,}\b"
CWE_PATTERN = r"(?iU)\bCWE-\d+\b"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times.

    Conditional branches are not shared by the optimizer, so an expression that is tested
    against many terms would otherwise be computed once per term.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def none_if_blank(value: Column | str) -> Column:
    return F.nullif(col(value), F.lit(""))


def strip(value: Column | str) -> Column:
    """Without blanks at either end. The replacement looks at every character, so only text that begins or ends with one is sent there."""

    def stripped(text: Column) -> Column:
        ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
        return F.when(ends.rlike(f"(?U)[{BLANK}]"), F.regexp_replace(text, EDGE_BLANKS, "")).otherwise(text)

    return stripped(F.col(value)) if isinstance(value, str) else let(value, stripped)


def squeeze(value: Column | str) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(col(value).cast("string"), BLANKS, " "))


def normalize_text(value: Column | str) -> Column:
    return squeeze(F.lower(F.coalesce(col(value).cast("string"), F.lit(""))))


def clean_optional(value: Column | str) -> Column:
    return none_if_blank(squeeze(value))


def first_text(*values: Column | str) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[none_if_blank(value) for value in values])


def at_most(value: Column, length: int | None) -> Column:
    """The first ``length`` characters; all of them without a length."""
    return value if length is None else F.substring(value, 1, length)


def clean_title(*values: Column | str, length: int | None = None) -> Column:
    """Null when there is nothing to use as a title; callers treat that as an error."""
    return at_most(clean_optional(first_text(*values)), length)


def snippet(value: Column | str, length: int | None = None) -> Column:
    return none_if_blank(at_most(col(value), length))


def join_text(*values: Column | str) -> Column:
    """Blank-joined text in which a null counts as empty, so blanks are kept."""
    return F.concat_ws(" ", *[F.coalesce(col(value).cast("string"), F.lit("")) for value in values])


def _identifier(value: Column | str, prefix: str, pattern: str) -> Column:
    """The first match in upper case. The pattern runs on text with the prefix in it only, as most has none."""
    text = col(value).cast("string")
    return F.upper(none_if_blank(F.when(F.contains(F.lower(text), F.lit(prefix)), F.regexp_extract(text, pattern, 0))))


def extract_cve(value: Column | str) -> Column:
    return _identifier(value, "cve-", CVE_PATTERN)


def find_cve(*values: Column | str) -> Column:
    return F.coalesce(*[extract_cve(value) for value in values])


def extract_cwe(value: Column | str) -> Column:
    return _identifier(value, "cwe-", CWE_PATTERN)


def extract_cwe_from_list(values: Column | str) -> Column:
    hits = F.filter(F.transform(col(values), extract_cwe), lambda hit: hit.isNotNull())
    return F.get(hits, F.lit(0))


def literal_list(values: Iterable[str]) -> Column:
    """Constant array; folded to a literal when the query is optimized."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True when one of the terms occurs in already normalised text.

    A loop over a constant list, not a chain of ORs: long chains make generated methods too
    large for the JIT compiler.
    """
    return let(text, lambda held: F.exists(literal_list(terms), lambda term: F.contains(held, term)))


def matching_parts(text: Column | str) -> Column:
    """Vehicle parts with a term in the text, in component order. Each term is looked for once.

    A blank on either side lets terms anchor on words.
    """
    table = F.array(
        *[F.struct(F.lit(part).alias("part"), literal_list(K.HINT_TERMS[part]).alias("terms")) for part in K.COMPONENT_ORDER]
    )

    def hits(padded: Column) -> Column:
        found = F.filter(table, lambda row: F.exists(row["terms"], lambda term: F.contains(padded, term)))
        return F.transform(found, lambda row: row["part"])

    return let(F.concat(F.lit(" "), normalize_text(text), F.lit(" ")), hits)


def first_component(parts: Column) -> Column:
    return F.get(parts, F.lit(0))


def first_surface(parts: Column) -> Column:
    """The surface order differs from the component order."""
    return F.get(F.array_intersect(literal_list(K.SURFACE_ORDER), parts), F.lit(0))


def infer_component(*values: Column | str) -> Column:
    return first_component(matching_parts(join_text(*values)))


def infer_surface(*values: Column | str) -> Column:
    return first_surface(matching_parts(join_text(*values)))


def exploit_status_from_text(*values: Column | str) -> Column:
    return let(
        normalize_text(join_text(*values)),
        lambda text: F.when(contains_any(text, K.EXPLOITED_TERMS), F.lit("exploited"))
        .when(contains_any(text, K.PROOF_TERMS), F.lit("proof_of_concept"))
        .otherwise(F.lit("unknown")),
    )


def ransomware_tag(value: Column | str) -> Column:
    return F.when(normalize_text(value).isin(*K.RANSOMWARE_WORDS), F.lit("ransomware_use"))


def tag_text(value: Column | str, length: int | None = None) -> Column:
    return at_most(F.replace(normalize_text(value), F.lit(" "), F.lit("_")), length)


def compact_tags(*values: Column | str, more: Iterable[Column] = ()) -> Column:
    """Sorted distinct tags. ``more`` takes array columns of further tags."""
    arrays = [F.array(*[col(value).cast("string") for value in values])]
    arrays += [F.coalesce(extra, F.array().cast("array<string>")) for extra in more]
    tags = F.transform(F.concat(*arrays), lambda tag: tag_text(tag))
    return F.array_sort(F.array_distinct(F.filter(tags, lambda tag: tag != "")))


def lookup(value: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Value of a small fixed table; the key is evaluated once."""
    entries = [F.lit(cell) for pair in table.items() for cell in pair]
    found = F.try_element_at(F.create_map(*entries), value)
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_value(value: Column | str) -> Column:
    return lookup(normalize_text(value), {name: name for name in K.SEVERITIES}, "unknown")


def risk_level_from_severity(severity: Column | str) -> Column:
    return lookup(col(severity), K.SEVERITY_TO_RISK, "info")


def category_to_type(category: Column | str) -> Column:
    return lookup(col(category), K.CATEGORY_TYPES, "advisory")


def cvss_metric(vector: Column | str, key: str) -> Column:
    return none_if_blank(F.regexp_extract(F.upper(col(vector)), rf"(?:^|/){key}:([A-Z])(?:/|$)", 1))


def scoring_key(value: Column | str) -> Column:
    return F.translate(normalize_text(value), "-", "_")


def alert_key(value: Column | str) -> Column:
    """Trim, lower and fold hyphens; inner white space is kept."""
    trimmed = strip(F.coalesce(col(value).cast("string"), F.lit("")))
    return F.translate(F.lower(trimmed), "-", "_")


def default_source_name(name: Column | str, url: Column | str) -> Column:
    host = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.coalesce(none_if_blank(name), none_if_blank(host), F.lit("Manual Entry"))


def default_source_url(url: Column | str, name: Column | str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(name))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(none_if_blank(url), F.concat(F.lit("manual://"), F.coalesce(none_if_blank(slug), F.lit("entry"))))


def software_related(over_the_air: Column, component: Column | str, summary: Column | str) -> Column:
    text = F.lower(join_text(component, summary))
    return F.coalesce(over_the_air, F.lit(False)) | contains_any(text, K.RECALL_KEYWORDS)


def contains_ignoring_case(value: Column | str, needle: str) -> Column:
    """Substring test without wildcards, so nothing needs escaping."""
    return F.coalesce(F.contains(F.lower(col(value)), F.lit(needle.lower())), F.lit(False))


# The two helpers below are nested functions so that they travel to the executors by value:
# workers need only the standard library and pandas, not this package.
def _entity_decoder():
    def decode(text: pd.Series) -> pd.Series:
        return text.map(html.unescape, na_action="ignore")

    return F.pandas_udf(decode, StringType())


def _entity_list_decoder():
    def decode(lists: pd.Series) -> pd.Series:
        return lists.map(lambda members: [html.unescape(text) for text in members], na_action="ignore")

    return F.pandas_udf(decode, ArrayType(StringType()))


def unescape_entities(value: Column | str) -> Column:
    """Decode HTML entities; only text that holds an ampersand leaves the JVM."""
    text = col(value)
    return F.coalesce(_entity_decoder()(F.when(text.contains("&"), text)), text)


def unescape_each(values: Column) -> Column:
    """Decode entities in every member; only lists with an ampersand leave the JVM."""
    coded = F.exists(values, lambda text: text.contains("&"))
    return F.coalesce(_entity_list_decoder()(F.when(coded, values)), values)


def strip_markup(value: Column | str) -> Column:
    """Tags to blanks, then entities decoded, then white space collapsed."""
    return squeeze(unescape_entities(F.regexp_replace(col(value), "<[^>]+>", " ")))
