"""Search through inverted tables, fed in two batches, against plain search in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.operators import postings as P
from fleetsight.operators import search as S
from fleetsight.plans import fixtures as X
from fleetsight.plans.queries import Queries
from fleetsight.plans.queries.searching import _TEXT
from fleetsight.plans.queries.sqltext import cte
from fleetsight.session import scratch_folder
from fleetsight.sources.tables import load

QUERIES = Queries()

_FIELDS = ("title", "summary", "cve_id", "cwe_id", "affected_vendor", "affected_product", "array_to_string(tags, ' ')")
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\pL\pN\pM_\p{{Pc}}]+'), lambda x: x <> '')"
_ALL_TEXT = f"concat_ws(' ', {', '.join(_FIELDS)})"
# Plain, in tags, words in another order, too short for a gram, wildcards as text, no word at all, nothing to find.
_STRINGS = ("Auth Bypass", "cisa-kev", "bypass AUTH", "KE", "%_1", "-", "no such words")


def _index(spark: SparkSession, folder: str) -> P.SearchIndex:
    """Even ids first, then the odd ones."""
    index = P.SearchIndex(spark, scratch_folder(spark, "postings"))
    records, links = X.records(spark, folder), X.links(spark, folder)
    even, owner = F.col("id") % 2 == 0, F.col("threat_intelligence_id") % 2 == 0
    index.add("0", records.filter(even), links.filter(owner))
    index.add("1", records.filter(~even), links.filter(~owner | owner.isNull()))
    return index


def _matches(q: str) -> str:
    text = f"contains({_TEXT}, '{q.lower()}')"
    return f"({text} OR (len({_WORDS.format(repr(q))}) > 0 AND list_has_all({_WORDS.format(_ALL_TEXT)}, {_WORDS.format(repr(q))})))"


@QUERIES.add(
    "search_by_postings",
    rf"SELECT doc_id FROM documents WHERE list_has_all({_WORDS.format('text')}, ['the', 'is'])",
)
def search_by_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with both words: ids by postings of all texts, no text read in the search."""
    documents, out = load(spark, folder, "documents"), scratch_folder(spark, "postings")
    for batch, rows in (("0", documents.filter(F.col("doc_id") % 3 == 0)), ("1", documents.filter(F.col("doc_id") % 3 != 0))):
        P.add_batch(P.postings(rows, "doc_id", {P.WORD_KIND: {"text": F.col("text")}}), out, batch)
    return P.ids_with_all(P.read(spark, out), P.WORD_KIND, "The IS the").withColumnRenamed("id", "doc_id")


@QUERIES.add(
    "search_text_by_postings",
    cte("records") + " UNION ALL ".join(f"SELECT '{q}' AS q, id FROM records WHERE {_matches(q)}" for q in _STRINGS),
)
def search_text_by_postings(spark: SparkSession, folder: str) -> DataFrame:
    index, records, links = _index(spark, folder), X.records(spark, folder), X.links(spark, folder)
    found = [index.search(records, links, S.SearchParams(q=q)).select(F.lit(q).alias("q"), "id") for q in _STRINGS]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _can_match(q: str) -> str:
    grams = "[" + ", ".join(f"'{q.lower()[k : k + 3]}'" for k in range(len(q) - 2)) + "]"
    by_gram = " OR ".join(f"coalesce(list_bool_and(list_transform({grams}, lambda g: contains(lower({field}), g))), FALSE)" for field in _FIELDS)
    return f"({by_gram} OR {_matches(q)})" if len(q) > 2 else "TRUE"


@QUERIES.add(
    "postings_candidates",
    cte("records")
    + " UNION ALL ".join(
        f"SELECT '{q}' AS q, count(*) AS candidates, count(*) FILTER ({_matches(q)}) AS hits FROM records WHERE {_can_match(q)}" for q in _STRINGS
    ),
)
def postings_candidates(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(spark, folder)
    return index.counts(X.records(spark, folder), X.links(spark, folder), list(_STRINGS))


@QUERIES.add(
    "search_fields_by_postings",
    cte("records", "links")
    + """SELECT id FROM records WHERE contains(lower(affected_vendor), 'vendor-1') AND contains(lower(array_to_string(tags, ' ')), 'kev')
        AND (contains(lower(array_to_string(source_names, ' ')), 'ource 7') OR contains(lower(array_to_string(source_urls, ' ')), 'ource 7')
             OR contains(lower(canonical_source_url), 'ource 7') OR EXISTS (SELECT 1 FROM links l WHERE l.threat_intelligence_id = records.id
                 AND (contains(lower(l.source_name), 'ource 7') OR contains(lower(l.source_url), 'ource 7') OR contains(lower(l.external_id), 'ource 7'))))""",
)
def search_fields_by_postings(spark: SparkSession, folder: str) -> DataFrame:
    params = S.SearchParams(vendor="VENDOR-1", tag="KEV", source="ource 7")
    return _index(spark, folder).search(X.records(spark, folder), X.links(spark, folder), params).select("id")
