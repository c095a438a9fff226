"""Normalisation, merging and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.operators import merge as M
from fleetsight.operators import normalize as N
from fleetsight.plans import fixtures as X
from fleetsight.plans.queries import Queries
from fleetsight.plans.queries.functions import _hint_sql
from fleetsight.plans.queries.sqltext import any_term, cte, normalized, squeeze
from fleetsight.session import scratch_folder
from fleetsight.sources.buckets import BucketTable

QUERIES = Queries()

_CVE = r"upper(nullif(regexp_extract({}, '(?i)\bCVE-\d{{4}}-\d{{4,}}\b', 0), ''))"
_CWE = r"upper(nullif(regexp_extract({}, '(?i)\bCWE-\d+\b', 0), ''))"
_FEED_JSON = """'{"feed_name":"Feed ' || source_id || '"}'"""
_KEV_JSON = (
    """'{"vendor_project":"Maker ' || (doc_id % 4) || '","product":"Gateway","date_added":"2024-03-01","due_date":null,"""
    """"known_ransomware_campaign_use":' || CASE WHEN doc_id % 24 = 3 THEN '"Known"' ELSE 'null' END || ',"cwes":"[\\"CWE-79\\",\\"CWE-80\\"]"}'"""
)

# The normalise stage for the raw view, one step per CTE.
NORMALIZED_SQL = (
    cte("raw")
    + f"""
    , mapped AS (SELECT *, summary AS snippet,
        CASE source_name WHEN 'nvd' THEN 'cve' WHEN 'cisa-kev' THEN 'kev' WHEN 'nhtsa-recalls' THEN 'recall'
             ELSE CASE source_type WHEN 'api' THEN 'fallback' WHEN 'rss' THEN 'rss' ELSE 'vendor' END END AS mapping,
        make_timestamp((1700000000 + doc_id * 60) * 1000000) AS fetched_at,
        lower(regexp_extract(source_url, '^(https://[^/]*)', 1)) || regexp_extract(source_url, '^https://[^/]*([^#]*)', 1) AS url
        FROM raw),
    texts AS (SELECT *, concat_ws(' ', title, coalesce(summary, ''), coalesce(snippet, ''), source_url, external_id) AS feed_text,
        concat_ws(' ', title, coalesce(summary, ''), coalesce(snippet, ''), source_url, {_FEED_JSON}) AS vendor_text,
        concat_ws(' ', title, coalesce(summary, ''), {_KEV_JSON}) AS kev_text, concat_ws(' ', title, coalesce(summary, ''), '') AS cve_text FROM mapped),
    found AS (SELECT *, {squeeze('title')} AS clean_title, nullif({squeeze('summary')}, '') AS clean_summary,
        CASE mapping WHEN 'recall' THEN NULL WHEN 'cve' THEN coalesce({_CVE.format('external_id')}, {_CVE.format('title')}, {_CVE.format('summary')})
             WHEN 'kev' THEN coalesce({_CVE.format('external_id')}, {_CVE.format('title')}, {_CVE.format('summary')})
             WHEN 'vendor' THEN {_CVE.format('vendor_text')} ELSE {_CVE.format('feed_text')} END AS cve_id,
        CASE mapping WHEN 'recall' THEN NULL WHEN 'cve' THEN NULL WHEN 'kev' THEN 'CWE-79' WHEN 'vendor' THEN {_CWE.format('vendor_text')}
             ELSE {_CWE.format('feed_text')} END AS cwe_id,
        ' ' || {normalized("CASE mapping WHEN 'cve' THEN cve_text WHEN 'kev' THEN kev_text WHEN 'vendor' THEN vendor_text WHEN 'recall' THEN concat_ws(' ', '', title, coalesce(nullif(" + squeeze('summary') + ", ''), '')) ELSE feed_text END")} || ' ' AS hint_text,
        {normalized("CASE mapping WHEN 'vendor' THEN vendor_text WHEN 'rss' THEN feed_text ELSE '' END")} AS exploit_text FROM texts),
    hashed AS (SELECT *, sha256({normalized("concat_ws(' ', clean_title, clean_summary, cve_id, cwe_id)")}) AS normalized_text_hash,
        CASE WHEN mapping = 'cve' AND cve_id IS NULL THEN 'no CVE id found in feed row' WHEN mapping = 'kev' AND cve_id IS NULL THEN 'no CVE id found in catalogue row' END AS problem
        FROM found),
    normal AS (SELECT *, CASE WHEN problem IS NOT NULL THEN NULL WHEN mapping = 'recall' THEN 'recall:campaign:' || external_id WHEN cve_id IS NOT NULL THEN 'cve:' || cve_id
             ELSE 'url:' || substring(sha256('{{"url":"' || url || '"}}'), 1, 48) END AS dedup_key,
        {_hint_sql('hint_text', K.COMPONENT_ORDER)} AS vehicle_component, {_hint_sql('hint_text', K.SURFACE_ORDER)} AS attack_surface,
        CASE WHEN mapping = 'kev' THEN 'exploited' WHEN {any_term('exploit_text', K.EXPLOITED_TERMS)} THEN 'exploited'
             WHEN {any_term('exploit_text', K.PROOF_TERMS)} THEN 'proof_of_concept' ELSE 'unknown' END AS exploit_status,
        CASE WHEN mapping IN ('cve', 'kev') THEN 'high' ELSE 'medium' END AS confidence,
        CASE WHEN mapping = 'recall' THEN 'incident' WHEN cve_id IS NOT NULL THEN 'vulnerability' ELSE 'advisory' END AS intelligence_type,
        CASE WHEN mapping = 'kev' THEN 'Maker ' || (doc_id % 4) END AS affected_vendor, CASE WHEN mapping = 'kev' THEN 'Gateway' END AS affected_product,
        CASE WHEN doc_id % 4 <> 0 THEN fetched_at - INTERVAL 2 DAY ELSE fetched_at END AS first_at,
        list_sort(list_filter(CASE mapping WHEN 'cve' THEN ['nvd', 'cve', lower(cve_id)] WHEN 'kev' THEN ['cisa-kev', 'kev', 'known_exploited', 'cve', lower(cve_id), 'cwe-79', CASE WHEN doc_id % 24 = 3 THEN 'ransomware_use' END]
             WHEN 'rss' THEN ['rss', 'feed', 'feed_' || source_id, lower(cve_id)] WHEN 'vendor' THEN ['vendor_advisory', lower(cve_id)]
             WHEN 'recall' THEN ['recall', 'nhtsa'] ELSE ['raw_fallback', lower(cve_id)] END, lambda x: x IS NOT NULL)) AS tags
        FROM hashed),
    good AS (SELECT * FROM normal WHERE problem IS NULL)
    """
)


def _normal(spark: SparkSession, folder: str) -> DataFrame:
    return N.normalize(X.raw(spark, folder))


def _good(spark: SparkSession, folder: str) -> DataFrame:
    return N.normalize_stage(X.raw(spark, folder))[0]


@QUERIES.add(
    "normalized_rows",
    NORMALIZED_SQL
    + """
    SELECT CAST(doc_id AS STRING) AS raw_id, mapping, clean_title AS title, sha256(clean_summary) AS summary_hash, intelligence_type, url, cve_id, cwe_id,
        affected_vendor, affected_product, vehicle_component, attack_surface, exploit_status, confidence, array_to_string(tags, '|') AS tag_text,
        normalized_text_hash, dedup_key, problem AS error_message, epoch_us(first_at) AS first_us FROM normal""",
)
def normalized_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _normal(spark, folder).select(
        F.col("raw_intelligence_id").alias("raw_id"),
        "mapping",
        "title",
        F.sha2("summary", 256).alias("summary_hash"),
        "intelligence_type",
        F.col("source_url").alias("url"),
        "cve_id",
        "cwe_id",
        "affected_vendor",
        "affected_product",
        "vehicle_component",
        "attack_surface",
        "exploit_status",
        "confidence",
        F.array_join("tags", "|").alias("tag_text"),
        "normalized_text_hash",
        "dedup_key",
        "error_message",
        F.unix_micros("first_seen_at").alias("first_us"),
    )


@QUERIES.add("normalizer_dispatch", NORMALIZED_SQL + "SELECT mapping, count(*) AS n, count(problem) AS failed FROM normal GROUP BY mapping")
def normalizer_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    return _normal(spark, folder).groupBy("mapping").agg(F.count(F.lit(1)).alias("n"), F.count("error_message").alias("failed"))


@QUERIES.add(
    "normalize_failures",
    NORMALIZED_SQL + "SELECT CAST(doc_id AS STRING) AS raw_id, problem AS error_message FROM normal WHERE problem IS NOT NULL",
)
def normalize_failures(spark: SparkSession, folder: str) -> DataFrame:
    failed = N.normalize_stage(X.raw(spark, folder))[1]
    return failed.select(F.col("raw_intelligence_id").alias("raw_id"), "error_message")


@QUERIES.add("pending_raw", cte("raw") + "SELECT id FROM raw WHERE processing_status IN ('pending', 'collected')")
def pending_raw(spark: SparkSession, folder: str) -> DataFrame:
    return N.pending(X.view(spark, folder, "raw")).select("id")


@QUERIES.add(
    "newest_pending_100",
    cte("raw") + "SELECT id FROM raw WHERE processing_status IN ('pending', 'collected') ORDER BY doc_id DESC LIMIT 100",
)
def newest_pending(spark: SparkSession, folder: str) -> DataFrame:
    return N.newest_pending(X.raw(spark, folder), 100).select("id")


@QUERIES.add(
    "processed_raw_status",
    NORMALIZED_SQL
    + """
    SELECT CASE WHEN r.processing_status = 'failed' THEN 'failed' WHEN n.problem IS NULL THEN 'normalized' ELSE 'failed' END AS processing_status, count(*) AS n
    FROM raw r JOIN normal n USING (doc_id) GROUP BY 1""",
)
def processed_raw_status(spark: SparkSession, folder: str) -> DataFrame:
    raw = X.raw(spark, folder)
    done = N.mark_processed(raw, N.normalize(N.pending(raw)))
    return done.groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))


def _first(name: str) -> str:
    return f"arg_min({name}, -doc_id) FILTER ({name} IS NOT NULL) AS {name}"


_STATUS_RANK = "CASE exploit_status WHEN 'exploited' THEN 3 WHEN 'proof_of_concept' THEN 2 WHEN 'none_known' THEN 1 ELSE 0 END"


@QUERIES.add(
    "merge_by_dedup_key",
    NORMALIZED_SQL
    + f"""
    SELECT dedup_key, arg_min(CAST(doc_id AS STRING), -doc_id) AS raw_id, arg_min(clean_title, -doc_id) AS title, sha256(arg_min(clean_summary, -doc_id) FILTER (clean_summary IS NOT NULL)) AS summary_hash,
        arg_min(intelligence_type, -doc_id) AS intelligence_type, arg_min(url, -doc_id) AS canonical_source_url, {_first('cve_id')}, {_first('cwe_id')}, {_first('affected_vendor')},
        {_first('affected_product')}, {_first('vehicle_component')}, {_first('attack_surface')}, arg_max(exploit_status, {_STATUS_RANK}) AS exploit_status,
        CASE WHEN bool_or(confidence = 'high') THEN 'high' ELSE 'medium' END AS confidence, epoch_us(min(first_at)) AS first_us, epoch_us(max(fetched_at)) AS last_us, count(*) AS rows_folded,
        max(CASE WHEN mapping = 'kev' THEN '2024-03-01' END) AS date_added
    FROM good GROUP BY dedup_key""",
)
def merge_by_dedup_key(spark: SparkSession, folder: str) -> DataFrame:
    merged = M.merge_scalars(_good(spark, folder))
    same = (
        "dedup_key", "title", "intelligence_type", "canonical_source_url", "cve_id", "cwe_id", "affected_vendor",
        "affected_product", "vehicle_component", "attack_surface", "exploit_status", "confidence", "rows_folded",
    )
    return merged.select(
        *same,
        F.col("raw_intelligence_id").alias("raw_id"),
        F.sha2("summary", 256).alias("summary_hash"),
        F.unix_micros("first_seen_at").alias("first_us"),
        F.unix_micros("last_seen_at").alias("last_us"),
        F.col("metadata")["date_added"].alias("date_added"),
    )


@QUERIES.add(
    "merged_values",
    NORMALIZED_SQL
    + """
    SELECT dedup_key, kind, name, value, -max(doc_id) AS first_order FROM (
        SELECT dedup_key, doc_id, 'source_name' AS kind, '' AS name, source_name AS value FROM good
        UNION ALL SELECT dedup_key, doc_id, 'source_url', '', url FROM good
        UNION ALL SELECT dedup_key, doc_id, 'tag', '', unnest(tags) FROM good
        UNION ALL SELECT dedup_key, doc_id, 'external_id', source_name, external_id FROM good
        UNION ALL SELECT dedup_key, doc_id, 'external_id', 'cve_id', cve_id FROM good WHERE cve_id IS NOT NULL
        UNION ALL SELECT dedup_key, doc_id, 'external_id', 'cwe_id', cwe_id FROM good WHERE cwe_id IS NOT NULL)
    GROUP BY dedup_key, kind, name, value""",
)
def merged_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = _good(spark, folder).withColumn("ord", M.fold_order())
    first_doc = F.col("first_at.ord.tie").cast("long")
    return M.record_values(rows).select("dedup_key", "kind", "name", "value", (-first_doc).alias("first_order"))


def records_sql(good: str) -> str:
    """The merged records of the normalised rows in ``good``."""
    return f"""
    , firsts AS (SELECT dedup_key, kind, value, max(doc_id) AS doc, min(spot) AS spot FROM (
        SELECT dedup_key, doc_id, 'name' AS kind, source_name AS value, 0 AS spot FROM {good} UNION ALL SELECT dedup_key, doc_id, 'url', url, 0 FROM {good}
        UNION ALL SELECT dedup_key, doc_id, 'tag', unnest(tags), unnest(generate_series(1, len(tags))) FROM {good}) GROUP BY dedup_key, kind, value),
    spots AS (SELECT f.dedup_key, f.kind, f.value, f.doc, CASE WHEN f.kind = 'tag' THEN list_position(g.tags, f.value) ELSE 0 END AS spot FROM firsts f JOIN {good} g ON g.doc_id = f.doc),
    lists AS (SELECT dedup_key, string_agg(value, '|' ORDER BY doc DESC) FILTER (kind = 'name') AS names, string_agg(value, '|' ORDER BY doc DESC) FILTER (kind = 'url') AS urls,
        string_agg(value, '|' ORDER BY doc DESC, spot) FILTER (kind = 'tag') AS tag_text FROM spots GROUP BY dedup_key),
    sizes AS (SELECT dedup_key, count(*) AS n, least(count(*) - 1, 20) AS n_sightings FROM {good} GROUP BY dedup_key)
    SELECT sha256('record:' || l.dedup_key) AS id, l.dedup_key, names, urls, tag_text, n_sightings FROM lists l JOIN sizes s ON s.dedup_key = l.dedup_key"""


@QUERIES.add("merged_records", NORMALIZED_SQL + records_sql("good"))
def merged_records(spark: SparkSession, folder: str) -> DataFrame:
    return record_rows(M.merge_records(_good(spark, folder)))


def record_rows(merged: DataFrame) -> DataFrame:
    """Records as the check compares them."""
    sightings = F.from_json(F.try_element_at("metadata", F.lit("sightings")), "array<string>")
    return merged.select(
        "id",
        "dedup_key",
        F.array_join("source_names", "|").alias("names"),
        F.array_join("source_urls", "|").alias("urls"),
        F.array_join("tags", "|").alias("tag_text"),
        F.coalesce(F.size(sightings), F.lit(0)).alias("n_sightings"),
    )


@QUERIES.add(
    "upsert_actions",
    NORMALIZED_SQL
    + """
    , old AS (SELECT DISTINCT dedup_key FROM good WHERE language <> 'en'), fresh AS (SELECT DISTINCT dedup_key FROM good WHERE language = 'en')
    SELECT coalesce(o.dedup_key, f.dedup_key) AS dedup_key, CASE WHEN o.dedup_key IS NULL THEN 'created' WHEN f.dedup_key IS NULL THEN 'unchanged' ELSE 'updated' END AS action
    FROM old o FULL OUTER JOIN fresh f ON f.dedup_key = o.dedup_key""",
)
def upsert_actions(spark: SparkSession, folder: str) -> DataFrame:
    """English documents merged into records made from the other languages."""
    raw = X.raw(spark, folder)
    language = raw.select(F.col("id").alias("raw_intelligence_id"), "language")
    rows = N.normalize_stage(raw)[0].join(language, "raw_intelligence_id")
    old = M.merge_records(rows.filter(F.col("language") != "en"))
    batch = rows.filter(F.col("language") == "en")
    return M.upsert_records(old, batch, F.lit("2024-03-01").cast("timestamp")).select("dedup_key", "action")


@QUERIES.add(
    "attributions",
    NORMALIZED_SQL
    + """
    SELECT sha256('record:' || dedup_key) AS threat_intelligence_id, url AS source_url, epoch_us(min(first_at)) AS first_us, arg_max(source_name, -doc_id) AS source_name,
        arg_max(external_id, -doc_id) AS external_id, epoch_us(arg_max(fetched_at, -doc_id)) AS last_us FROM good GROUP BY dedup_key, url""",
)
def attributions(spark: SparkSession, folder: str) -> DataFrame:
    return M.attributions(_good(spark, folder)).select(
        "threat_intelligence_id",
        "source_url",
        F.unix_micros("first_seen_at").alias("first_us"),
        "source_name",
        "external_id",
        F.unix_micros("last_seen_at").alias("last_us"),
    )


_LINK_SQL = """
    SELECT sha256('record:' || dedup_key) AS threat_intelligence_id, url AS source_url, epoch_us(min(first_at)) AS first_us, arg_max(source_name, ({order})) AS source_name,
        arg_max(external_id, ({order})) AS external_id, epoch_us(arg_max(fetched_at, ({order}))) AS last_us FROM {good} GROUP BY dedup_key, url"""


def links_sql(good: str, order: str) -> str:
    """Links of the rows in ``good``, with the other fields of the row that is last by ``order``."""
    return _LINK_SQL.format(good=good, order=order)


def link_columns(links: DataFrame) -> DataFrame:
    return links.select(
        "threat_intelligence_id",
        "source_url",
        F.unix_micros("first_seen_at").alias("first_us"),
        "source_name",
        "external_id",
        F.unix_micros("last_seen_at").alias("last_us"),
    )


@QUERIES.add("upsert_links", NORMALIZED_SQL + links_sql("good", "CASE WHEN language = 'en' THEN 1 ELSE 0 END, -doc_id"))
def upsert_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of the English documents put into the buckets of a table that holds those of the other languages."""
    raw = X.raw(spark, folder)
    language = raw.select(F.col("id").alias("raw_intelligence_id"), "language")
    rows = N.normalize_stage(raw)[0].join(language, "raw_intelligence_id")
    table = BucketTable(spark, scratch_folder(spark, "tables"), "threat_intelligence_sources")
    for number, english in enumerate((False, True)):
        batch = M.link_rows(rows.filter((F.col("language") == "en") == english))
        table.upsert(batch.select(M.link_id().alias("id")), lambda known, batch=batch: M.add_links(known, batch), str(number))
    return link_columns(table.read())
