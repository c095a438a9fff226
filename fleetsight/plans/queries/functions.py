"""Column functions over whole texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.functions import dates as D
from fleetsight.functions import keys as H
from fleetsight.functions import nested as N
from fleetsight.functions import redact as R
from fleetsight.functions import text as T
from fleetsight.functions import urls as U
from fleetsight.plans import fixtures as X
from fleetsight.plans.queries import Queries
from fleetsight.plans.queries.sqltext import any_term, cte, normalized, portable, quoted, sensitive, squeeze
from fleetsight.sources.tables import load

QUERIES = Queries()


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents")


def _hint_sql(text: str, order) -> str:
    whens = " ".join(f"WHEN {any_term(text, K.HINT_TERMS[part])} THEN {quoted(part)}" for part in order)
    return f"CASE {whens} END"


@QUERIES.add(
    "hint_classification",
    f"""
    WITH padded AS (SELECT doc_id, ' ' || {normalized('text')} || ' ' AS t FROM documents)
    SELECT doc_id, {_hint_sql('t', K.COMPONENT_ORDER)} AS vehicle_component, {_hint_sql('t', K.SURFACE_ORDER)} AS attack_surface
    FROM padded""",
)
def hint_classification(spark: SparkSession, folder: str) -> DataFrame:
    parts = _documents(spark, folder).select("doc_id", T.matching_parts("text").alias("parts"))
    return parts.select(
        "doc_id",
        T.first_component(F.col("parts")).alias("vehicle_component"),
        T.first_surface(F.col("parts")).alias("attack_surface"),
    )


@QUERIES.add(
    "exploit_status_from_text",
    f"""
    WITH n AS (SELECT doc_id, {normalized('text')} AS t FROM documents)
    SELECT doc_id, CASE WHEN {any_term('t', K.EXPLOITED_TERMS)} THEN 'exploited' WHEN {any_term('t', K.PROOF_TERMS)}
        THEN 'proof_of_concept' ELSE 'unknown' END AS exploit_status FROM n""",
)
def exploit_status(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", T.exploit_status_from_text("text").alias("exploit_status"))


@QUERIES.add("sensitive_documents", f"SELECT doc_id FROM documents WHERE {sensitive('text')}")
def sensitive_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).filter(R.looks_sensitive("text")).select("doc_id")


@QUERIES.add(
    "safe_text_hashes",
    f"SELECT doc_id, CASE WHEN {sensitive('text')} THEN NULL ELSE sha256(text) END AS safe_hash FROM documents",
)
def safe_text_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", H.sha256(R.safe_text("text")).alias("safe_hash"))


@QUERIES.add(
    "redacted_errors",
    f"""
    SELECT doc_id, regexp_replace(regexp_replace(text, {quoted(portable(R.ERROR_ASSIGNMENT))}, '[redacted]=[redacted]', 'g'),
        {quoted(portable(R.ERROR_WORD))}, '[redacted]', 'g') AS message FROM documents""",
)
def redacted_errors(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", R.sanitize_error("text").alias("message"))


@QUERIES.add(
    "text_hash_duplicates",
    f"""
    SELECT sha256({normalized('text')}) AS text_hash, count(*) AS copies, min(doc_id) AS first_doc
    FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def text_hash_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    hashed = _documents(spark, folder).select("doc_id", H.text_hash("text").alias("text_hash"))
    grouped = hashed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
    return grouped.filter(F.col("copies") > 1)


@QUERIES.add(
    "identifiers",
    cte("raw")
    + r"""
    SELECT doc_id, upper(nullif(regexp_extract(note, '(?i)\bCVE-\d{4}-\d{4,}\b', 0), '')) AS cve_id,
           upper(nullif(regexp_extract(note, '(?i)\bCWE-\d+\b', 0), '')) AS cwe_id
    FROM (SELECT doc_id, text || ' ' || lower(external_id) || ', cwe-' || (doc_id % 50) || '.' AS note FROM raw)""",
)
def identifiers(spark: SparkSession, folder: str) -> DataFrame:
    note = F.concat("text", F.lit(" "), F.lower("external_id"), F.lit(", cwe-"), F.col("doc_id") % 50, F.lit("."))
    return X.view(spark, folder, "raw").select("doc_id", T.extract_cve(note).alias("cve_id"), T.extract_cwe(note).alias("cwe_id"))


@QUERIES.add(
    "clean_texts",
    f"""
    SELECT doc_id, sha256({squeeze('text')}) AS cleaned, sha256({squeeze('text')}) AS title,
           sha256(text) AS snippet FROM documents""",
)
def clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select(
        "doc_id",
        H.sha256(T.clean_optional("text")).alias("cleaned"),
        H.sha256(T.clean_title("text")).alias("title"),
        H.sha256(T.snippet("text")).alias("snippet"),
    )


_TAG = f"replace({normalized('tag')}, ' ', '_')"


@QUERIES.add(
    "tag_sets",
    cte("records")
    + f"""
    SELECT id, tag_text, count(*) AS n FROM (
        SELECT DISTINCT id, {_TAG} AS tag_text FROM (SELECT id, unnest(['Fleet  Tag', tag_1, tag_2, cve_id, severity]) AS tag FROM records)
        WHERE tag IS NOT NULL) WHERE tag_text <> '' GROUP BY id, tag_text""",
)
def tag_sets(spark: SparkSession, folder: str) -> DataFrame:
    tags = T.compact_tags(F.lit("Fleet  Tag"), "tag_1", "tag_2", "cve_id", "severity")
    return (
        X.view(spark, folder, "records")
        .select("id", F.explode(tags).alias("tag_text"))
        .groupBy("id", "tag_text")
        .agg(F.count(F.lit(1)).alias("n"))
    )


_URL = r"'^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"


@QUERIES.add(
    "canonical_urls",
    f"""
    SELECT page_id, regexp_extract(url, {_URL}, 1) || '://' || lower(regexp_extract(url, {_URL}, 2)) ||
        CASE WHEN regexp_extract(url, {_URL}, 3) = '' THEN '/' ELSE regexp_extract(url, {_URL}, 3) END ||
        regexp_extract(url, {_URL}, 4) AS canonical FROM pages""",
)
def canonical_urls(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "pages").select("page_id", U.canonical_url("url").alias("canonical"))


@QUERIES.add(
    "url_dedup_key",
    f"""
    SELECT page_id, 'url:' || substring(sha256('{{"url":"' || regexp_replace(url, '#.*$', '') || '"}}'), 1, 48) AS dedup_key FROM pages""",
)
def url_dedup_key(spark: SparkSession, folder: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    key = H.record_key(nothing, F.col("url"), nothing, nothing, nothing, nothing)
    return load(spark, folder, "pages").select("page_id", key.alias("dedup_key"))


@QUERIES.add(
    "safe_urls",
    cte("sources") + "SELECT id, 'https://feed' || id || '.example.test/list?page=2' AS address FROM sources",
)
def safe_urls(spark: SparkSession, folder: str) -> DataFrame:
    return X.sources(spark, folder).select("id", U.safe_url("base_url").alias("address"))


_ADDRESS_PARTS = """regexp_replace(url, '[?#].*$', '') AS root, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site"""


@QUERIES.add(
    "resolved_links",
    f"""
    WITH p AS (SELECT page_id, url, {_ADDRESS_PARTS} FROM pages)
    SELECT page_id, regexp_replace(root, '[^/]*$', '') || 'a/c.html' AS dotted, site || '/top?x=1' AS rooted,
           regexp_extract(url, '^(https?):', 1) || '://cdn.example.test/y' AS other_host, root || '?q=2' AS same_path,
           'https://z.test/' AS absolute FROM p""",
)
def resolved_links(spark: SparkSession, folder: str) -> DataFrame:
    links = {
        "dotted": "./a/b/../c.html", "rooted": "/top?x=1", "other_host": "//cdn.example.test/y", "same_path": "?q=2",
        "absolute": "https://z.test/",
    }
    return load(spark, folder, "pages").select(
        "page_id", *[U.absolute_url("url", F.lit(href)).alias(name) for name, href in links.items()]
    )


@QUERIES.add(
    "parsed_times",
    """
    SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS parsed, CAST(o_orderdate AS DATE) AS day FROM orders""",
)
def parsed_times(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates written in six notations and read back."""
    orders = load(spark, folder, "orders")
    kind, when = F.col("o_orderkey") % 6, F.col("o_orderdate")
    text = (
        F.when(kind == 0, F.date_format(when, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(kind == 2, F.concat(F.lit("Mon, "), F.date_format(when, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(kind == 3, F.date_format(when, "MM/dd/yyyy"))
        .when(kind == 4, F.date_format(when, "yyyy/MM/dd"))
        .otherwise(F.concat(F.date_format(when + F.expr("INTERVAL 2 HOURS"), "d MMM yyyy HH:mm"), F.lit(" +0200")))
    )
    parsed = orders.select(F.col("o_orderkey").alias("id"), D.parse_when(text).alias("moment"))
    return parsed.select("id", D.iso_utc("moment").alias("parsed"), D.utc_day("moment").alias("day"))


@QUERIES.add(
    "score_levels",
    """
    SELECT o_orderkey AS id, round(least(greatest(o_totalprice / 4000 - 10, 0), 100), 2) AS score,
           CASE WHEN round(least(greatest(o_totalprice / 4000 - 10, 0), 100), 2) >= 90 THEN 'critical'
                WHEN round(least(greatest(o_totalprice / 4000 - 10, 0), 100), 2) >= 70 THEN 'high'
                WHEN round(least(greatest(o_totalprice / 4000 - 10, 0), 100), 2) >= 40 THEN 'medium' ELSE 'low' END AS level,
           o_totalprice AS number FROM orders""",
)
def score_levels(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders")
    score = D.bounded_score(F.col("o_totalprice") / 4000 - 10)
    return orders.select(F.col("o_orderkey").alias("id"), score.alias("score"), F.col("o_totalprice").cast("string").alias("t")).select(
        "id", "score", D.risk_level_for_score("score").alias("level"), D.float_or_none("t").alias("number")
    )


_RECORD_KEY_SQL = (
    cte("records")
    + """
    SELECT id,
        CASE WHEN cve_id IS NOT NULL THEN 'cve:' || cve_id
             WHEN id % 2 = 0 THEN 'url:' || substring(sha256('{"url":"' || url_2 || '"}'), 1, 48)
             WHEN id % 5 = 0 THEN 'content:h' || id
             WHEN id % 7 = 0 THEN 'text:t' || id
             ELSE 'title-source:' || substring(sha256('{"source_name":"' || lower(name_1) || '","title":"' || lower(trim(title)) || '"}'), 1, 48) END AS record_key,
        CASE WHEN cve_id IS NOT NULL THEN 'cve:' || cve_id
             WHEN id % 5 = 0 THEN 'external:' || substring(sha256('{"dedup_key":"k' || id || '"}'), 1, 48)
             WHEN id % 3 = 0 THEN 'external:' || substring(sha256('{"external_id":"x' || id || '","source_name":"' || name_1 || '"}'), 1, 48)
             ELSE 'text:t' || id END AS external_key,
        CASE WHEN cve_id IS NOT NULL THEN 'manual:cve:' || cve_id
             ELSE 'manual:' || intelligence_type || ':' || substring(sha256('{"category":"' || intelligence_type || '","source_name":"' || lower(name_1)
                  || '","source_url":"' || lower(url_1) || '","title":"' || lower(trim(title)) || '"}'), 1, 32) END AS manual_key
    FROM records"""
)


@QUERIES.add("dedup_keys", _RECORD_KEY_SQL)
def dedup_keys(spark: SparkSession, folder: str) -> DataFrame:
    """All three key rules over records with varying gaps."""
    frame = X.view(spark, folder, "records")
    number, nothing = F.col("id"), F.lit(None).cast("string")

    def when(divisor: int, value):
        return F.when(number % divisor == 0, value)

    def tagged(prefix: str):
        return F.concat(F.lit(prefix), number.cast("string"))

    untitled = (number % 5 == 0) | (number % 7 == 0)
    return frame.select(
        "id",
        H.record_key(
            F.col("cve_id"),
            when(2, F.col("url_2")),
            F.when(~untitled, F.col("title")),
            F.col("name_1"),
            when(5, tagged("h")),
            when(7, tagged("t")),
        ).alias("record_key"),
        H.external_key(
            F.col("cve_id"), when(5, tagged("k")), when(3, tagged("x")), F.col("name_1"), nothing, nothing, tagged("t")
        ).alias("external_key"),
        H.manual_key(F.col("intelligence_type"), F.col("cve_id"), F.col("title"), F.col("name_1"), F.col("url_1")).alias(
            "manual_key"
        ),
    )


@QUERIES.add(
    "job_metadata_reads",
    cte("jobs")
    + """
    SELECT id, json_extract_string(metadata, '$.run_status') AS run_status, CAST(json_extract_string(metadata, '$.attempts') AS INTEGER) AS attempts,
           CAST(json_extract_string(metadata, '$.retried') AS BOOLEAN) AS retried, CAST(json_extract_string(metadata, '$.skipped') AS BOOLEAN) AS skipped
    FROM jobs""",
)
def job_metadata_reads(spark: SparkSession, folder: str) -> DataFrame:
    return X.jobs(spark, folder).select(
        "id",
        N.job_text("metadata", "run_status").alias("run_status"),
        N.job_int("metadata", "attempts").alias("attempts"),
        N.job_flag("metadata", "retried").alias("retried"),
        N.job_flag("metadata", "skipped").alias("skipped"),
    )


@QUERIES.add(
    "redacted_metadata",
    cte("alerts")
    + f"""
    SELECT id, 'title' AS key, CASE WHEN {sensitive('title')} THEN NULL ELSE title END AS value FROM alerts
    UNION ALL SELECT id, 'notes', CASE WHEN {sensitive('notes')} THEN NULL ELSE notes END FROM alerts
    UNION ALL SELECT id, 'address', 'https://h.test/p?b=' || id FROM alerts""",
)
def redacted_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """A flat map with a sensitive key, an address with credentials and free text."""
    address = F.concat(F.lit("https://u:p@h.test/p?token=1&b="), F.col("id").cast("string"))
    metadata = F.create_map(
        F.lit("title"), F.col("title"), F.lit("notes"), F.col("notes"), F.lit("Api-Key"), F.lit("x"), F.lit("address"), address
    )
    return X.alerts(spark, folder).select("id", F.explode(R.safe_metadata(metadata)).alias("key", "value"))


@QUERIES.add(
    "redacted_payloads",
    cte("alerts")
    + f"""
    SELECT id, '{{"rule":"' || triggering_rule || '","nested":{{"at":"https://h.test/?b=1","list":["ok",null]}}}}' AS payload FROM alerts""",
)
def redacted_payloads(spark: SparkSession, folder: str) -> DataFrame:
    payload = F.concat(
        F.lit('{"rule":"'),
        "triggering_rule",
        F.lit('","access_token":{"x":1},"nested":{"at":"https://u:p@h.test/?secret=1&b=1","raw-body":1,"list":["ok","password: '),
        F.col("id").cast("string"),
        F.lit('"]}}'),
    )
    return X.alerts(spark, folder).select("id", R.safe_json(payload).alias("payload"))


@QUERIES.add(
    "internal_metadata_dropped",
    cte("jobs") + "SELECT id, 'attempts' AS key, CAST(id % 4 AS STRING) AS value FROM jobs",
)
def internal_metadata_dropped(spark: SparkSession, folder: str) -> DataFrame:
    metadata = F.map_concat(
        F.create_map(F.lit("attempts"), (F.col("id") % 4).cast("string")),
        F.create_map(F.lit("celery_broker-url"), F.lit("x"), F.lit("Redis-Url"), F.lit("y"), F.lit("cache"), F.lit(" REDIS://h/0")),
    )
    return X.jobs(spark, folder).select("id", F.explode(R.drop_internal(metadata)).alias("key", "value"))


@QUERIES.add(
    "software_related_parts",
    f"""
    SELECT p_partkey AS id, p_name || ' ' || p_type AS about FROM part
    WHERE p_size % 10 = 1 OR {any_term("lower(p_name || ' ' || p_type || CASE WHEN p_size % 7 = 0 THEN ' ECU' ELSE '' END)", K.RECALL_KEYWORDS)}""",
)
def software_related_parts(spark: SparkSession, folder: str) -> DataFrame:
    part = load(spark, folder, "part")
    about = F.concat(F.col("p_type"), F.when(F.col("p_size") % 7 == 0, F.lit(" ECU")).otherwise(F.lit("")))
    over_the_air = D.bool_value(F.when(F.col("p_size") % 10 == 1, F.lit(" Yes ")).otherwise(F.lit("no")))
    return part.filter(T.software_related(over_the_air, F.col("p_name"), about)).select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("about")
    )
