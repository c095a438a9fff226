"""Feed readers over payloads that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight import schema
from fleetsight.operators import normalize as N
from fleetsight.operators import raw_upsert as U
from fleetsight.plans import fixtures as X
from fleetsight.plans.queries import Queries
from fleetsight.plans.queries.sqltext import any_term, cte, quoted, squeeze
from fleetsight.sources import batches, cve, envelope, feeds, kev, pages, recalls
from fleetsight.sources.tables import load, parts_for

QUERIES = Queries()
FETCHED = "2024-06-01 00:00:00"


def template(text: str) -> Column:
    """Text with ``{{expression}}`` places filled in; null counts as empty."""
    parts, rest = [], text
    while "{{" in rest:
        head, _, tail = rest.partition("{{")
        name, _, rest = tail.partition("}}")
        parts += [F.lit(head), F.coalesce(F.expr(name).cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def landed(frame: DataFrame, payload: Column) -> DataFrame:
    return frame.select(
        payload.alias("payload"), F.lit("https://landing.test/page").alias("url"), F.lit(FETCHED).cast("timestamp").alias("fetched_at")
    )


_CVE_PAGE = (
    '{"resultsPerPage":1,"vulnerabilities":[{"cve":{"id":"CVE-2024-{{10000 + id}}","published":"2024-0{{1 + id % 9}}-01T00:00:00.000",'
    '"lastModified":"2024-05-0{{1 + id % 9}}T10:00:00.000","vulnStatus":"Analyzed","descriptions":[{"lang":"es","value":"hola"},{"lang":"en","value":"{{title}}"}],'
    '"metrics":{"cvssMetricV{{CASE WHEN id % 3 = 0 THEN \'31\' WHEN id % 3 = 1 THEN \'30\' ELSE \'2\' END}}":[{"cvssData":{"version":"x","baseScore":{{cvss_score}}.5,'
    '"vectorString":"AV:N"},"baseSeverity":"HIGH"}]},"weaknesses":[{"description":[{"lang":"en","value":"NVD-CWE-noinfo"},{"lang":"en","value":"CWE-{{id % 90}}"}]}],'
    '"references":{"referenceData":[{"url":"https://poc.test/{{id}}"}]},'
    '"configurations":[{"nodes":[{"cpeMatch":[{"criteria":"cpe:2.3:o:*:gw:*:*"},{"criteria":"cpe:2.3:o:acme:gw{{id % 7}}:1.{{id % 5}}:*"}]}]}]}}]}'
)


def _cve_raw(spark: SparkSession, folder: str) -> DataFrame:
    rows = X.view(spark, folder, "records").withColumn("cvss_score", F.col("id") % 9)
    return cve.cve_items(cve.parse_pages(landed(rows, template(_CVE_PAGE)), schema.CVE_PAGE))


@QUERIES.add(
    "read_cve_feed",
    cte("records")
    + """
    SELECT 'CVE-2024-' || (10000 + id) AS external_id, 'CVE-2024-' || (10000 + id) || ' - ' || title AS title, title AS summary, 'https://nvd.nist.gov/vuln/detail/CVE-2024-' || (10000 + id) AS source_url,
        epoch_us(make_timestamp(2024, CAST(1 + id % 9 AS INTEGER), 1, 0, 0, 0)) AS first_us, (id % 9) + 0.5 AS base_score, 'HIGH' AS severity, '["CWE-' || (id % 90) || '"]' AS cwe, '1' AS reference_count,
        'collected' AS processing_status, 'raw_payload' AS retained FROM records""",
)
def read_cve_feed(spark: SparkSession, folder: str) -> DataFrame:
    metadata = F.col("metadata")
    return _cve_raw(spark, folder).select(
        "external_id",
        "title",
        "summary",
        "source_url",
        F.unix_micros("first_seen_at").alias("first_us"),
        F.get_json_object(metadata["cvss"], "$.base_score").cast("double").alias("base_score"),
        F.get_json_object(metadata["cvss"], "$.base_severity").alias("severity"),
        metadata["cwe"].alias("cwe"),
        metadata["reference_count"].alias("reference_count"),
        "processing_status",
        F.col("retained_payload_mode").alias("retained"),
    )


@QUERIES.add(
    "cve_feed_normalized",
    cte("records")
    + """
    SELECT 'cve:CVE-2024-' || (10000 + id) AS dedup_key, 'acme' AS affected_vendor, 'gw' AS affected_product, '1.' || (id % 5) AS affected_version, (id % 9) + 0.5 AS cvss_score,
        'CWE-' || (id % 90) AS cwe_id, 'high' AS severity, 'proof_of_concept' AS exploit_status, 'high' AS confidence FROM records""",
)
def cve_feed_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return N.normalize(_cve_raw(spark, folder)).select(
        "dedup_key", "affected_vendor", "affected_product", "affected_version", "cvss_score", "cwe_id", "severity", "exploit_status", "confidence"
    )


@QUERIES.add(
    "cve_feed_window",
    cte("records") + "SELECT 'CVE-2024-' || (10000 + id) AS external_id FROM records WHERE id % 9 >= 4",
)
def cve_feed_window(spark: SparkSession, folder: str) -> DataFrame:
    at = F.lit("2024-05-05T00:00:00").cast("timestamp")
    return cve.in_window(_cve_raw(spark, folder), at, F.lit("2024-06-01").cast("timestamp")).select("external_id")


_KEV_PAGE = (
    '{"vulnerabilities":[{"cveID":" CVE-2024-{{10000 + id}} ","vendorProject":"{{CASE WHEN id % 4 <> 0 THEN affected_vendor END}}","product":"{{affected_product}}",'
    '"vulnerabilityName":"{{CASE WHEN id % 6 <> 0 THEN title END}}","dateAdded":"2024-03-{{10 + id % 19}}","knownRansomwareCampaignUse":"{{CASE WHEN id % 2 = 0 THEN \'Known\' ELSE \'Unknown\' END}}",'
    '"notes":"{{CASE WHEN id % 3 = 0 THEN concat(\'see \', id) END}}","cwes":{{CASE WHEN id % 2 = 0 THEN \'["CWE-1","CWE-2"]\' ELSE \'"CWE-3; CWE-4"\' END}}}]}'
)


def _kev_raw(spark: SparkSession, folder: str) -> DataFrame:
    rows = X.view(spark, folder, "records")
    return kev.kev_items(cve.parse_pages(landed(rows, template(_KEV_PAGE)), schema.KEV_PAGE))


@QUERIES.add(
    "read_kev",
    cte("records")
    + """
    , k AS (SELECT id, 'CVE-2024-' || (10000 + id) AS cve, CASE WHEN id % 6 <> 0 THEN trim(title) ELSE 'CVE-2024-' || (10000 + id) END AS name,
        coalesce(CASE WHEN id % 4 <> 0 THEN affected_vendor END, 'Unknown vendor') AS vendor, affected_product AS product FROM records)
    SELECT cve AS external_id, cve || ' - ' || name AS title, vendor || ' ' || product || ': ' || name || CASE WHEN id % 3 = 0 THEN '. see ' || id ELSE '' END AS summary,
        epoch_us(make_timestamp(2024, 3, CAST(10 + id % 19 AS INTEGER), 0, 0, 0)) AS first_us, CASE WHEN id % 2 = 0 THEN '["CWE-1","CWE-2"]' ELSE '["CWE-3","CWE-4"]' END AS cwes FROM k""",
)
def read_kev(spark: SparkSession, folder: str) -> DataFrame:
    return _kev_raw(spark, folder).select(
        "external_id", "title", "summary", F.unix_micros("first_seen_at").alias("first_us"), F.col("metadata")["cwes"].alias("cwes")
    )


def _broken_pages(rows: DataFrame, payload: Column, broken: str) -> DataFrame:
    """Landed pages, each with its own address; every seventh ends in the middle."""
    cut = F.when(F.col("id") % 7 == 0, F.concat(F.lit(broken), "title")).otherwise(payload)
    return rows.select(
        cut.alias("payload"),
        F.concat(F.lit("https://landing.test/"), "id").alias("url"),
        F.lit(FETCHED).cast("timestamp").alias("fetched_at"),
    )


def _broken_sql(external_id: str, address: str) -> str:
    return cte("records") + f"""
    SELECT CASE WHEN id % 7 <> 0 THEN {external_id} ELSE {{}} END AS external_id,
        CASE WHEN id % 7 <> 0 THEN {address} ELSE 'https://landing.test/' || id END AS source_url,
        CASE WHEN id % 7 = 0 THEN 'page does not parse' END AS error_message FROM records"""


@QUERIES.add("cve_pages_that_do_not_parse", _broken_sql("'CVE-2024-' || (10000 + id)", "'https://nvd.nist.gov/vuln/detail/CVE-2024-' || (10000 + id)").format("NULL"))
def cve_pages_that_do_not_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = X.view(spark, folder, "records").withColumn("cvss_score", F.col("id") % 9)
    pages_ = cve.parse_pages(_broken_pages(rows, template(_CVE_PAGE), '{"vulnerabilities":[{"cve":"'), schema.CVE_PAGE)
    return cve.cve_items(pages_).select("external_id", "source_url", "error_message")


@QUERIES.add("kev_cursor", "SELECT '2024-03-' || max(10 + o_orderkey % 19) AS latest_date_added FROM orders")
def kev_cursor(spark: SparkSession, folder: str) -> DataFrame:
    return kev.latest_date_added(_kev_raw(spark, folder))


_RSS = (
    "<rss xmlns='http://x.test'><channel><title>c</title><item><title>{{title}} &amp;amp; &lt;b&gt;more&lt;/b&gt;</title><link>https://f.test/{{id}}</link>"
    "<guid isPermaLink='false'>{{CASE WHEN id % 2 = 0 THEN concat('g-', id) END}}</guid><description><![CDATA[<p>Body  {{id}}</p>]]></description>"
    "<pubDate>Mon, {{10 + id % 19}} Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>"
)
_ATOM = (
    "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title type='html'>{{title}}</title><link rel='self' href='https://self.test'/><link href='https://f.test/{{id}}?a=1&amp;copy=2'/>"
    "<id>urn:{{id}}</id><content>Text {{id}}</content><updated>2024-01-{{10 + id % 19}}T10:00:00Z</updated></entry></feed>"
)


@QUERIES.add(
    "read_feeds",
    cte("records")
    + """
    SELECT CASE WHEN id % 3 = 0 THEN 'https://f.test/' || id || '?a=1&copy=2' ELSE 'https://f.test/' || id END AS source_url,
        CASE WHEN id % 3 = 0 THEN 'urn:' || id WHEN id % 2 = 0 THEN 'g-' || id ELSE 'https://f.test/' || id END AS external_id,
        CASE WHEN id % 3 = 0 THEN trim(title) ELSE trim(title) || ' & more' END AS title, CASE WHEN id % 3 = 0 THEN 'Text ' || id ELSE 'Body ' || id END AS summary,
        epoch_us(make_timestamp(2024, 1, CAST(10 + id % 19 AS INTEGER), 10, 0, 0)) AS first_us, 'Feed' AS feed_name FROM records""",
)
def read_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """RSS with a namespace for most records, Atom for every third."""
    rows = X.view(spark, folder, "records")
    payload = F.when(F.col("id") % 3 == 0, template(_ATOM)).otherwise(template(_RSS))
    named = landed(rows, payload).withColumns({"feed_name": F.lit("Feed"), "feed_url": F.lit("https://f.test/feed")})
    return feeds.feed_items(named).select(
        "source_url", "external_id", "title", "summary", F.unix_micros("first_seen_at").alias("first_us"), F.col("metadata")["feed_name"].alias("feed_name")
    )


@QUERIES.add("feeds_that_do_not_parse", _broken_sql("'urn:' || id", "'https://f.test/' || id || '?a=1&copy=2'").format("'https://landing.test/' || id"))
def feeds_that_do_not_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = X.view(spark, folder, "records")
    named = _broken_pages(rows, template(_ATOM), "<feed><entry><title>").withColumns({"feed_name": F.lit("Feed"), "feed_url": F.lit("https://f.test/feed")})
    return feeds.feed_items(named).select("external_id", "source_url", "error_message")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "pages")


def _entities(text: str) -> str:
    plain = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    decoded = f"replace(replace(replace({plain}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')"
    return squeeze(f"regexp_replace({decoded}, '&amp;?', '&', 'g')")


@QUERIES.add(
    "page_metadata",
    f"""
    SELECT page_id, nullif({_entities("regexp_extract(html, " + quoted(pages.TITLE) + ", 1)")}, '') AS title, nullif({_entities("regexp_extract(html, " + quoted(pages.HEADING) + ", 1)")}, '') AS heading,
        CAST(NULL AS STRING) AS description, CAST(NULL AS STRING) AS canonical_url, sha256(html) AS content_hash FROM pages""",
)
def page_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_metadata(_pages(spark, folder)).select(
        "page_id", "title", "heading", "description", "canonical_url", "content_hash"
    )


_LINKS = f"""
    WITH found AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site, regexp_extract_all(html, {quoted(pages.LINK)}, 1) AS hrefs,
        regexp_extract_all(html, {quoted(pages.LINK)}, 2) AS labels FROM pages),
    links AS (SELECT page_id, site, unnest(hrefs) AS href, unnest(labels) AS label, unnest(generate_series(0, len(hrefs) - 1)) AS position FROM found)"""


@QUERIES.add(
    "page_links",
    _LINKS + f"SELECT page_id, position, lower(site) || replace(href, '&amp;', '&') AS link_url, {_entities('label')} AS link_text FROM links",
)
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_links(_pages(spark, folder), "page_id").select("page_id", "position", "link_url", "link_text")


@QUERIES.add(
    "advisory_links",
    """
    WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site FROM pages)
    SELECT page_id, 0 AS position, site || '/docs/sb-' || page_id || '.pdf' AS link_url, 'PSIRT & bulletin' AS link_text, TRUE AS is_pdf FROM p
    UNION ALL SELECT page_id, 1, site || '/list?kind=cve-list', 'All', FALSE FROM p""",
)
def advisory_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every page gets two advisory links and one that is none beside its own."""
    extra = template(
        '<A class="x" HREF="/a/../docs/sb-{{page_id}}.pdf"><b>PSIRT</b> &amp; bulletin</a><a href="/list?kind=cve-list">All</a><a href="/about">About</a></body>'
    )
    with_links = _pages(spark, folder).withColumn("html", F.concat("html", extra))
    return pages.advisory_links(with_links, "page_id").select("page_id", "position", "link_url", "link_text", "is_pdf")


@QUERIES.add(
    "vendor_page_rows",
    """
    SELECT source_type, parsing_status, retained, count(*) AS n, count(summary) AS summaries FROM (
        SELECT 'vendor' AS source_type, 'pending' AS parsing_status, 'metadata_only' AS retained, CASE WHEN html <> '' THEN 'x' END AS summary FROM pages) GROUP BY ALL""",
)
def vendor_page_rows(spark: SparkSession, folder: str) -> DataFrame:
    empty = F.lit(None).cast("string")
    endpoints = _pages(spark, folder).withColumns(
        {
            "vendor": F.lit("Acme"), "endpoint_url": F.col("url"), "verification_status": F.lit("verified"), "endpoint_type": empty,
            "http_status": F.lit(200), "content_type": F.lit("text/html"), "fetched_at": F.lit(FETCHED).cast("timestamp"),
        }
    )
    return (
        pages.vendor_items(endpoints)
        .groupBy("source_type", "parsing_status", F.col("retained_payload_mode").alias("retained"))
        .agg(F.count(F.lit(1)).alias("n"), F.count("summary").alias("summaries"))
    )


_RECALL = (
    '{"NHTSACampaignNumber":"24V{{p_partkey % 700}}","ReportReceivedDate":"{{10 + p_partkey % 19}}/02/2024","Component":"{{p_type}}",'
    '"Summary":"{{p_name}}{{CASE WHEN p_size % 3 = 0 THEN \' ECU\' END}}","Conequence":"none","OverTheAirUpdate":{{p_size % 10 = 1}},"Manufacturer":"{{p_brand}}"}'
)
_RECALL_SQL = f"""
    WITH parts AS (SELECT *, '24V' || (p_partkey % 700) AS campaign, p_name || CASE WHEN p_size % 3 = 0 THEN ' ECU' ELSE '' END AS about FROM part),
    wanted AS (SELECT * FROM parts WHERE p_size % 10 = 1 OR {any_term("lower(p_type || ' ' || about)", K.RECALL_KEYWORDS)}),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY p_brand, p_name, 2020 + p_size % 4, p_partkey) AS rn FROM wanted) WHERE rn = 1)"""


def _recall_pages(spark: SparkSession, folder: str) -> DataFrame:
    part = load(spark, folder, "part")
    return part.select(
        F.col("p_brand").alias("make"),
        F.col("p_name").alias("model"),
        (F.lit(2020) + F.col("p_size") % 4).alias("model_year"),
        F.lit("https://landing.test/recalls").alias("url"),
        F.lit(FETCHED).cast("timestamp").alias("fetched_at"),
        F.array(template(_RECALL)).alias("Results"),
    )


@QUERIES.add(
    "read_recalls",
    _RECALL_SQL
    + """
    SELECT campaign AS external_id, count(*) AS n FROM firsts GROUP BY campaign""",
)
def read_recalls(spark: SparkSession, folder: str) -> DataFrame:
    raw = recalls.recall_items(_recall_pages(spark, folder))
    return raw.groupBy("external_id").agg(F.count(F.lit(1)).alias("n"))


@QUERIES.add(
    "recalls_not_seen",
    _RECALL_SQL + "SELECT campaign AS external_id FROM firsts WHERE campaign NOT IN (SELECT '24V' || (p_partkey % 700) FROM part WHERE p_size = 3)",
)
def recalls_not_seen(spark: SparkSession, folder: str) -> DataFrame:
    seen = load(spark, folder, "part").filter(F.col("p_size") == 3).select(template("24V{{p_partkey % 700}}").alias("campaign"))
    return recalls.recall_items(_recall_pages(spark, folder), seen=seen).select("external_id")


@QUERIES.add(
    "recalls_that_do_not_parse",
    _RECALL_SQL
    + """
    SELECT DISTINCT campaign AS external_id, CAST(NULL AS VARCHAR) AS page, CAST(NULL AS VARCHAR) AS error_message FROM wanted WHERE p_partkey % 7 <> 0
    UNION ALL SELECT NULL, 'https://landing.test/' || p_partkey, 'page does not parse' FROM part WHERE p_partkey % 7 = 0""",
)
def recalls_that_do_not_parse(spark: SparkSession, folder: str) -> DataFrame:
    part = load(spark, folder, "part").withColumn("id", F.col("p_partkey"))
    whole = F.concat(F.lit('{"Count":1,"Results":['), template(_RECALL), F.lit("]}"))
    cut = F.when(F.col("id") % 7 == 0, F.concat(F.lit('{"Count":1,"Results":["'), "p_name")).otherwise(whole)
    pages_ = part.select(
        F.col("p_brand").alias("make"),
        F.col("p_name").alias("model"),
        (F.lit(2020) + F.col("p_size") % 4).alias("model_year"),
        F.concat(F.lit("https://landing.test/"), "id").alias("url"),
        F.lit(FETCHED).cast("timestamp").alias("fetched_at"),
        F.inline(F.array(F.from_json(cut, schema.RECALL_PAGE))),
    )
    page = F.when(F.col("error_message").isNotNull(), F.col("source_url"))
    return recalls.recall_items(pages_).select("external_id", page.alias("page"), "error_message")


@QUERIES.add("vehicle_years", "SELECT p_partkey AS id, unnest([2021, 2022, 2023, 2024]) AS model_year FROM part")
def vehicle_years(spark: SparkSession, folder: str) -> DataFrame:
    return recalls.vehicle_years(load(spark, folder, "part").select(F.col("p_partkey").alias("id")), 2024)


@QUERIES.add(
    "envelope_hashes",
    cte("links")
    + """
    , h AS (SELECT threat_intelligence_id AS id, position, external_id, source_url, sha256('{"external_id":"' || external_id || '","raw_content":{"q":' || position || '},"snippet":null,"source_url":"' || source_url
        || '","summary":null,"title":"' || source_name || '"}') AS content_hash FROM links)
    SELECT id, position, content_hash, sha256('{"content_hash":"' || content_hash || '","external_id":"' || external_id || '","source_name":"feed","source_type":"rss","source_url":"' || source_url || '"}') AS raw_hash FROM h""",
)
def envelope_hashes(spark: SparkSession, folder: str) -> DataFrame:
    empty = F.lit(None).cast("string")
    items = X.links(spark, folder).withColumns(
        {
            "title": F.col("source_name"),
            "summary": empty,
            "snippet": empty,
            "raw_content": template('{"q":{{position}}}'),
            "fetched_at": F.col("last_seen_at"),
            "metadata": F.create_map(F.lit("id"), F.col("threat_intelligence_id").cast("string")),
        }
    )
    raw = envelope.to_raw(items, envelope.SourceInfo("feed", "rss"))
    return raw.select(
        F.col("metadata")["id"].cast("long").alias("id"),
        F.get_json_object("raw_content", "$.q").cast("int").alias("position"),
        "content_hash",
        "raw_hash",
    )


@QUERIES.add(
    "retention_policy",
    cte("raw")
    + """
    SELECT id, CASE WHEN source_type IN ('html', 'pdf') OR octet_length(encode(repeat(text, 20))) > 256000 THEN 'metadata_only' ELSE 'raw_payload' END AS retained_payload_mode,
        CASE WHEN source_type IN ('html', 'pdf') THEN 'metadata_only' WHEN octet_length(encode(repeat(text, 20))) > 256000 THEN 'raw_content_too_large' END AS reason FROM raw""",
)
def retention_policy(spark: SparkSession, folder: str) -> DataFrame:
    raw = X.raw(spark, folder).withColumn("raw_content", F.repeat("text", 20))
    return envelope.apply_retention(raw, max_bytes=256_000).select("id", "retained_payload_mode", F.col("metadata")["retention_enforced"].alias("reason"))


@QUERIES.add("next_cursors", cte("jobs") + "SELECT source_id, max(id) AS next_cursor FROM jobs GROUP BY source_id")
def next_cursors(spark: SparkSession, folder: str) -> DataFrame:
    return envelope.next_cursor(X.jobs(spark, folder), "id", "source_id")


@QUERIES.add(
    "upsert_raw",
    cte("raw")
    + """
    , t AS (SELECT DISTINCT source_id, external_id FROM raw WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT source_id, external_id FROM raw WHERE doc_id % 5 = 0)
    SELECT coalesce(t.source_id, b.source_id) AS source_id, coalesce(t.external_id, b.external_id) AS external_id,
        CASE WHEN t.external_id IS NULL THEN 'created' WHEN b.external_id IS NULL THEN 'unchanged' ELSE 'updated' END AS action
    FROM t FULL OUTER JOIN b ON b.source_id = t.source_id AND b.external_id = t.external_id""",
)
def upsert_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth document collected again on top of the even ones."""
    raw = X.raw(spark, folder)
    target = U.upsert_raw(raw.limit(0), raw.filter(F.col("doc_id") % 2 == 0)).drop("action")
    return U.upsert_raw(target, raw.filter(F.col("doc_id") % 5 == 0)).select("source_id", "external_id", "action")


def external_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Rows to ingest, from the records view; some are invalid on purpose."""
    frame = X.view(spark, folder, "records", deal=("o_orderkey", "o_custkey"), parts=parts_for(spark, folder, "orders"))
    empty = F.lit(None).cast("string")
    return frame.select(
        F.col("id").alias("arrival"),
        F.when(F.col("id") % 97 != 0, F.col("name_1")).alias("source_name"),
        F.when(F.col("id") % 89 == 0, F.lit("no address"))
        .when(F.col("id") % 7 == 0, template("https://src{{id % 100}}.example.test/item/{{id % 50}}"))
        .otherwise(F.regexp_replace("url_1", "&token=x$", ""))
        .alias("source_url"),
        F.when(F.col("id") % 3 == 0, F.lit(" Portal ")).alias("platform"),
        "title",
        F.coalesce(F.when(F.col("id") % 8 != 2, F.col("summary")), F.lit("No summary")).alias("summary"),
        F.when(F.col("id") % 71 == 0, F.lit("password = hunter2")).alias("description"),
        F.when(F.col("id") % 7 == 0, template("ext-{{id % 400}}")).alias("external_id"),
        F.when(F.col("id") % 4 == 0, F.lower("cve_id")).alias("cve_id"),
        empty.alias("cnvd_id"),
        empty.alias("vendor_advisory_id"),
        "affected_vendor",
        F.array(F.col("affected_product"), F.lit(" A ")).alias("affected_products"),
        F.array("vehicle_component").alias("components"),
        F.array_compact(F.array("attack_surface")).alias("attack_surfaces"),
        F.when(F.col("id") % 5 == 0, F.lit("高危")).when(F.col("id") % 61 == 0, F.lit("weird")).otherwise(F.upper("severity")).alias("severity"),
        F.col("cvss_score").alias("external_score"),
        F.col("first_seen_at").alias("published_at"),
        F.col("last_seen_at").alias("collected_at"),
        F.when(F.col("id") % 11 == 0, template("key:{{id % 300}}")).alias("dedup_key"),
        empty.alias("content_hash"),
        F.lit('{"a":1}').alias("raw_payload"),
        F.array(F.lit("Tag"), F.lit("tag ")).alias("tags"),
    )


@QUERIES.add(
    "validate_external",
    cte("records")
    + """
    SELECT id AS arrival, array_to_string(list_filter([CASE WHEN id % 97 = 0 THEN 'missing:source_name' END, CASE WHEN id % 71 = 0 THEN 'secret:description' END,
        CASE WHEN id % 89 = 0 THEN 'invalid:source_url' END, CASE WHEN id % 61 = 0 AND id % 5 <> 0 THEN 'invalid:severity' END], lambda x: x IS NOT NULL), ' ') AS errors FROM records""",
)
def validate_external(spark: SparkSession, folder: str) -> DataFrame:
    checked = batches.check_external(external_batch(spark, folder))
    return checked.select("arrival", F.array_join(batches.ERRORS, " ").alias("errors"))


def manual_batch(spark: SparkSession, folder: str) -> DataFrame:
    frame = X.view(spark, folder, "records")
    none = F.lit(None).cast("string")
    return frame.select(
        F.col("id").alias("arrival"),
        F.when(F.col("id") % 4 == 0, F.lit(" Vulnerabilities ")).when(F.col("id") % 4 == 1, F.lit("research-leads")).when(F.col("id") % 53 == 0, F.lit("odd")).otherwise(F.col("intelligence_type")).alias("category"),
        template("Finding {{id % 5000}}").alias("title"),
        F.when(F.col("id") % 59 != 0, F.lit("text")).alias("summary"),
        F.when(F.col("id") % 3 == 0, F.col("name_1")).alias("source_name"),
        F.when((F.col("id") % 3 == 1), template("https://Host{{id % 7}}.test/x")).alias("source_url"),
        F.when(F.col("id") % 10 == 0, template("CVE-2025-{{1000 + id % 900}}")).alias("cve_id"),
        none.alias("cwe_id"),
        (F.col("id") % 12).cast("double").alias("cvss_score"),
        none.alias("cvss_vector"),
        "severity",
        "affected_vendor",
        none.alias("affected_product"),
        none.alias("affected_version"),
        "vehicle_component",
        none.alias("attack_surface"),
        none.alias("exploit_status"),
        none.alias("confidence"),
        F.col("risk_score"),
        none.alias("risk_level"),
        F.array(F.lit("Alpha"), template("t{{id % 3}}")).alias("tags"),
        none.alias("status"),
    )


@QUERIES.add(
    "validate_manual",
    cte("records")
    + """
    SELECT id AS arrival, array_to_string(list_filter([CASE WHEN id % 12 = 11 THEN 'invalid:cvss_score' END, CASE WHEN id % 59 = 0 THEN 'missing:summary' END,
        CASE WHEN id % 53 = 0 AND id % 4 NOT IN (0, 1) THEN 'invalid:category' END, CASE WHEN id % 3 = 2 THEN 'missing:source' END], lambda x: x IS NOT NULL), ' ') AS errors FROM records""",
)
def validate_manual(spark: SparkSession, folder: str) -> DataFrame:
    checked = batches.check_manual(manual_batch(spark, folder))
    return checked.select("arrival", F.array_join(batches.ERRORS, " ").alias("errors"))
