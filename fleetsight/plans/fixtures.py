"""The given tables seen through the engine's schemas.

Each view is one list of SQL expressions that is valid in Spark and in other engines, so a
check can state the same projection. Views read one table and are projections only, which
keeps column pruning and filter push-down intact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.sources.envelope import string_map
from fleetsight.sources.tables import dealt, load

# view -> (table, {column: expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "records": (
        "orders",
        {
            "id": "o_orderkey",
            "title": "concat(CASE o_custkey % 6 WHEN 0 THEN 'Remote ' WHEN 1 THEN 'Authenticated user ' WHEN 2 THEN 'OpenSSL ' "
            "WHEN 3 THEN 'Exploit code for ' ELSE '' END, 'finding ', CAST(o_orderkey AS STRING))",
            "summary": "CASE WHEN o_orderkey % 9 <> 0 THEN concat('Order ', CAST(o_orderkey AS STRING), ' of customer ', "
            "CAST(o_custkey AS STRING), CASE o_orderkey % 8 WHEN 0 THEN ', auth bypass' WHEN 1 THEN ', supply chain' "
            "WHEN 2 THEN ', token=abc' ELSE '' END) END",
            "intelligence_type": "CASE o_orderkey % 4 WHEN 0 THEN 'vulnerability' WHEN 1 THEN 'exposure' WHEN 2 THEN 'incident' ELSE 'advisory' END",
            "cve_id": "CASE WHEN o_orderkey % 4 <> 3 THEN concat('CVE-2024-', CAST(10000 + o_orderkey % 5000 AS STRING)) END",
            "cwe_id": "CASE WHEN o_orderkey % 3 = 0 THEN concat('CWE-', CAST(o_custkey % 90 AS STRING)) END",
            "cvss_score": "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) / 10 END",
            "cvss_vector": "CASE o_orderkey % 6 WHEN 0 THEN 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N' WHEN 1 THEN 'CVSS:3.1/AV:A/AC:L/PR:L/UI:N' "
            "WHEN 2 THEN 'CVSS:3.1/AV:L/AC:H/PR:H/UI:R' END",
            "severity": "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' "
            "WHEN '5-LOW' THEN 'low' ELSE 'unknown' END",
            "affected_vendor": "CASE WHEN o_custkey % 17 <> 0 THEN concat('Vendor-', CAST(o_custkey % 40 AS STRING)) END",
            "affected_product": "concat('product ', CAST(o_custkey % 200 AS STRING))",
            "affected_version": "CAST(NULL AS STRING)",
            "vehicle_component": "CASE o_custkey % 13 WHEN 0 THEN 'app' WHEN 1 THEN 'tbox' WHEN 2 THEN 'ivi' WHEN 3 THEN 'ota' WHEN 4 THEN 'v2x' "
            "WHEN 5 THEN 'charging' WHEN 6 THEN 'cloud_api' WHEN 7 THEN 'bluetooth' WHEN 8 THEN 'wifi' WHEN 9 THEN 'cellular' "
            "WHEN 10 THEN 'can' WHEN 11 THEN 'usb' END",
            "attack_surface": "CASE o_orderkey % 7 WHEN 0 THEN 'cellular' WHEN 1 THEN 'usb' WHEN 2 THEN 'can' END",
            "exploit_status": "CASE o_orderkey % 10 WHEN 0 THEN 'exploited' WHEN 1 THEN 'proof_of_concept' WHEN 2 THEN 'none_known' ELSE 'unknown' END",
            "confidence": "CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END",
            "risk_score": "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice / 5000) AS DOUBLE) END",
            "risk_level": "CASE WHEN o_orderkey % 11 = 0 THEN 'info' WHEN o_totalprice >= 450000 THEN 'critical' "
            "WHEN o_totalprice >= 350000 THEN 'high' WHEN o_totalprice >= 200000 THEN 'medium' ELSE 'low' END",
            "status": "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'under_review' ELSE 'resolved' END",
            "processing_status": "CASE WHEN o_orderkey % 23 = 0 THEN 'failed' ELSE 'normalized' END",
            "name_1": "concat('Source ', CAST(o_custkey % 12 AS STRING))",
            "name_2": "CASE WHEN o_custkey % 5 = 0 THEN 'cisa_kev' END",
            "url_1": "concat('https://src', CAST(o_custkey % 12 AS STRING), '.example.test/item/', CAST(o_orderkey AS STRING), '?page=1&token=x')",
            "url_2": "CASE WHEN o_orderkey % 2 = 0 THEN concat('https://mirror.example.test/', CAST(o_orderkey AS STRING)) END",
            "tag_1": "concat('tag ', CAST(o_custkey % 30 AS STRING))",
            "tag_2": "CASE o_orderkey % 19 WHEN 0 THEN 'kev' WHEN 1 THEN 'cisa-kev' WHEN 2 THEN 'manual' WHEN 3 THEN 'poc' END",
            "date_added": "CASE WHEN o_orderkey % 29 = 0 THEN '2024-05-01' END",
            "origin": "CASE WHEN o_orderkey % 19 = 2 THEN 'manual' END",
            "first_seen_at": "o_orderdate",
            "last_seen_at": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL '10' DAY ELSE o_orderdate + INTERVAL '36' HOUR END",
            "created_at": "o_orderdate",
            "updated_at": "o_orderdate + INTERVAL '12' HOUR",
            "dedup_key": "concat('key:', CAST(o_orderkey AS STRING))",
        },
    ),
    "links": (
        "lineitem",
        {
            "threat_intelligence_id": "l_orderkey",
            "source_id": "l_suppkey",
            "source_name": "concat('Source ', CAST(l_suppkey AS STRING))",
            "source_url": "concat('https://src', CAST(l_suppkey AS STRING), '.example.test/item/', CAST(l_partkey % 50 AS STRING))",
            "external_id": "concat('ext-', CAST(l_partkey AS STRING))",
            "first_seen_at": "l_shipdate",
            "last_seen_at": "l_shipdate",
            "position": "l_linenumber",
            "quantity": "l_quantity",
        },
    ),
    "sources": (
        "supplier",
        {
            "id": "s_suppkey",
            "name": "s_name",
            "source_type": "CASE s_suppkey % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'rss' WHEN 2 THEN 'vendor' ELSE 'manual' END",
            "base_url": "concat('https://user:pw@Feed', CAST(s_suppkey AS STRING), '.example.test/list?api_key=1&page=2')",
            "status": "CASE WHEN s_acctbal < 0 THEN 'error' WHEN s_suppkey % 9 = 0 THEN 'disabled' ELSE 'enabled' END",
            "last_error_message": "CASE WHEN s_acctbal < 0 THEN concat('balance ', CAST(s_suppkey AS STRING)) END",
            "nation": "s_nationkey",
        },
    ),
    "jobs": (
        "events",
        {
            "id": "event_id",
            "source_id": "user_id % 50",
            "job_name": "CASE WHEN event_id % 7 = 0 THEN 'process_pipeline' ELSE 'sync_sources' END",
            "status": "CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END",
            "started_at": "ts",
            "finished_at": "CASE WHEN event_id % 31 <> 0 THEN ts END",
            "items_seen": "CAST(floor(value) AS BIGINT)",
            "items_created": "event_id % 4",
            "items_updated": "event_id % 3",
            "error_message": "CASE event_type WHEN 'error' THEN concat('call failed token=', CAST(event_id AS STRING), ' code ', CAST(user_id AS STRING)) END",
            "metadata": "concat('{\"attempts\":', CAST(event_id % 4 AS STRING), CASE event_type WHEN 'signup' THEN '' ELSE concat(',\"run_status\":\"', "
            "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'success' END, '\"') END, "
            "CASE event_type WHEN 'purchase' THEN concat(',\"next_cursor\":\"c', CAST(event_id AS STRING), '\"') ELSE '' END, "
            "CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN ',\"reason\":\"disabled\"' ELSE '' END, "
            "CASE WHEN event_id % 13 = 0 THEN ',\"retried\":true' ELSE '' END, "
            "CASE WHEN event_id % 17 = 0 THEN ',\"skipped\":true' WHEN event_id % 17 = 1 THEN ',\"skipped\":false' ELSE '' END, '}')",
            "created_at": "ts",
            "updated_at": "ts",
        },
    ),
    "alerts": (
        "events",
        {
            "id": "event_id",
            "threat_intelligence_id": "event_id % 900",
            "triggering_rule": "CASE event_type WHEN 'error' THEN 'known-exploited' WHEN 'view' THEN 'critical-intelligence' "
            "WHEN 'click' THEN 'vehicle-critical-tbox' ELSE concat('burst-vendor-v', CAST(user_id % 9 AS STRING)) END",
            "title": "concat('Alert ', CAST(event_id AS STRING), CASE WHEN event_id % 50 = 0 THEN ' secret: x' ELSE '' END)",
            "risk_level": "CASE event_id % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END",
            "status": "CASE WHEN event_id % 3 = 0 THEN 'open' WHEN event_id % 3 = 1 THEN 'acknowledged' ELSE 'closed' END",
            "triggered_at": "ts",
            "notes": "CASE WHEN event_id % 4 = 0 THEN concat('note ', CAST(user_id AS STRING), CASE WHEN event_id % 16 = 0 THEN ' password=1' ELSE '' END) END",
        },
    ),
    "raw": (
        "documents",
        {
            "id": "CAST(doc_id AS STRING)",
            "doc_id": "doc_id",
            "source_id": "source",
            "source_name": "CASE doc_id % 12 WHEN 0 THEN 'nvd' WHEN 3 THEN 'cisa-kev' WHEN 2 THEN 'nhtsa-recalls' ELSE source END",
            "source_type": "CASE doc_id % 5 WHEN 0 THEN 'api' WHEN 1 THEN 'rss' WHEN 2 THEN 'vendor' WHEN 3 THEN 'html' ELSE 'pdf' END",
            "source_url": "concat('https://', upper(source), '.example.test/item/', CAST(doc_id % 30 AS STRING), '#top')",
            "external_id": "CASE WHEN doc_id % 3 = 0 AND doc_id % 24 <> 15 THEN concat('CVE-2024-', CAST(10000 + doc_id % 97 AS STRING)) ELSE concat('doc-', CAST(doc_id AS STRING)) END",
            "title": "concat('Report ', CAST(doc_id % 40 AS STRING), ' on ', source)",
            "summary": "CASE WHEN doc_id % 6 <> 0 THEN text END",
            "text": "text",
            "language": "lang",
            "length": "n_chars",
            "processing_status": "CASE WHEN doc_id % 8 = 0 THEN 'pending' WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'collected' END",
            "parsing_status": "CASE WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'pending' END",
            "error_message": "CASE WHEN doc_id % 17 = 0 THEN concat('bad payload api_key=', CAST(doc_id AS STRING), '&x secret') END",
        },
    ),
}

ARRAYS = {
    "source_names": ("name_1", "name_2"),
    "source_urls": ("url_1", "url_2"),
    "tags": ("tag_1", "tag_2"),
}


def select_list(view: str) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in VIEWS[view][1].items())


def view(spark: SparkSession, folder: str, name: str, deal: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """A view; ``deal`` names columns of the table by whose hash its rows are spread over all tasks, or over ``parts``."""
    table, columns = VIEWS[name]
    rows = load(spark, folder, table)
    rows = dealt(rows, *deal, parts=parts) if deal else rows
    return rows.selectExpr(*[f"{expression} AS {column}" for column, expression in columns.items()])


def records(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """Core records from ``orders``, with list and map columns; with ``parts`` dealt by id before anything is computed."""
    frame = view(spark, folder, "records", deal=("o_orderkey",) if parts else (), parts=parts)
    lists = {name: F.array_compact(F.array(*[F.col(part) for part in parts])) for name, parts in ARRAYS.items()}
    no_ids = F.create_map().cast("map<string,array<string>>")
    metadata = F.map_filter(
        string_map({"date_added": F.col("date_added"), "entry_origin": F.col("origin")}), lambda _key, value: value.isNotNull()
    )
    return frame.withColumns(
        {
            **lists,
            "canonical_source_url": F.col("url_1"),
            "external_ids": no_ids,
            "metadata": metadata,
            "raw_intelligence_id": F.col("id").cast("string"),
            "normalized_text_hash": F.lit(None).cast("string"),
        }
    ).drop(*[part for parts in ARRAYS.values() for part in parts], "origin", "date_added")


def links(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    return view(spark, folder, "links", deal=("l_orderkey",) if parts else (), parts=parts)


def sources(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "sources")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "jobs")


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "alerts")


def raw(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows from ``documents``: whole texts, newer documents fetched later."""
    fetched = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60)
    metadata = F.when(
        F.col("doc_id") % 12 == 3,
        string_map(
            {
                "vendor_project": F.concat(F.lit("Maker "), F.col("doc_id") % 4),
                "product": F.lit("Gateway"),
                "date_added": F.lit("2024-03-01"),
                "due_date": F.lit(None),
                "known_ransomware_campaign_use": F.when(F.col("doc_id") % 24 == 3, F.lit("Known")),
                "cwes": F.lit('["CWE-79","CWE-80"]'),
            }
        ),
    ).otherwise(string_map({"feed_name": F.concat(F.lit("Feed "), F.col("source_id"))}))
    return view(spark, folder, "raw", deal=("doc_id", "n_chars")).withColumns(
        {
            "snippet": F.col("summary"),
            "raw_content": F.lit(None).cast("string"),
            "content_hash": F.sha2("text", 256),
            "raw_hash": F.sha2(F.concat_ws("|", "id", "text"), 256),
            "fetched_at": fetched,
            "first_seen_at": F.when(F.col("doc_id") % 4 != 0, fetched - F.expr("INTERVAL 2 DAYS")),
            "created_at": fetched,
            "updated_at": fetched,
            "metadata": metadata,
            "retained_payload_mode": F.lit("raw_payload"),
        }
    )
