"""Declared schemas; nothing is inferred."""

from __future__ import annotations

RAW = """
    id string, source_id string, source_name string, source_type string, source_url string, external_id string,
    fetched_at timestamp, first_seen_at timestamp, title string, summary string, snippet string,
    raw_content string, raw_hash string, content_hash string, parsing_status string, processing_status string,
    error_message string, metadata map<string,string>, retained_payload_mode string,
    created_at timestamp, updated_at timestamp
"""

INTELLIGENCE = """
    id string, raw_intelligence_id string, title string, summary string, intelligence_type string,
    source_names array<string>, source_urls array<string>, canonical_source_url string,
    external_ids map<string,array<string>>, cve_id string, cwe_id string, cvss_score double, cvss_vector string,
    severity string, affected_vendor string, affected_product string, affected_version string,
    vehicle_component string, attack_surface string, exploit_status string, confidence string,
    risk_score double, risk_level string, tags array<string>, first_seen_at timestamp, last_seen_at timestamp,
    dedup_key string, normalized_text_hash string, processing_status string, status string,
    metadata map<string,string>, created_at timestamp, updated_at timestamp
"""

LINKS = """
    id string, threat_intelligence_id string, source_id string, raw_intelligence_id string, source_name string,
    source_url string, external_id string, first_seen_at timestamp, last_seen_at timestamp
"""

ALERTS = """
    id string, threat_intelligence_id string, triggering_rule string, title string, risk_level string,
    triggered_at timestamp, status string, notes string, metadata map<string,string>
"""

SOURCES = """
    id string, name string, source_type string, base_url string, status string, config string,
    last_success_at timestamp, last_error_at timestamp, last_error_message string,
    created_at timestamp, updated_at timestamp
"""

SYNC_STATES = """
    source_id string, cursor string, status string, last_run_at timestamp, consecutive_failures long
"""

JOB_LOGS = """
    id string, job_name string, source_id string, status string, started_at timestamp, finished_at timestamp,
    items_seen long, items_created long, items_updated long, error_message string, metadata string,
    created_at timestamp, updated_at timestamp
"""

AUDIT_EVENTS = """
    action string, entity_type string, entity_id string, summary string, before string, after string,
    metadata map<string,string>, occurred_at timestamp
"""

TABLES = {
    "raw_intelligence": RAW,
    "threat_intelligence": INTELLIGENCE,
    "threat_intelligence_sources": LINKS,
    "alerts": ALERTS,
    "sources": SOURCES,
    "sync_states": SYNC_STATES,
    "job_logs": JOB_LOGS,
    "audit_events": AUDIT_EVENTS,
}

# --- feed payloads ------------------------------------------------------------
# A page that does not parse is kept in the last field.
CVE_PAGE = "vulnerabilities array<string>, _corrupt_record string"
_CVSS = "array<struct<cvssData: struct<version: string, baseScore: double, baseSeverity: string, vectorString: string>, baseSeverity: string>>"
CVE_ENTRY = f"""
    cve struct<
        id: string, published: string, lastModified: string, vulnStatus: string,
        descriptions: array<struct<lang: string, value: string>>,
        metrics: struct<cvssMetricV31: {_CVSS}, cvssMetricV30: {_CVSS}, cvssMetricV2: {_CVSS}>,
        weaknesses: array<struct<description: array<struct<lang: string, value: string>>>>,
        references: string,
        configurations: array<struct<nodes: array<struct<cpeMatch: array<struct<criteria: string>>>>>>
    >
"""
KEV_PAGE = "vulnerabilities array<string>, _corrupt_record string"
RECALL_PAGE = "Count int, Results array<string>, _corrupt_record string"
_LINK = "array<struct<_href: string, _rel: string>>"
FEED = f"""
    channel struct<item: array<struct<
        title: string, link: string, guid: string, description: string, pubDate: string, updated: string>>>,
    entry array<struct<
        title: string, link: {_LINK}, id: string, summary: string, content: string, published: string,
        updated: string>>,
    _corrupt_record string
"""

EXTERNAL_BATCH = """
    source_name string, source_url string, platform string, title string, summary string, description string,
    external_id string, cve_id string, cnvd_id string, vendor_advisory_id string, affected_vendor string,
    affected_products array<string>, components array<string>, attack_surfaces array<string>, severity string,
    external_score double, published_at timestamp, collected_at timestamp, dedup_key string, content_hash string,
    raw_payload string, tags array<string>
"""

MANUAL_BATCH = """
    category string, title string, summary string, source_name string, source_url string, cve_id string,
    cwe_id string, cvss_score double, cvss_vector string, severity string, affected_vendor string,
    affected_product string, affected_version string, vehicle_component string, attack_surface string,
    exploit_status string, confidence string, risk_score double, risk_level string, tags array<string>,
    status string
"""
