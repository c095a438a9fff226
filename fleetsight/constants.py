"""Enumerations, rank orders, term lists, weights, patterns and texts.

Every value in this file has to equal the published rules for results to agree.
Order matters for the hint tables (first hit wins) and for the rank tuples
(weakest first).
"""

# --- enumerations -----------------------------------------------------------
RISK_LEVELS = ("info", "low", "medium", "high", "critical")
SEVERITIES = ("unknown", "low", "medium", "high", "critical")
EXPLOIT_STATUSES = ("unknown", "none_known", "proof_of_concept", "exploited")
CONFIDENCES = ("low", "medium", "high")
INTELLIGENCE_TYPES = ("vulnerability", "exposure", "incident", "advisory")
PROCESSING_STATUSES = ("pending", "collected", "processing", "normalized", "failed", "skipped")
JOB_STATUSES = ("queued", "running", "success", "failed")
ALERT_STATUSES = ("open", "acknowledged", "closed")
SOURCE_STATUSES = ("enabled", "disabled", "error")
SOURCE_TYPES = ("api", "rss", "html", "pdf", "manual", "vendor")
VEHICLE_PARTS = (
    "app", "tbox", "ivi", "ota", "v2x", "charging", "cloud_api", "bluetooth", "wifi", "cellular", "can", "usb",
)
MANUAL_CATEGORIES = ("vulnerability", "advisory", "incident", "exposure", "research_lead")
RECORD_STATUSES = ("active", "under_review", "resolved", "dismissed")

# --- hints: vehicle part -> terms -------------------------------------------
HINT_TERMS = {
    "app": (" app", "mobile app", "application"),
    "tbox": ("t-box", "tbox", "telematics"),
    "ivi": ("ivi", "infotainment", "head unit"),
    "ota": ("ota", "over-the-air", "firmware update"),
    "v2x": ("v2x", "vehicle-to-everything"),
    "charging": ("charging", "charger", "evse"),
    "cloud_api": ("cloud api", "cloud", "api"),
    "bluetooth": ("bluetooth", "ble"),
    "wifi": ("wi-fi", "wifi", "wlan"),
    "cellular": ("cellular", "4g", "5g", "lte"),
    "can": (" can ", "can bus", "controller area network"),
    "usb": ("usb",),
}
COMPONENT_ORDER = VEHICLE_PARTS
SURFACE_ORDER = (
    "bluetooth", "wifi", "cellular", "cloud_api", "usb", "can", "v2x", "charging", "ota", "app", "tbox", "ivi",
)
EXPLOITED_TERMS = ("known exploited", "exploited", "kev")
PROOF_TERMS = ("proof of concept", "poc")

# --- scoring ----------------------------------------------------------------
RULE_VERSION = "fixed-risk-v1"
LEVEL_THRESHOLDS = ((90.0, "critical"), (70.0, "high"), (40.0, "medium"), (0.0, "low"))
SEVERITY_POINTS = {"critical": 62.0, "high": 50.0, "medium": 32.0, "low": 15.0, "unknown": 10.0}
CONFIDENCE_POINTS = {"high": 5.0, "medium": 0.0, "low": -8.0}
REMOTE_PARTS = ("app", "tbox", "ota", "v2x", "charging", "cloud_api", "bluetooth", "wifi", "cellular")
PART_WEIGHTS = {
    "tbox": 14.0, "ota": 14.0, "can": 14.0, "v2x": 14.0, "cloud_api": 13.0, "app": 12.0, "charging": 12.0,
    "cellular": 10.0, "wifi": 8.0, "bluetooth": 8.0, "ivi": 7.0, "usb": 4.0,
}
KNOWN_EXPLOITED_TAGS = ("cisa-kev", "kev", "known_exploited", "known-exploited")
KNOWN_EXPLOITED_SOURCES = ("cisa-kev", "cisa_kev")
CATALOGUE_KEYS = ("date_added", "known_ransomware_campaign_use", "vulnerability_name")
POC_TERMS = (
    "proof of concept", "public poc", "poc available", "exploit code", "metasploit", "exploit-db", "github.com",
)
POC_TAGS = ("poc", "proof_of_concept")
REMOTE_TERMS = (
    "remote", "network exploitable", "network-exploitable", "internet facing", "internet-facing", "over the air",
    "over-the-air", "cloud api", "mobile app", "cellular", "v2x",
)
UNAUTHENTICATED_TERMS = (
    "unauthenticated", "without authentication", "no authentication", "authentication bypass", "auth bypass",
)
AUTHENTICATED_TERMS = (
    "authenticated user", "requires authentication", "authentication required", "privileges required",
)
MULTI_VENDOR_NAMES = ("multiple", "various", "multi vendor", "multi-vendor", "multiple vendors")
MULTI_VENDOR_TERMS = (
    "multi vendor", "multi-vendor", "multiple vendors", "common component", "third party component",
    "third-party component", "supply chain", "shared component", "widely used",
)
COMMON_COMPONENT_TERMS = (
    "openssl", "linux", "android", "autosar", "bluetooth stack", "wifi chipset", "wi-fi chipset", "baseband",
    "qualcomm", "evse", "charging station",
)
FACTOR_LABELS = {
    "cvss": "CVSS 基础分",
    "severity": "严重度回退评分",
    "known_exploited": "已知在野利用或 CISA KEV 信号",
    "exploit_status": "概念验证（PoC）利用状态",
    "public_poc": "公开 PoC 或利用代码信号",
    "remote_exploitability": "可远程利用信号",
    "authentication_requirement": "身份认证要求信号",
    "vehicle_critical_component": "车控关键组件影响",
    "multi_vendor_common_component": "多厂商或通用组件影响",
    "source_confidence": "数据源可信度",
}

# --- alerts -----------------------------------------------------------------
ALERT_CRITICAL_PARTS = ("app", "tbox", "ota", "cloud_api", "can", "v2x", "charging")
HIGH_RISK_LEVELS = ("high", "critical")
BURST_DAYS = 7
BURST_MIN_ITEMS = 3
CONTEXT_LIMIT = 500
ALERT_TITLES = {
    "critical": "关键风险情报",
    "exploited": "已知在野利用情报",
    "vehicle": "高风险车端关键组件情报",
    "multi_source": "多来源 CVE 情报",
    "burst": "短期高风险情报集中出现",
}
ALERT_REASONS = {
    "critical": "critical intelligence",
    "exploited": "known exploited signal",
    "vehicle": "high-risk vehicle critical component",
    "multi_source": "same CVE observed across multiple sources",
    "burst": "multiple high-risk items in short period",
}

# --- sources ----------------------------------------------------------------
PAYLOAD_RETAINING_TYPES = ("api", "rss")
PAYLOAD_DROPPING_TYPES = ("html", "pdf")
CVE_WINDOW_DAYS = 120
CVE_DETAIL_URL = "https://nvd.nist.gov/vuln/detail/"
KEV_DETAIL_URL = "https://www.cisa.gov/known-exploited-vulnerabilities-catalog?search_api_fulltext="
RECALL_DETAIL_URL = "https://www.nhtsa.gov/recalls?campaignNumber="
RECALL_KEYWORDS = (
    "software", "telematics", "cyber", "ota", "over the air", "over-the-air", "firmware", "infotainment",
    "electronic control unit", "ecu", "remote update", "wireless update", "connected services", "mobile app",
)
RECALL_CONTENT_KEYS = (
    "ReportReceivedDate", "Component", "Summary", "Conequence", "Remedy", "Manufacturer", "Type",
    "PotentialNumberofUnitsAffected",
)
TRUE_WORDS = ("1", "true", "yes", "y", "on")
RANSOMWARE_WORDS = ("known", "yes", "true")
PDF_LABEL_TERMS = ("advisory", "security", "bulletin", "vulnerability", "cve-", "psirt")
ADVISORY_TERMS = ("advisory", "advisories", "security", "bulletin", "vulnerability", "cve-")
MODEL_YEARS = 4

# --- redaction --------------------------------------------------------------
SENSITIVE_KEY_PARTS = (
    "authorization", "api_key", "apikey", "cookie", "credential", "header", "password", "private", "raw", "secret",
    "token",
)
SENSITIVE_WORDS = ("password", "token", "secret", "api[_-]?key", "authorization", "cookie")
MANUAL_SENSITIVE_WORDS = ("password", "token", "secret", "api[_-]?key")
ERROR_SENSITIVE_WORDS = ("api[_-]?key", "authorization", "password", "secret", "token")
INTERNAL_KEY_PARTS = ("broker", "result_backend")
INTERNAL_KEYS = ("redis_url", "database_url")
INTERNAL_URL_PREFIXES = ("redis://", "rediss://", "postgresql://", "postgresql+psycopg://")

# --- batch validation -------------------------------------------------------
EXTERNAL_TEXT_LIMITS = {
    "source_name": 160, "source_url": 1000, "platform": 80, "title": 500, "summary": 4000, "description": 12000,
    "external_id": 240, "cve_id": 32, "cnvd_id": 80, "vendor_advisory_id": 120, "affected_vendor": 160,
    "dedup_key": 320, "content_hash": 128,
}
EXTERNAL_LIST_LIMITS = {"affected_products": 50, "components": 50, "attack_surfaces": 50, "tags": 30}
EXTERNAL_ITEM_LENGTH = 120
EXTERNAL_PAYLOAD_LENGTH = 32_768
MANUAL_TEXT_LIMITS = {
    "source_name": 160, "source_url": 1000, "cve_id": 32, "cwe_id": 32, "cvss_vector": 160, "affected_vendor": 160,
    "affected_product": 200, "affected_version": 200, "title": 500,
}
MANUAL_TAG_LIMIT = 20
MANUAL_TAG_LENGTH = 80
SEVERITY_ALIASES = {
    "严重": "critical", "高危": "high", "中危": "medium", "低危": "low", "信息": "unknown", "info": "unknown",
}
CATEGORY_ALIASES = {
    "vulnerabilities": "vulnerability", "advisories": "advisory", "incidents": "incident", "exposures": "exposure",
    "research leads": "research_lead", "research-leads": "research_lead", "research_leads": "research_lead",
}
CATEGORY_TYPES = {
    "vulnerability": "vulnerability", "advisory": "advisory", "incident": "incident", "exposure": "exposure",
    "research_lead": "advisory",
}
SEVERITY_TO_RISK = {"critical": "critical", "high": "high", "medium": "medium", "low": "low", "unknown": "info"}

# --- normalised metadata keys, by mapping -------------------------------------
METADATA_KEYS = {
    "cve": ("published", "last_modified", "vuln_status", "reference_count"),
    "kev": ("date_added", "due_date", "known_ransomware_campaign_use", "notes", "vulnerability_name"),
    "rss": ("feed_name", "feed_url", "published", "updated"),
    "vendor": ("vendor", "endpoint_url", "verification_status", "content_type", "is_pdf"),
    "manual": ("entry_origin", "manual_entry_category"),
    "external": ("entry_origin", "platform", "cnvd_id", "vendor_advisory_id", "published_at", "collected_at"),
    "recall": (
        "campaign_number", "make", "model", "model_year", "manufacturer", "component", "report_received_date",
        "recall_type", "software_related", "over_the_air_update",
    ),
    "fallback": ("fallback_reason",),
}
NORMALIZER_NAMES = {
    "cve": "NvdNormalizer", "kev": "CisaKevNormalizer", "rss": "RssNormalizer", "vendor": "VendorAdvisoryNormalizer",
    "manual": "ManualNormalizer", "external": "ExternalIngestNormalizer", "recall": "RecallNormalizer",
    "fallback": "FallbackNormalizer",
}
FALLBACK_REASON = "source-specific normalizer unavailable"
BY_SOURCE_NAME = {
    "nvd": "cve", "cisa-kev": "kev", "rss": "rss", "vendor-advisories": "vendor", "nhtsa-recalls": "recall",
}
BY_ENTRY_ORIGIN = {"external_ingest": "external"}
BY_SOURCE_TYPE = {
    "manual": "manual", "rss": "rss", "vendor": "vendor", "api": "fallback", "html": "vendor", "pdf": "vendor",
}
SIGHTING_KEYS = ("normalizer", "raw_source_type", "vendor", "feed_name", "date_added")
SIGHTINGS_KEPT = 20

# --- reports ----------------------------------------------------------------
TREND_DAYS = 30
TOP_SOURCES = 10
RECENT_FAILURES = 5
SUMMARY_ROWS = 8
EXPORT_LIMIT = 100
SUMMARY_LIMIT = 20
PIPELINE_JOB = "process_pipeline"
SYNC_JOB = "sync_sources"
INTELLIGENCE_CSV_HEADERS = {
    "id": "编号", "title": "标题", "summary": "摘要", "intelligence_type": "情报类型", "cve_id": "CVE 编号",
    "severity": "严重度", "risk_level": "风险等级", "risk_score": "风险评分", "status": "状态",
    "affected_vendor": "受影响厂商", "affected_product": "受影响产品", "vehicle_component": "车辆组件",
    "attack_surface": "攻击面", "source_names": "数据源名称", "source_urls": "数据源链接",
    "first_seen_at": "首次发现时间", "last_seen_at": "最近更新时间",
}
ALERT_CSV_HEADERS = {
    "id": "编号", "title": "标题", "threat_intelligence_id": "关联情报编号", "triggering_rule": "触发规则",
    "risk_level": "风险等级", "status": "状态", "triggered_at": "触发时间", "notes": "备注",
    "intelligence_title": "情报标题", "cve_id": "CVE 编号", "source_names": "数据源名称",
}
REPORT_TEXT = {
    "untitled": "情报条目", "id": "编号", "type": "类型", "status": "状态", "cve": "CVE", "severity": "严重度",
    "risk": "风险", "vendor": "厂商", "product": "产品", "summary": "摘要", "sources": "数据源", "source": "数据源",
    "alerts": "关联告警", "none": "暂无",
}
