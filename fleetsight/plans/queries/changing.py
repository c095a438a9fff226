"""Changes to alerts, sources and manual records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.operators import changes as C
from fleetsight.plans import fixtures as X
from fleetsight.plans.queries import Queries
from fleetsight.plans.queries.sqltext import cte
from fleetsight.sources.tables import load

QUERIES = Queries()
NOW = "2024-06-01 00:00:00"

_CHANGES = """
    , c AS (SELECT event_id AS arrival, event_id % 700 AS id, CASE event_type WHEN 'error' THEN 'closed' WHEN 'view' THEN 'open' WHEN 'click' THEN 'acknowledged' ELSE 'odd' END AS status,
        CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 'token: x' ELSE 'n' || event_id END AS notes, event_id % 2 = 0 AS given FROM events),
    ok AS (SELECT * FROM c WHERE status <> 'odd' AND NOT coalesce(notes = 'token: x', FALSE)),
    folded AS (SELECT id, arg_max(status, arrival) AS status, max_by(struct_pack(n := notes), arrival) FILTER (given) AS notes, bool_or(given) AS given FROM ok GROUP BY id)
    """


def _alert_changes(spark: SparkSession, folder: str):
    events = load(spark, folder, "events")
    status = F.when(F.col("event_type") == "error", "closed").when(F.col("event_type") == "view", "open")
    number = F.col("event_id")
    changes = events.select(
        number.alias("arrival"),
        (number % 700).alias("id"),
        status.when(F.col("event_type") == "click", "acknowledged").otherwise("odd").alias("status"),
        F.when(number % 6 == 0, F.lit(None)).when(number % 41 == 0, F.lit("token: x")).otherwise(F.concat(F.lit(" n"), number)).alias("notes"),
        (number % 2 == 0).alias("notes_supplied"),
    )
    return C.apply_alert_status(X.alerts(spark, folder), changes, F.lit(NOW).cast("timestamp"))


@QUERIES.add(
    "alert_status_changes",
    cte("alerts")
    + _CHANGES
    + "SELECT a.id AS id, coalesce(f.status, a.status) AS status, CASE WHEN f.given THEN f.notes.n ELSE a.notes END AS notes FROM alerts a LEFT JOIN folded f ON f.id = a.id",
)
def alert_status_changes(spark: SparkSession, folder: str) -> DataFrame:
    return _alert_changes(spark, folder)[0].select("id", "status", "notes")


@QUERIES.add(
    "alert_status_audit",
    cte("alerts")
    + _CHANGES
    + "SELECT CAST(a.id AS STRING) AS entity_id, CASE WHEN f.status = 'closed' THEN 'alert_closure' ELSE 'status_change' END AS action, a.status AS before, f.status AS after FROM alerts a JOIN folded f ON f.id = a.id",
)
def alert_status_audit(spark: SparkSession, folder: str) -> DataFrame:
    events = _alert_changes(spark, folder)[1]
    return events.select(
        "entity_id",
        "action",
        F.get_json_object("before", "$.status").alias("before"),
        F.get_json_object("after", "$.status").alias("after"),
    )


@QUERIES.add("alert_status_rejected", cte("alerts") + _CHANGES + "SELECT arrival FROM c WHERE arrival NOT IN (SELECT arrival FROM ok)")
def alert_status_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return _alert_changes(spark, folder)[2].select("arrival")


@QUERIES.add(
    "source_status_changes",
    cte("sources")
    + """
    , c AS (SELECT user_id % 60 AS id, arg_max(CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'disabled' ELSE 'enabled' END, event_id) AS status FROM events GROUP BY 1)
    SELECT s.id AS id, coalesce(c.status, s.status) AS status, CASE WHEN c.status IS NOT NULL AND c.status <> 'error' THEN NULL ELSE s.last_error_message END AS last_error_message
    FROM sources s LEFT JOIN c ON c.id = s.id""",
)
def source_status_changes(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    changes = load(spark, folder, "events").select(
        F.col("event_id").alias("arrival"),
        (F.col("user_id") % 60).alias("id"),
        F.when(kind == "error", "error").when(kind == "view", "disabled").otherwise("enabled").alias("status"),
        F.lit("checked").alias("reason"),
    )
    sources = X.sources(spark, folder).withColumn("updated_at", F.lit(None).cast("timestamp"))
    after, _events = C.apply_source_status(sources, changes, F.lit(NOW).cast("timestamp"))
    return after.select("id", "status", "last_error_message")


_PATCH_SQL = (
    cte("records")
    + """
    , p AS (SELECT id, status, 'Patched ' || (id % 50) AS title, CASE WHEN id % 3 = 0 THEN 'dismissed' ELSE status END AS next_status, cve_id, intelligence_type, name_1, url_1,
        CASE WHEN cve_id IS NOT NULL THEN 'manual:cve:' || cve_id ELSE 'manual:' || intelligence_type || ':' || substring(sha256('{"category":"' || intelligence_type || '","source_name":"' || lower(name_1)
        || '","source_url":"' || lower(url_1) || '","title":"patched ' || (id % 50) || '"}'), 1, 32) END AS wanted FROM records WHERE list_contains(tags, 'manual')),
    judged AS (SELECT *, id = min(id) OVER (PARTITION BY wanted) AS accepted FROM p)
    """
)


# The same patches with a new CVE id of few values, so that many want the key of another one.
_CVE_PATCH_SQL = (
    cte("records")
    + """
    , p AS (SELECT id, status, 'Patched ' || (id % 50) AS title, CASE WHEN id % 3 = 0 THEN 'dismissed' ELSE status END AS next_status,
        'manual:cve:CVE-2031-' || (4000 + id % 90) AS wanted FROM records WHERE list_contains(tags, 'manual')),
    judged AS (SELECT *, id = min(id) OVER (PARTITION BY wanted) AS accepted FROM p)
    """
)


def _patched(spark: SparkSession, folder: str, cve_id: Column | None = None) -> dict[str, DataFrame]:
    records = X.records(spark, folder)
    supplied = F.when(F.col("id") % 3 == 0, F.array(F.lit("title"), F.lit("status"))).otherwise(F.array(F.lit("title")))
    if cve_id is not None:
        supplied = F.concat(supplied, F.array(F.lit("cve_id")))
    patches = records.withColumns(
        {
            "arrival": F.col("id"),
            "supplied": supplied,
            "title": F.concat(F.lit(" Patched "), F.col("id") % 50),
            "status": F.lit("dismissed"),
            "source_name": F.lit(None).cast("string"),
            "source_url": F.lit(None).cast("string"),
            "tags": F.array().cast("array<string>"),
            "cve_id": F.col("cve_id") if cve_id is None else cve_id,
        }
    )
    raw = X.raw(spark, folder).limit(0)
    links = spark.createDataFrame([], "id string, threat_intelligence_id bigint, source_name string, source_url string, external_id string, last_seen_at timestamp")
    return C.apply_manual_patch(records, raw, links, patches, F.lit(NOW).cast("timestamp"))


@QUERIES.add(
    "manual_patches",
    _PATCH_SQL
    + """
    SELECT r.id AS id, CASE WHEN j.accepted THEN j.title ELSE r.title END AS title, CASE WHEN j.accepted THEN j.next_status ELSE r.status END AS status,
        CASE WHEN j.accepted THEN j.wanted ELSE r.dedup_key END AS dedup_key FROM records r LEFT JOIN judged j ON j.id = r.id""",
)
def manual_patches(spark: SparkSession, folder: str) -> DataFrame:
    return _patched(spark, folder)["records"].select("id", "title", "status", "dedup_key")


@QUERIES.add("manual_patch_collisions", _PATCH_SQL + "SELECT id, wanted AS wanted_key FROM judged WHERE NOT accepted")
def manual_patch_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return _patched(spark, folder)["rejected"].select("id", "wanted_key")


@QUERIES.add(
    "manual_patch_audit",
    _PATCH_SQL
    + "SELECT CAST(id AS STRING) AS entity_id, CASE WHEN next_status <> status THEN 'status_change' ELSE 'manual_entry' END AS action FROM judged WHERE accepted",
)
def manual_patch_audit(spark: SparkSession, folder: str) -> DataFrame:
    return _patched(spark, folder)["audit"].select("entity_id", "action")


def _cve_patched(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return _patched(spark, folder, F.concat(F.lit("cve-2031-"), 4000 + F.col("id") % 90))


@QUERIES.add("manual_patch_cve_collisions", _CVE_PATCH_SQL + "SELECT id, wanted AS wanted_key FROM judged WHERE NOT accepted")
def manual_patch_cve_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return _cve_patched(spark, folder)["rejected"].select("id", "wanted_key")


@QUERIES.add(
    "manual_patch_cve_records",
    _CVE_PATCH_SQL
    + """
    SELECT r.id AS id, CASE WHEN j.accepted THEN j.title ELSE r.title END AS title, CASE WHEN j.accepted THEN j.next_status ELSE r.status END AS status,
        CASE WHEN j.accepted THEN j.wanted ELSE r.dedup_key END AS dedup_key FROM records r LEFT JOIN judged j ON j.id = r.id""",
)
def manual_patch_cve_records(spark: SparkSession, folder: str) -> DataFrame:
    """Patches that lose their key change nothing."""
    return _cve_patched(spark, folder)["records"].select("id", "title", "status", "dedup_key")


@QUERIES.add(
    "source_status_rejected",
    cte("sources")
    + """
    , c AS (SELECT event_id AS arrival, user_id % 60 AS id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'disabled' WHEN 'signup' THEN 'paused' WHEN 'purchase' THEN NULL ELSE 'enabled' END AS status FROM events)
    SELECT arrival, CASE WHEN status IS NULL OR status = 'paused' THEN 'unknown status' ELSE 'unknown source' END AS problem FROM c
    WHERE status IS NULL OR status = 'paused' OR id NOT IN (SELECT id FROM sources)""",
)
def source_status_rejected(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "view", "disabled").when(kind == "signup", "paused")
    changes = load(spark, folder, "events").select(
        F.col("event_id").alias("arrival"),
        (F.col("user_id") % 60).alias("id"),
        status.when(kind == "purchase", F.lit(None)).otherwise("enabled").alias("status"),
    )
    return C.rejected_source_status(X.sources(spark, folder), changes).select("arrival", "problem")


@QUERIES.add("alert_changes_of_unknown_ids", "SELECT user_id AS arrival FROM events WHERE user_id NOT IN (SELECT event_id FROM events WHERE event_type <> 'click')")
def alert_changes_of_unknown_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Changes to the alerts whose ids are user ids, of which those of clicks are gone."""
    known = X.alerts(spark, folder).filter(F.col("triggering_rule") != "vehicle-critical-tbox")
    changes = load(spark, folder, "events").select(F.col("user_id").alias("arrival"), F.col("user_id").alias("id"))
    return C.unknown_ids(known, changes).select("arrival")
