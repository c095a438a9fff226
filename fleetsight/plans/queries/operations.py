"""Jobs, source health and pipeline status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.functions.nested import job_text
from fleetsight.operators import ops as O
from fleetsight.operators import search as S
from fleetsight.operators.raw_upsert import upsert_raw
from fleetsight.plans import fixtures as X
from fleetsight.plans.pipeline import persist_runs
from fleetsight.plans.queries import Queries
from fleetsight.plans.queries.sqltext import cte, sensitive
from fleetsight.session import scratch_folder
from fleetsight.sources.tables import empty, scan, write

QUERIES = Queries()

# Job metadata as columns, and the conditions that follow from it.
JOBS_SQL = (
    cte("jobs", "sources")
    + """
    , facts AS (SELECT *, json_extract_string(metadata, '$.run_status') AS run_status, CAST(json_extract_string(metadata, '$.attempts') AS INTEGER) AS attempts,
        coalesce(CAST(json_extract_string(metadata, '$.retried') AS BOOLEAN), FALSE) AS retried_flag, coalesce(CAST(json_extract_string(metadata, '$.skipped') AS BOOLEAN), FALSE) AS skipped_flag,
        json_extract_string(metadata, '$.next_cursor') AS next_cursor, json_extract_string(metadata, '$.reason') AS reason, coalesce(epoch_us(finished_at), 0) AS fin FROM jobs),
    j AS (SELECT *, retried_flag OR coalesce(attempts > 1, FALSE) AS is_retried, skipped_flag OR coalesce(run_status = 'skipped', FALSE) AS is_skipped FROM facts)
    """
)


def _add_filter(name: str, where: str, **filters) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return O.filter_jobs(X.jobs(spark, folder), **filters).select("id")

    QUERIES.add(name, JOBS_SQL + f"SELECT id FROM j WHERE {where}")(run)


_add_filter("jobs_retried", "is_retried", is_retried=True)
_add_filter("jobs_not_retried", "NOT is_retried", is_retried=False)
_add_filter("jobs_skipped", "is_skipped", is_skipped=True)
_add_filter("jobs_not_skipped", "NOT is_skipped", is_skipped=False)
_add_filter(
    "jobs_filtered", "source_id = 8 AND status = 'success' AND contains(job_name, 'pipeline') AND run_status = 'success'",
    source_id=8, status="success", job_name="PIPELINE", run_status="success",
)


@QUERIES.add(
    "job_rows",
    JOBS_SQL
    + f"""
    SELECT j.id AS id, j.run_status AS run_status, j.attempts AS attempts, j.is_retried AS is_retried, j.is_skipped AS is_skipped, s.name AS source_name, s.source_type AS source_type,
        CASE WHEN {sensitive('j.error_message')} THEN NULL ELSE j.error_message END AS error_message FROM j LEFT JOIN sources s ON s.id = j.source_id""",
)
def job_rows(spark: SparkSession, folder: str) -> DataFrame:
    return O.job_rows(X.jobs(spark, folder), X.sources(spark, folder)).select(
        "id", "run_status", "attempts", "is_retried", "is_skipped", "source_name", "source_type", "error_message"
    )


def _add_page(sort: str, order: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return S.page(X.jobs(spark, folder), S.JOB_ORDERS[sort](), 1, 60).select("id", "status")

    QUERIES.add(f"jobs_by_{sort}", cte("jobs") + f"SELECT id, status FROM jobs ORDER BY {order} LIMIT 60")(run)


_add_page("recent", "finished_at DESC NULLS LAST, started_at DESC NULLS LAST, id")
_add_page("started", "started_at DESC NULLS LAST, id")


@QUERIES.add(
    "job_summary",
    JOBS_SQL
    + """
    , latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fin DESC, started_at DESC, id) AS rn FROM j) WHERE rn = 1)
    SELECT j.source_id AS source_id, count(*) AS total, count(*) FILTER (j.status = 'success') AS success, count(*) FILTER (j.status = 'failed') AS failed,
        count(*) FILTER (j.is_skipped) AS skipped, count(*) FILTER (j.is_retried) AS retried, CAST(sum(j.items_seen) AS BIGINT) AS items_seen, CAST(sum(j.items_created) AS BIGINT) AS items_created,
        CAST(sum(j.items_updated) AS BIGINT) AS items_updated, any_value(l.id) AS latest_job_id, any_value(l.status) AS latest_job_status, any_value(l.run_status) AS latest_run_status,
        any_value(l.attempts) AS latest_attempts, any_value(l.is_retried) AS latest_retried, any_value(l.is_skipped) AS latest_skipped
    FROM j JOIN latest l ON l.source_id = j.source_id GROUP BY j.source_id""",
)
def job_summary(spark: SparkSession, folder: str) -> DataFrame:
    return O.job_summary(X.jobs(spark, folder)).drop("latest_started_at", "latest_finished_at", "latest_metadata")


_STATES_SQL = """
    , marks AS (SELECT source_id, max((fin, id)) FILTER (run_status = 'success') AS last_success FROM j GROUP BY source_id),
    states AS (SELECT j.source_id AS source_id, arg_max(next_cursor, (fin, id)) FILTER (run_status = 'success' AND next_cursor IS NOT NULL) AS cursor,
        arg_max(CASE WHEN run_status = 'failed' THEN 'failed' ELSE 'success' END, (fin, id)) AS status, epoch_us(max(finished_at)) AS last_run_us,
        count(*) FILTER (run_status = 'failed' AND (m.last_success IS NULL OR (fin, id) > m.last_success)) AS consecutive_failures
        FROM j JOIN marks m ON m.source_id = j.source_id GROUP BY j.source_id)
    """


@QUERIES.add("sync_states", JOBS_SQL + _STATES_SQL + "SELECT source_id, cursor, status, last_run_us, consecutive_failures FROM states")
def sync_states(spark: SparkSession, folder: str) -> DataFrame:
    states = O.sync_states(X.jobs(spark, folder))
    return states.select("source_id", "cursor", "status", F.unix_micros("last_run_at").alias("last_run_us"), "consecutive_failures")


@QUERIES.add("sync_states_in_two_steps", JOBS_SQL + _STATES_SQL + "SELECT source_id, cursor, consecutive_failures FROM states")
def sync_states_in_two_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The first half of the log, then the rest on top of its states."""
    jobs = X.jobs(spark, folder)
    early = F.coalesce("finished_at", F.timestamp_seconds(F.lit(0))) < F.lit("2024-01-15").cast("timestamp")
    first = O.sync_states(jobs.filter(early))
    return O.advance_states(first, jobs.filter(~early)).select("source_id", "cursor", "consecutive_failures")


@QUERIES.add(
    "updated_sources",
    JOBS_SQL
    + """
    , news AS (SELECT source_id, arg_max(CASE WHEN run_status = 'failed' THEN 'error' WHEN run_status = 'skipped' AND reason = 'disabled' THEN 'disabled' ELSE 'enabled' END, (fin, id)) AS status,
        arg_max(coalesce(epoch_us(finished_at), -1), (fin, id)) FILTER (run_status = 'success') AS ok_us, arg_max(coalesce(epoch_us(finished_at), -1), (fin, id)) FILTER (run_status = 'failed') AS bad_us FROM j GROUP BY source_id)
    SELECT s.id AS id, coalesce(n.status, s.status) AS status, coalesce(n.ok_us, -1) AS success_us, coalesce(n.bad_us, -1) AS error_us FROM sources s LEFT JOIN news n ON n.source_id = s.id""",
)
def updated_sources(spark: SparkSession, folder: str) -> DataFrame:
    never = F.lit(None).cast("timestamp")
    sources = X.sources(spark, folder).withColumns({"last_success_at": never, "last_error_at": never, "updated_at": never})
    after = O.update_sources(sources, X.jobs(spark, folder), F.lit("2024-02-01").cast("timestamp"))

    def micros(name: str):
        return F.coalesce(F.unix_micros(name), F.lit(-1))

    return after.select("id", "status", micros("last_success_at").alias("success_us"), micros("last_error_at").alias("error_us"))


@QUERIES.add(
    "source_status",
    JOBS_SQL
    + _STATES_SQL
    + """
    , failed AS (SELECT source_id, count(*) FILTER (status = 'failed') AS n FROM j GROUP BY source_id)
    SELECT s.id AS id, s.status = 'enabled' AS enabled, coalesce(t.consecutive_failures, f.n, 0) AS failure_count, 'https://feed' || s.id || '.example.test/list?page=2' AS base_url
    FROM sources s LEFT JOIN (SELECT * FROM states WHERE source_id % 2 = 0) t ON t.source_id = s.id LEFT JOIN failed f ON f.source_id = s.id""",
)
def source_status(spark: SparkSession, folder: str) -> DataFrame:
    """States are known for even sources only; the others fall back to counting failed jobs."""
    jobs = X.jobs(spark, folder)
    known = O.sync_states(jobs).filter(F.col("source_id") % 2 == 0)
    return O.source_status(X.sources(spark, folder), jobs, known).select("id", "enabled", "failure_count", "base_url")


@QUERIES.add(
    "sources_by_failures",
    cte("sources") + "SELECT id, name FROM sources ORDER BY (last_error_message IS NULL), nation DESC, name, id LIMIT 30",
)
def sources_by_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with an error first: the error time is the same for all, the update time follows the nation."""
    at = F.timestamp_seconds(F.col("nation").cast("long") * 1000)
    error_at = F.when(F.col("last_error_message").isNotNull(), F.timestamp_seconds(F.lit(5)))
    timed = X.sources(spark, folder).withColumns({"updated_at": at, "last_error_at": error_at})
    return S.page(timed, S.SOURCE_ORDERS["failures"](), 1, 30).select("id", "name")


@QUERIES.add("sources_by_name", cte("sources") + "SELECT id, name FROM sources ORDER BY name, id LIMIT 25")
def sources_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return S.page(X.sources(spark, folder), S.SOURCE_ORDERS["name"]()).select("id", "name")


@QUERIES.add(
    "processing_counts",
    cte("raw", "records", "alerts")
    + """
    SELECT 'pending_raw_rows' AS metric, count(*) FILTER (processing_status IN ('pending', 'collected')) AS value FROM raw
    UNION ALL SELECT 'failed_raw_rows', count(*) FILTER (processing_status = 'failed') FROM raw
    UNION ALL SELECT 'scoring_pending_intelligence_rows', count(*) FILTER (processing_status = 'normalized' AND (risk_score IS NULL OR risk_level = 'info')) FROM records
    UNION ALL SELECT 'open_alerts', count(*) FILTER (status = 'open') FROM alerts""",
)
def processing_counts(spark: SparkSession, folder: str) -> DataFrame:
    return O.pipeline_counts(X.view(spark, folder, "raw"), X.records(spark, folder), X.alerts(spark, folder))


@QUERIES.add(
    "latest_source_job",
    cte("jobs") + "SELECT id, status FROM jobs ORDER BY finished_at DESC NULLS LAST, created_at DESC, id LIMIT 1",
)
def latest_source_job(spark: SparkSession, folder: str) -> DataFrame:
    return O.latest_source_job(X.jobs(spark, folder)).select("id", "status")


@QUERIES.add(
    "latest_processing_job",
    cte("jobs") + "SELECT id, status FROM jobs WHERE job_name = 'process_pipeline' ORDER BY created_at DESC, id LIMIT 1",
)
def latest_processing_job(spark: SparkSession, folder: str) -> DataFrame:
    own = F.when(F.col("job_name") != "process_pipeline", F.col("source_id"))
    return O.latest_pipeline_job(X.jobs(spark, folder).withColumn("source_id", own)).select("id", "status")


@QUERIES.add(
    "recent_failures",
    cte("raw", "jobs")
    + """
    , r AS (SELECT 'raw' AS category, id, 1700000000000000 + doc_id * 60000000 AS at_us FROM raw WHERE processing_status = 'failed' ORDER BY at_us DESC, id LIMIT 5),
    f AS (SELECT 'job' AS category, CAST(id AS STRING) AS id, epoch_us(coalesce(finished_at, updated_at)) AS at_us FROM (SELECT * FROM jobs WHERE status = 'failed' ORDER BY updated_at DESC, id LIMIT 5))
    SELECT category, id, at_us FROM (SELECT * FROM r UNION ALL SELECT * FROM f) ORDER BY at_us DESC, category, id LIMIT 5""",
)
def recent_failures(spark: SparkSession, folder: str) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 60)
    raw = X.view(spark, folder, "raw").withColumn("updated_at", at)
    failures = O.recent_failures(raw, X.jobs(spark, folder), X.sources(spark, folder))
    return failures.select("category", "id", F.unix_micros("occurred_at").alias("at_us"))


@QUERIES.add(
    "stage_summary",
    cte("raw", "jobs")
    + """
    SELECT stage, count(*) AS seen, count(*) FILTER (status NOT IN ('failed', 'skipped')) AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped
    FROM (SELECT 'normalization' AS stage, processing_status AS status FROM raw UNION ALL SELECT 'collection', status FROM jobs) GROUP BY stage""",
)
def stage_summary(spark: SparkSession, folder: str) -> DataFrame:
    raw = X.view(spark, folder, "raw").select(F.lit("normalization").alias("stage"), F.col("processing_status").alias("status"))
    return O.stage_summary(raw.unionByName(X.jobs(spark, folder).select(F.lit("collection").alias("stage"), "status")))


@QUERIES.add(
    "run_outcomes",
    cte("sources")
    + """
    SELECT id, CASE WHEN status <> 'enabled' THEN 'disabled' WHEN source_type NOT IN ('rss', 'api') THEN 'connector_not_registered' END AS skip_reason FROM sources""",
)
def run_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    configs = X.sources(spark, folder).select("id", "name", F.col("source_type").alias("connector"), (F.col("status") == "enabled").alias("enabled"))
    return O.run_outcomes(configs, ["rss", "api"]).select("id", "skip_reason")


# Sources of the documents as configured ones: some are disabled, some fail, some need a third attempt.
_RUNS_SQL = (
    cte("raw")
    + """
    , timed AS (SELECT *, make_timestamp((1700000000 + doc_id * 60) * 1000000) AS fetched_at, TRY_CAST(substr(source_id, 4) AS INTEGER) % 5 AS turn FROM raw WHERE source_id IS NOT NULL),
    runs AS (SELECT source_id, CASE WHEN turn = 2 THEN 'skipped' WHEN turn = 1 THEN 'failed' ELSE 'success' END AS run_status, CASE WHEN turn = 3 THEN 3 ELSE 1 END AS attempts,
        count(*) AS n, max(fetched_at) AS newest FROM timed GROUP BY 1, 2, 3),
    held AS (SELECT DISTINCT source_id, external_id FROM raw WHERE doc_id % 2 = 0),
    came AS (SELECT DISTINCT source_id, external_id FROM raw WHERE error_message IS NULL),
    items AS (SELECT c.source_id, count(*) FILTER (h.source_id IS NULL) AS created, count(h.source_id) AS updated
        FROM came c LEFT JOIN held h ON h.source_id = c.source_id AND h.external_id = c.external_id GROUP BY 1)
    """
)


def _persisted(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All documents collected on top of the even ones, by sources that failed twice before."""
    # The columns of the raw table; the view has the document's text and length beside them.
    raw = X.raw(spark, folder).select(*empty(spark, "raw_intelligence").columns, "doc_id")
    held = upsert_raw(raw.limit(0), raw.filter(F.col("doc_id") % 2 == 0)).drop("action")
    turn = F.expr("try_cast(substr(source_id, 4) AS int) % 5")
    names = raw.select("source_id").dropna().distinct()
    configs = names.select(
        "source_id",
        F.when(turn == 2, F.lit("disabled")).alias("skip_reason"),
        F.when(turn == 1, F.lit("feed gives no answer")).alias("error_message"),
        F.when(turn == 3, F.lit(3)).otherwise(F.lit(1)).alias("attempts"),
    )
    moment, never = F.lit("2024-06-01").cast("timestamp"), F.lit(None).cast("timestamp")
    sources = names.select(
        F.col("source_id").alias("id"), F.lit("enabled").alias("status"), never.alias("last_success_at"),
        never.alias("last_error_at"), F.lit("old trouble").alias("last_error_message"), never.alias("updated_at"),
    )
    states = names.select(
        "source_id", F.lit("start").alias("cursor"), F.lit("failed").alias("status"),
        F.lit("2023-01-01").cast("timestamp").alias("last_run_at"), F.lit(2).cast("long").alias("consecutive_failures"),
    )
    tables = {"raw_intelligence": held, "job_logs": empty(spark, "job_logs"), "sources": sources, "sync_states": states}
    return persist_runs(tables, raw, O.source_runs(configs, raw, moment, moment), moment)


@QUERIES.add(
    "run_job_log",
    _RUNS_SQL
    + """
    SELECT r.source_id AS source_id, CASE run_status WHEN 'failed' THEN 'failed' ELSE 'success' END AS status, run_status, attempts, CASE run_status WHEN 'success' THEN n ELSE 0 END AS items_seen,
        CASE run_status WHEN 'success' THEN coalesce(created, 0) ELSE 0 END AS items_created, CASE run_status WHEN 'success' THEN coalesce(updated, 0) ELSE 0 END AS items_updated,
        CASE run_status WHEN 'failed' THEN 'feed gives no answer' END AS error_message, CASE run_status WHEN 'success' THEN CAST(newest AS VARCHAR) END AS next_cursor,
        CASE run_status WHEN 'skipped' THEN 'disabled' END AS reason
    FROM runs r LEFT JOIN items i ON i.source_id = r.source_id""",
)
def run_job_log(spark: SparkSession, folder: str) -> DataFrame:
    log = O.with_job_facts(_persisted(spark, folder)["job_logs"])
    return log.select(
        "source_id", "status", "run_status", "attempts", "items_seen", "items_created", "items_updated", "error_message",
        job_text("metadata", "next_cursor").alias("next_cursor"), job_text("metadata", "reason").alias("reason"),
    )


@QUERIES.add(
    "run_sync_states",
    _RUNS_SQL
    + """
    SELECT source_id, CASE run_status WHEN 'success' THEN CAST(newest AS VARCHAR) ELSE 'start' END AS cursor, CASE run_status WHEN 'failed' THEN 'failed' ELSE 'success' END AS status,
        CASE run_status WHEN 'success' THEN 0 WHEN 'failed' THEN 3 ELSE 2 END AS consecutive_failures FROM runs""",
)
def run_sync_states(spark: SparkSession, folder: str) -> DataFrame:
    return _persisted(spark, folder)["sync_states"].select("source_id", "cursor", "status", "consecutive_failures")


@QUERIES.add(
    "run_source_status",
    _RUNS_SQL
    + """
    SELECT source_id AS id, CASE run_status WHEN 'success' THEN 'enabled' WHEN 'failed' THEN 'error' ELSE 'disabled' END AS status, run_status = 'success' AS has_success, run_status = 'failed' AS has_error,
        CASE run_status WHEN 'failed' THEN 'feed gives no answer' WHEN 'skipped' THEN 'old trouble' END AS last_error_message FROM runs""",
)
def run_source_status(spark: SparkSession, folder: str) -> DataFrame:
    return _persisted(spark, folder)["sources"].select(
        "id", "status", F.col("last_success_at").isNotNull().alias("has_success"), F.col("last_error_at").isNotNull().alias("has_error"), "last_error_message"
    )


@QUERIES.add(
    "jobs_of_days",
    cte("jobs")
    + """
    SELECT status, CAST(finished_at AS DATE) AS day, count(*) AS n, CAST(sum(items_seen) AS BIGINT) AS items_seen FROM jobs
    WHERE CAST(finished_at AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' GROUP BY 1, 2""",
)
def jobs_of_days(spark: SparkSession, folder: str) -> DataFrame:
    """The job log as the engine's own table in folders of days; the scan reads the folders of five."""
    out = scratch_folder(spark, "tables")
    columns = [F.col(field.name).cast(field.dataType) for field in empty(spark, "job_logs").schema]
    write(X.jobs(spark, folder).select(*columns), out, "job_logs")
    days = scan(spark, out, "job_logs").filter(F.col("day").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-12").cast("date")))
    return days.groupBy("status", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("items_seen").alias("items_seen"))
