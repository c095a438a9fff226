"""Source health, job history and pipeline status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.functions.nested import job_flag, job_int, job_text
from fleetsight.functions.redact import safe_text
from fleetsight.functions.text import contains_ignoring_case
from fleetsight.functions.urls import safe_url
from fleetsight.operators.score import unscored
from fleetsight.sources.envelope import string_map

HOUR_MICROS = 3_600_000_000


# --- job filters ------------------------------------------------------------
def retried(expected: bool = True) -> Column:
    """Flag or more than one attempt; the negation keeps rows without either."""
    flag, attempts = job_flag("metadata", "retried"), job_int("metadata", "attempts")
    if expected:
        return F.coalesce(flag, F.lit(False)) | F.coalesce(attempts > 1, F.lit(False))
    return ~F.coalesce(flag, F.lit(False)) & (attempts.isNull() | (attempts <= 1))


def skipped(expected: bool = True) -> Column:
    """Flag or run status ``skipped``; the negation keeps rows without either."""
    flag, status = job_flag("metadata", "skipped"), job_text("metadata", "run_status")
    if expected:
        return F.coalesce(flag, F.lit(False)) | F.coalesce(status == "skipped", F.lit(False))
    return ~F.coalesce(flag, F.lit(False)) & (status.isNull() | (status != "skipped"))


def filter_jobs(
    jobs: DataFrame,
    source_id=None,
    status: str | None = None,
    job_name: str | None = None,
    run_status: str | None = None,
    is_retried: bool | None = None,
    is_skipped: bool | None = None,
) -> DataFrame:
    if source_id is not None:
        jobs = jobs.filter(F.col("source_id") == source_id)
    if status:
        jobs = jobs.filter(F.col("status") == status)
    if job_name:
        jobs = jobs.filter(contains_ignoring_case("job_name", job_name))
    if run_status:
        jobs = jobs.filter(job_text("metadata", "run_status") == run_status)
    if is_retried is not None:
        jobs = jobs.filter(retried(is_retried))
    if is_skipped is not None:
        jobs = jobs.filter(skipped(is_skipped))
    return jobs


JOB_FACTS = ("run_status", "attempts", "retried", "skipped", "reason", "next_cursor")


def with_job_facts(jobs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Jobs with run status, attempts and flags from their JSON metadata, which is parsed once; ``also`` names further keys."""
    parsed = jobs.select("*", F.json_tuple("metadata", *JOB_FACTS).alias(*[f"_{name}" for name in JOB_FACTS]))
    flag = lambda name: F.coalesce(F.col(name).try_cast("boolean"), F.lit(False))
    attempts = F.col("_attempts").try_cast("int")
    return parsed.withColumns(
        {
            "run_status": F.col("_run_status"),
            "attempts": attempts,
            "is_retried": flag("_retried") | F.coalesce(attempts > 1, F.lit(False)),
            "is_skipped": flag("_skipped") | F.coalesce(F.col("_run_status") == "skipped", F.lit(False)),
            **{name: F.col(f"_{name}") for name in also},
        }
    ).drop(*[f"_{name}" for name in JOB_FACTS])


def job_rows(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs beside the name and type of their source; jobs without one stay."""
    named = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_type")
    return with_job_facts(jobs).withColumn("error_message", safe_text("error_message")).join(named, "source_id", "left")


# --- per source ---------------------------------------------------------------
def _micros(name: str) -> Column:
    return F.coalesce(F.unix_micros(name), F.lit(0))


def latest_first(*times: str) -> Column:
    """Ascending struct that puts the latest row first and breaks ties by id."""
    return F.struct(*[(-_micros(name)).alias(name) for name in times], F.col("id"))


LATEST_FIELDS = {
    "latest_job_id": "id", "latest_job_status": "status", "latest_run_status": "run_status",
    "latest_started_at": "started_at", "latest_finished_at": "finished_at", "latest_attempts": "attempts",
    "latest_retried": "is_retried", "latest_skipped": "is_skipped", "latest_metadata": "metadata",
}


def job_summary(jobs: DataFrame) -> DataFrame:
    """Counts, sums and the latest job per source, in one grouping with a map-side part."""
    facts = with_job_facts(jobs.filter(F.col("source_id").isNotNull()))
    latest = F.struct(*[F.col(column).alias(name) for name, column in LATEST_FIELDS.items()])
    return (
        facts.groupBy("source_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("status") == "success").alias("success"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.count_if("is_skipped").alias("skipped"),
            F.count_if("is_retried").alias("retried"),
            *[F.sum(F.coalesce(name, F.lit(0))).alias(name) for name in ("items_seen", "items_created", "items_updated")],
            F.min_by(latest, latest_first("finished_at", "started_at")).alias("latest"),
        )
        .select("source_id", "total", "success", "failed", "skipped", "retried", "items_seen", "items_created", "items_updated", "latest.*")
    )


def _run_order() -> Column:
    return F.struct(_micros("finished_at").alias("finished"), F.col("id"))


def _run_summaries(jobs: DataFrame) -> DataFrame:
    """``source_id, cursor, status, last_run_at, failures, any_success`` of all runs of a source.

    Runs are summed up by source and hour, and the hours of a source in their order: what a stretch of runs
    leaves behind is whether it had a success and the failures after its last one. Runs are read once and are
    not joined back, and no group holds more than the runs of an hour or the hours of a source.
    """
    runs = with_job_facts(jobs.filter(F.col("source_id").isNotNull()), ("next_cursor",)).select(
        "source_id",
        F.floor(_micros("finished_at") / HOUR_MICROS).alias("hour"),
        _run_order().alias("ord"),
        "finished_at",
        F.coalesce(F.col("run_status") == "success", F.lit(False)).alias("succeeded"),
        F.coalesce(F.col("run_status") == "failed", F.lit(False)).alias("failed"),
        "next_cursor",
    )
    onwards = Window.partitionBy("source_id", "hour").orderBy(F.desc("ord"))
    hours = (
        runs.withColumn("ended", F.max("succeeded").over(onwards))
        .groupBy("source_id", "hour")
        .agg(
            F.count_if(F.col("failed") & ~F.col("ended")).alias("failures"),
            F.max("succeeded").alias("any_success"),
            F.max_by("next_cursor", F.when(F.col("succeeded") & F.col("next_cursor").isNotNull(), F.col("ord"))).alias("cursor"),
            F.max_by(F.when(F.col("failed"), F.lit("failed")).otherwise(F.lit("success")), "ord").alias("status"),
            F.max("finished_at").alias("last_run_at"),
        )
    )
    later = Window.partitionBy("source_id").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        hours.withColumn("ended", F.coalesce(F.max("any_success").over(later), F.lit(False)))
        .groupBy("source_id")
        .agg(
            F.max_by("cursor", F.when(F.col("cursor").isNotNull(), F.col("hour"))).alias("cursor"),
            F.max_by("status", "hour").alias("status"),
            F.max("last_run_at").alias("last_run_at"),
            F.sum(F.when(F.col("ended"), F.lit(0)).otherwise(F.col("failures"))).alias("failures"),
            F.max("any_success").alias("any_success"),
        )
    )


def sync_states(jobs: DataFrame) -> DataFrame:
    """State per source after all its runs: failures since the last success, cursor, last run.

    A success resets the counter, a failure adds one, a skipped run changes neither counter nor cursor.
    """
    return _run_summaries(jobs).select(
        "source_id", "cursor", "status", "last_run_at", F.col("failures").alias("consecutive_failures")
    )


def advance_states(states: DataFrame, jobs: DataFrame) -> DataFrame:
    """States after further runs: the incremental form of :func:`sync_states`."""
    fresh = _run_summaries(jobs).withColumnsRenamed({name: f"new_{name}" for name in ("cursor", "status", "last_run_at")})
    joined = states.join(fresh, "source_id", "full_outer")
    carried = F.when(F.col("any_success"), F.lit(0)).otherwise(F.coalesce("consecutive_failures", F.lit(0)))
    return joined.select(
        "source_id",
        F.coalesce("new_cursor", "cursor").alias("cursor"),
        F.coalesce("new_status", "status").alias("status"),
        F.greatest("new_last_run_at", "last_run_at").alias("last_run_at"),
        (carried + F.coalesce("failures", F.lit(0))).alias("consecutive_failures"),
    )


def update_sources(sources: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Sources with status, last success and last error taken from their runs."""
    runs = with_job_facts(jobs.filter(F.col("source_id").isNotNull()), ("reason",)).withColumn("ord", _run_order())
    succeeded, failed = F.col("run_status") == "success", F.col("run_status") == "failed"
    disabled = (F.col("run_status") == "skipped") & (F.col("reason") == "disabled")
    after = (
        F.when(failed, F.lit("error")).when(F.coalesce(disabled, F.lit(False)), F.lit("disabled")).otherwise(F.lit("enabled"))
    )
    ran = succeeded | failed
    news = runs.groupBy(F.col("source_id").alias("id")).agg(
        F.max_by(after, "ord").alias("new_status"),
        F.max_by("finished_at", F.when(succeeded, F.col("ord"))).alias("new_success"),
        F.max_by("finished_at", F.when(failed, F.col("ord"))).alias("new_error"),
        F.max_by(
            F.struct(succeeded.alias("cleared"), F.col("error_message").alias("message")), F.when(ran, F.col("ord"))
        ).alias("outcome"),
    )
    seen = F.col("new_status").isNotNull()
    message = (
        F.when(F.col("outcome").isNull(), F.col("last_error_message"))
        .when(F.col("outcome.cleared"), F.lit(None))
        .otherwise(F.col("outcome.message"))
    )
    return (
        sources.join(news, "id", "left")
        .withColumns(
            {
                "status": F.coalesce("new_status", "status"),
                "last_success_at": F.coalesce("new_success", "last_success_at"),
                "last_error_at": F.coalesce("new_error", "last_error_at"),
                "last_error_message": message,
                "updated_at": F.when(seen, now).otherwise(F.col("updated_at")),
            }
        )
        .drop("new_status", "new_success", "new_error", "outcome")
    )


def source_status(sources: DataFrame, jobs: DataFrame, states: DataFrame) -> DataFrame:
    """Sources with failure count and job summary; a known state beats counting failed jobs."""
    counted = states.select("source_id", "consecutive_failures", "cursor")
    summary = job_summary(jobs)
    return (
        sources.withColumn("source_id", F.col("id"))
        .join(summary, "source_id", "left")
        .join(counted, "source_id", "left")
        .withColumns(
            {
                "failure_count": F.coalesce("consecutive_failures", "failed", F.lit(0)),
                "last_error_message": safe_text("last_error_message"),
                "base_url": safe_url("base_url"),
                "cursor": safe_text("cursor"),
                "enabled": F.col("status") == "enabled",
            }
        )
        .drop("source_id", "consecutive_failures")
    )


# --- runs ---------------------------------------------------------------------
def run_outcomes(configs: DataFrame, connectors: list[str]) -> DataFrame:
    """Which configured sources run; the others are skipped with a reason."""
    known = F.coalesce(F.col("connector"), F.col("name")).isin(*connectors) if connectors else F.lit(False)
    reason = F.when(~F.col("enabled"), F.lit("disabled")).when(~known, F.lit("connector_not_registered"))
    return configs.withColumn("skip_reason", reason)


def source_runs(configs: DataFrame, incoming: DataFrame, started: Column, finished: Column, cursor: str = "fetched_at") -> DataFrame:
    """One run per configured source, from what it collected.

    ``configs`` has source_id, skip_reason, error_message and attempts. A source with a reason is skipped, one with an
    error failed; neither has seen anything nor moves its cursor, the highest ``cursor`` value seen.
    """
    seen = incoming.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max(cursor).cast("string").alias("highest"))
    ran = F.col("status") == "success"
    status = F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("error_message").isNotNull(), "failed").otherwise("success")
    return configs.join(seen, "source_id", "left").withColumn("status", status).select(
        "source_id",
        "status",
        "attempts",
        F.when(ran, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("items_seen"),
        F.when(ran, F.col("highest")).alias("next_cursor"),
        F.col("skip_reason").alias("reason"),
        F.when(F.col("status") == "failed", F.col("error_message")).alias("error_message"),
        started.alias("started_at"),
        finished.alias("finished_at"),
    )


def job_log(runs: DataFrame, actions: DataFrame, now: Column, job_name: str = K.SYNC_JOB) -> DataFrame:
    """One log row per source run.

    ``runs`` has source_id, status, attempts, items_seen, next_cursor, reason, error_message, started_at and
    finished_at; ``actions`` is the outcome of the raw upsert (source_id, action).
    """
    counts = actions.groupBy("source_id").agg(
        F.count_if(F.col("action") == "created").alias("items_created"),
        F.count_if(F.col("action") == "updated").alias("items_updated"),
    )
    metadata = F.map_filter(
        string_map(
            {
                "reason": F.col("reason"),
                "run_status": F.col("status"),
                "attempts": F.col("attempts"),
                "next_cursor": F.col("next_cursor"),
                "skipped": F.when(F.col("status") == "skipped", F.lit("true")),
                "retried": F.when(F.col("attempts") > 1, F.lit("true")),
            }
        ),
        lambda _key, value: value.isNotNull(),
    )
    return runs.join(counts, "source_id", "left").select(
        F.sha2(F.concat_ws("|", F.lit("job"), F.col("source_id").cast("string"), F.col("started_at").cast("string")), 256).alias("id"),
        F.lit(job_name).alias("job_name"),
        "source_id",
        F.when(F.col("status") == "failed", F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        "started_at",
        "finished_at",
        F.coalesce("items_seen", F.lit(0)).cast("long").alias("items_seen"),
        F.coalesce("items_created", F.lit(0)).alias("items_created"),
        F.coalesce("items_updated", F.lit(0)).alias("items_updated"),
        "error_message",
        F.to_json(metadata).alias("metadata"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


# --- pipeline -------------------------------------------------------------------
def _metric(frame: DataFrame, name: str, condition: Column) -> DataFrame:
    return frame.agg(F.count_if(condition).alias("value")).select(F.lit(name).alias("metric"), "value")


def pipeline_counts(raw: DataFrame, records: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rows (metric, value): what waits, what failed, what is open."""
    by_status = raw.groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))
    raw_counts = by_status.agg(
        F.coalesce(F.sum(F.when(F.col("processing_status").isin("pending", "collected"), F.col("n"))), F.lit(0)).alias("pending"),
        F.coalesce(F.sum(F.when(F.col("processing_status") == "failed", F.col("n"))), F.lit(0)).alias("failed"),
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("pending_raw_rows").alias("metric"), F.col("pending").alias("value")),
                F.struct(F.lit("failed_raw_rows").alias("metric"), F.col("failed").alias("value")),
            )
        )
    )
    waiting = (F.col("processing_status") == "normalized") & unscored()
    return raw_counts.unionByName(_metric(records, "scoring_pending_intelligence_rows", waiting)).unionByName(
        _metric(alerts, "open_alerts", F.col("status") == "open")
    )


def latest_pipeline_job(jobs: DataFrame, job_name: str = K.PIPELINE_JOB) -> DataFrame:
    mine = jobs.filter(F.col("source_id").isNull() & (F.col("job_name") == job_name))
    return mine.orderBy(F.desc("created_at"), "id").limit(1)


def latest_source_job(jobs: DataFrame) -> DataFrame:
    mine = jobs.filter(F.col("source_id").isNotNull())
    return mine.orderBy(F.desc_nulls_last("finished_at"), F.desc("created_at"), "id").limit(1)


def _newest(frame: DataFrame, limit: int) -> DataFrame:
    return frame.orderBy(F.desc("updated_at"), "id").limit(limit)


def recent_failures(raw: DataFrame, jobs: DataFrame, sources: DataFrame, limit: int = K.RECENT_FAILURES) -> DataFrame:
    """Newest failures of both kinds in one list; each side is cut to the newest first."""
    raw_side = _newest(raw.filter(F.col("processing_status") == "failed"), limit).select(
        F.lit("raw").alias("category"),
        F.col("id").cast("string").alias("id"),
        F.col("source_id").cast("string").alias("source_id"),
        safe_text("source_name").alias("source_name"),
        safe_url("source_url").alias("source_url"),
        F.col("processing_status").alias("status"),
        F.col("parsing_status").alias("stage"),
        safe_text("error_message").alias("error_message"),
        F.col("updated_at").alias("occurred_at"),
    )
    named = sources.select(F.col("id").alias("source_id"), safe_text("name").alias("source_name"), safe_url("base_url").alias("source_url"))
    job_side = (
        _newest(jobs.filter(F.col("status") == "failed"), limit)
        .join(named, "source_id", "left")
        .select(
            F.lit("job").alias("category"),
            F.col("id").cast("string").alias("id"),
            F.col("source_id").cast("string").alias("source_id"),
            "source_name",
            "source_url",
            "status",
            job_text("metadata", "run_status").alias("stage"),
            safe_text("error_message").alias("error_message"),
            F.coalesce("finished_at", "updated_at").alias("occurred_at"),
        )
    )
    return raw_side.unionByName(job_side).orderBy(F.desc("occurred_at"), "category", "id").limit(limit)


def stage_summary(outcomes: DataFrame) -> DataFrame:
    """Rows per stage: seen, succeeded, failed, skipped. ``outcomes`` has stage and status."""
    return outcomes.groupBy("stage").agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(~F.col("status").isin("failed", "skipped")).alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )
