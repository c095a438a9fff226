"""The whole batch run: landed feeds to raw rows, records, links, scores and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight.operators import alerts as A
from fleetsight.operators import merge as M
from fleetsight.operators import normalize as N
from fleetsight.operators import ops as O
from fleetsight.operators import score as S
from fleetsight.operators.raw_upsert import upsert_raw
from fleetsight.session import checkpointed
from fleetsight.sources import registry as R
from fleetsight.sources.envelope import split_errors


def collect(spark: SparkSession, landed: Mapping[str, str]) -> DataFrame:
    """Raw rows of all landed feeds (reader key -> path)."""
    return reduce(DataFrame.unionByName, [R.read(spark, key, path) for key, path in landed.items()])


def persist_runs(tables: Mapping[str, DataFrame], incoming: DataFrame, runs: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What a collection leaves behind: raw rows with their ``action``, rejected rows, job log, sources and sync states.

    ``runs`` has one row per source run, as ``ops.source_runs`` gives them. Rows of runs that did not succeed and rows
    of no run are not kept. ``tables`` has raw_intelligence, job_logs, sources and sync_states. An item that a run
    brings twice is counted once.
    """
    runs = checkpointed(runs)
    succeeded = runs.filter(F.col("status") == "success").select("source_id")
    valid, rejected = split_errors(checkpointed(incoming.join(succeeded, "source_id", "left_semi")))
    raw = checkpointed(upsert_raw(tables["raw_intelligence"], valid))
    actions = raw.filter(F.col("action") != "unchanged").select("source_id", "action")
    log = checkpointed(O.job_log(runs, actions, now))
    return {
        "raw_intelligence": raw,
        "rejected": rejected,
        "job_logs": tables["job_logs"].unionByName(log),
        "sources": O.update_sources(tables["sources"], log, now),
        "sync_states": O.advance_states(tables["sync_states"], log),
    }


def run(
    tables: Mapping[str, DataFrame],
    incoming: DataFrame,
    now: Column,
    registry: N.Registry | None = None,
    config: S.ScoringConfig = S.ScoringConfig(),
    rules: Sequence[A.Rule] = A.RULES,
    runs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """New versions of the tables, and a summary per stage.

    ``tables`` has raw_intelligence, threat_intelligence, threat_intelligence_sources and
    alerts. Every stage is written once to the shared folder before the next one reads it;
    the caller decides where the results go. With ``runs`` the run records itself (:func:`persist_runs`).
    """
    if runs is None:
        valid, rejected = split_errors(checkpointed(incoming))
        collected = {"raw_intelligence": checkpointed(upsert_raw(tables["raw_intelligence"], valid)), "rejected": rejected}
    else:
        collected = persist_runs(tables, incoming, runs, now)
    raw, rejected = collected["raw_intelligence"], collected["rejected"]
    pending = N.pending(raw.drop("action"))
    normalized = checkpointed(N.normalize(pending, registry))
    good, _failed = N.split_normalized(normalized)
    merged = checkpointed(M.upsert_records(tables["threat_intelligence"], good, now))
    links = checkpointed(M.upsert_links(tables["threat_intelligence_sources"], good, merged))
    scored = checkpointed(S.score_table(merged.drop("action"), config, now=now))
    records = scored.drop("score_action")
    fresh = checkpointed(A.evaluate_alerts(records, links, tables["alerts"], now, rules=rules))
    outcomes = reduce(
        DataFrame.unionByName,
        [
            raw.filter(F.col("action") != "unchanged").select(F.lit("collection").alias("stage"), F.col("action").alias("status")),
            rejected.select(F.lit("collection").alias("stage"), F.lit("failed").alias("status")),
            normalized.select(
                F.lit("normalization").alias("stage"),
                F.when(F.col("error_message").isNull(), F.lit("normalized")).otherwise(F.lit("failed")).alias("status"),
            ),
            scored.select(F.lit("scoring").alias("stage"), F.col("score_action").alias("status")),
            fresh.select(F.lit("alerts").alias("stage"), F.lit("created").alias("status")),
        ],
    )
    return {
        **collected,
        "raw_intelligence": N.mark_processed(raw.drop("action"), normalized),
        "threat_intelligence": records,
        "threat_intelligence_sources": links,
        "alerts": tables["alerts"].unionByName(fresh),
        "summary": O.stage_summary(outcomes),
    }
