"""Keyed stream state: any order of arrival, restarts, batches that run again, watermarks that pass."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetsight.operators import alerts as A
from fleetsight.operators import ops as O
from fleetsight.streaming import jobs as J
from fleetsight.streaming import state

START = datetime(2025, 3, 1, 12)
RECORDS = "id long, risk_level string, affected_vendor string, vehicle_component string, attack_surface string, first_seen_at timestamp"


def records(spark, rows):
    return spark.createDataFrame([(i, risk, vendor, part, None, START + timedelta(hours=hours)) for i, risk, vendor, part, hours in rows], RECORDS)


ROWS = [
    (1, "high", "Acme", "tbox", 0), (2, "critical", "acme", None, 30), (3, "high", "ACME", "tbox", 167.5), (4, "low", "acme", "tbox", 168),
    (5, "high", "acme", None, 168.001), (6, "high", "acme", "tbox", 300), (7, None, "acme", None, 20), (8, "critical", "Other", "tbox", 90),
    (9, "high", "", None, 5), (10, "high", None, "tbox", 100), (11, "high", "acme", None, 30), (12, "info", "acme", "tbox", 700),
]


def found(frame):
    return sorted((int(row["id"]), row["scope"], row["value"], row["match_count"], row["first_seen_at"]) for row in frame.collect())


def run_bursts(spark, tmp_path, batches, delay="90 days", **layout):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    detector = state.BurstDetector(spark, str(tmp_path / "found"))
    for batch in batches:
        records(spark, batch).coalesce(1).write.mode("append").parquet(landing)
        # A new query each time, as after a restart.
        stream = J.table_stream(spark, landing, RECORDS, files_per_batch=1)
        J.run_available(state.burst_counts(stream, delay, **layout), checkpoint, detector.handle, "update").awaitTermination()
    return detector


@pytest.mark.parametrize("block_hours", [24, 168])
def test_bursts_in_any_order_equal_the_batch_rule(spark, tmp_path, block_hours):
    detector = run_bursts(spark, tmp_path, [ROWS[8:], ROWS[:4], ROWS[4:8]], block_hours=block_hours)
    whole = records(spark, ROWS)
    want = found(A.bursts(whole, whole))
    assert found(detector.bursts()) == want and len(want) >= 4


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    detector = run_bursts(spark, tmp_path, [ROWS[:6], ROWS[6:]])
    before = found(detector.bursts())
    again = spark.read.parquet(f"{tmp_path}/found/batch=1").collect()
    detector.handle(spark.createDataFrame(again, state._BURSTS), 1)
    assert found(detector.bursts()) == before


def test_state_goes_with_the_watermark(spark, tmp_path):
    later = [(100 + k, "high", "acme", None, 2000 + k) for k in range(3)]
    detector = run_bursts(spark, tmp_path, [ROWS, later, [(200, "high", "acme", None, 2100)]], delay="1 hour")
    # Far more than seven days on, old rows count no more and new ones do.
    assert {row[0]: row[3] for row in found(detector.bursts()) if row[0] >= 100} == {102: 3, 200: 4}


def test_blocks_must_divide_the_span(spark, tmp_path):
    with pytest.raises(ValueError):
        state.burst_counts(records(spark, ROWS), "1 day", block_hours=25)


JOBS = "id string, source_id string, status string, finished_at timestamp, metadata string"


def jobs(spark, rows):
    made = []
    for i, source, run, hours, cursor in rows:
        more = f',"next_cursor":"{cursor}"' if cursor else ""
        made.append((i, source, "failed" if run == "failed" else "success", None if hours is None else START + timedelta(hours=hours), f'{{"run_status":"{run}"{more}}}'))
    return spark.createDataFrame(made, JOBS)


RUNS = [
    ("a", "s", "failed", 1, None), ("b", "s", "success", 2, "c2"), ("c", "s", "failed", 3, None), ("d", "s", "failed", 4, None),
    ("e", "s", "skipped", 5, None), ("f", "t", "failed", 1, None), ("g", "t", "failed", None, None), ("h", "u", "success", 1, None),
    ("i", "u", "success", 9, "c9"), ("j", "u", "failed", 7, None), ("k", None, "failed", 7, None), ("l", "s", "failed", 4, None),
]


def test_health_with_late_and_repeated_runs(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    health = state.SourceHealth(spark, "string", str(tmp_path / "health"))
    for batch in (RUNS[4:], RUNS[2:6], RUNS[:3]):
        jobs(spark, batch).coalesce(1).write.mode("append").parquet(landing)
        stream = J.table_stream(spark, landing, JOBS, files_per_batch=1)
        J.run_available(state.source_health(stream), checkpoint, health.handle, "update").awaitTermination()
    columns = ("source_id", "cursor", "status", "last_run_at", "consecutive_failures")
    got = sorted(tuple(row) for row in health.states().select(*columns).collect())
    assert got == sorted(tuple(row) for row in O.sync_states(jobs(spark, RUNS)).select(*columns).collect())
    assert {row[0]: row[4] for row in got} == {"s": 3, "t": 2, "u": 0}
