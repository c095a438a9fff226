"""Known results for what went wrong before: repeated ids, lost metadata names, text that is not JSON, local folders."""

import pytest
from pyspark.sql import functions as F

from fleetsight import session
from fleetsight.functions import redact
from fleetsight.operators import merge, raw_upsert
from fleetsight.sources import cve, envelope, kev

RAW = "id string, source_id long, external_id string, raw_hash string, fetched_at timestamp, created_at timestamp"


def test_two_rows_of_a_batch_that_reach_one_known_row_become_one(spark):
    day = lambda n: F.to_timestamp(F.lit(f"2024-01-0{n}"))
    known = spark.createDataFrame([("K", 1, "e1", "h1", None, None)], RAW).withColumns({"fetched_at": day(1), "created_at": day(1)})
    batch = spark.createDataFrame([("A", 1, "e1", "h9", None, None), ("B", 2, "e2", "h1", None, None), ("C", 3, "e3", "h3", None, None)], RAW)
    batch = batch.withColumns({"fetched_at": F.when(F.col("id") == "A", day(3)).otherwise(day(2)), "created_at": day(2)})
    got = {row.id: row for row in raw_upsert.upsert_raw(known, batch).collect()}
    assert set(got) == {"K", "C"} and got["K"].raw_hash == "h9" and got["K"].action == "updated"
    assert got["K"].created_at.day == 1 and got["C"].action == "created"


def test_merging_keeps_names_of_any_mapping(spark):
    rows = spark.createDataFrame(
        [("d", 1, {"a": "1", "mine": None}), ("d", 2, {"a": "2", "mine": "x"}), ("e", 1, None)], "dedup_key string, ord int, metadata map<string,string>"
    )
    assert {tuple(row) for row in merge.merged_metadata(rows).collect()} == {("d", "a", "1"), ("d", "mine", "x")}


def test_text_that_is_not_json_is_null_and_lists_are_whole(spark):
    texts = ["{bad", "[" + ", ".join(map(str, range(90))) + "]", None]
    rows = spark.createDataFrame([(text,) for text in texts], "t string").select(redact.safe_json("t").alias("t")).collect()
    assert rows[0].t is None and rows[1].t.count(",") == 89 and rows[2].t is None


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_folder(Session(), "rows")
    assert session.is_local("local[4]") and not session.is_local("local-cluster[2,1,900]")


def test_pages_that_do_not_parse_give_a_row_with_an_error(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"vulnerabilities": [{"cve": {"id": "CVE-2031-70710"}}]}')
    (tmp_path / "none.json").write_text('{"vulnerabilities": []}')
    (tmp_path / "cut.json").write_text('{"vulnerabilities": [{"cve": ')
    for reader in (cve.read_cve_feed, kev.read_kev):
        rows = reader(spark, str(tmp_path)).collect()
        assert len(rows) == 2 and len({row.id for row in rows}) == 2
        failed = [row for row in rows if row.error_message == envelope.PAGE_ERROR]
        assert len(failed) == 1 and failed[0].source_url.endswith("cut.json") and failed[0].external_id is None


def test_long_notes_are_refused_only_if_asked_for(spark):
    from fleetsight.operators import changes as C

    alerts = spark.createDataFrame([("a", "open", None, "r", "t")], "id string, status string, notes string, triggering_rule string, threat_intelligence_id string")
    columns = "id string, status string, notes string, notes_supplied boolean, arrival int"
    changes = spark.createDataFrame([("a", "closed", "x" * 5000, True, 1), ("z", "open", None, False, 2)], columns)
    now = F.lit("2026-01-01").cast("timestamp")
    after, _, rejected = C.apply_alert_status(alerts, changes, now)
    assert after.first().status == "closed" and len(after.first().notes) == 5000 and rejected.isEmpty()
    after, _, rejected = C.apply_alert_status(alerts, changes, now, sizes=True)
    assert after.first().status == "open" and [row.arrival for row in rejected.collect()] == [1]
    assert [row.arrival for row in C.unknown_ids(alerts, changes).collect()] == [2]


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    from pyspark.sql import functions as F

    from fleetsight.operators.raw_upsert import with_matches

    rows = spark.range(4000).select(F.col("id").cast("string").alias("row_id"), F.when(F.col("id") % 50 == 0, F.col("id")).alias("key"))
    found = spark.range(0, 4000, 100).select(F.col("id").alias("key"), (-F.col("id")).alias("hit"))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_matches(rows, found, ["key"], "row_id").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep[1])
    assert len(got) == 4000
    assert all(row["hit"] == (None if row["key"] is None or row["key"] % 100 else -row["key"]) for row in got)
    tasks = [row["task"] for row in got if row["key"] is None]
    assert max(tasks.count(task) for task in set(tasks)) < len(tasks) // 2
