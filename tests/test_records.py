"""Small literal tables with known results for scoring, merging and alerts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetsight import schema
from fleetsight.operators import alerts as A
from fleetsight.operators import merge as M
from fleetsight.operators import normalize as N
from fleetsight.operators import score as S
from fleetsight.operators.running import trailing_count

BASE = datetime(2026, 5, 20)


def record(**values):
    row = {
        "id": "r1", "title": "Finding", "summary": "Text", "intelligence_type": "vulnerability", "source_names": ["NVD"],
        "source_urls": ["https://a.test/1"], "external_ids": {}, "severity": "unknown", "exploit_status": "unknown",
        "confidence": "medium", "risk_level": "info", "tags": [], "first_seen_at": BASE, "last_seen_at": BASE,
        "dedup_key": "k1", "processing_status": "normalized", "status": "active", "metadata": {}, "created_at": BASE,
        "updated_at": BASE,
    }
    row.update(values)
    return row


def records(spark, *rows):
    names = spark.createDataFrame([], schema.INTELLIGENCE).schema.names
    return spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows], schema.INTELLIGENCE)


def test_score_without_signals(spark):
    quiet, loud = (record(id=name, severity=name, title="x", summary="y") for name in ("low", "high"))
    scores = {row.id: row for row in S.score(records(spark, quiet, loud)).collect()}
    assert 0 < scores["low"].risk_score < scores["high"].risk_score < 100


def test_score_with_all_signals_is_capped(spark):
    full = record(
        title="Gateway takeover without login over the radio link", summary="Attack code is public; no authentication is needed. Remote attackers reach the gateway.",
        source_names=["cisa-kev", "vendor-a", "vendor-b"], cvss_score=10.0, cvss_vector="CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C", vehicle_component="gateway",
        attack_surface="wifi", exploit_status="exploited", confidence="high", tags=["known_exploited", "poc"],
    )
    row = S.score(records(spark, full)).first()
    assert (row.risk_score, row.risk_level) == (100.0, "critical")
    assert row.scoring.signals.authentication == "none_required"


def test_common_component_adds_eight(spark):
    plain = record(title="a", summary="b", cvss_score=5.0)
    common = dict(plain, id="r2", summary="openssl")
    scores = {row.id: row.risk_score for row in S.score(records(spark, plain, common)).collect()}
    assert scores["r2"] - scores["r1"] == 8.0


def alerts_of(spark, frame, existing=None):
    from fleetsight.sources.tables import empty

    links = empty(spark, "threat_intelligence_sources")
    return A.evaluate_alerts(frame, links, existing or empty(spark, "alerts"), F.lit(BASE))


def test_four_rules_fire_once(spark):
    frame = records(
        spark,
        record(
            cve_id="CVE-2031-70707", risk_level="critical", severity="high", vehicle_component="v2x", exploit_status="exploited",
            source_names=["feed-a"], source_urls=["https://a.test/x", "https://b.test/y", "https://c.test/z"], affected_vendor="Quill",
        ),
    )
    found = alerts_of(spark, frame)
    assert {row.triggering_rule for row in found.collect()} == {
        "critical-intelligence", "known-exploited", "vehicle-critical-v2x", "multi-source-cve-CVE-2031-70707",
    }
    assert alerts_of(spark, frame, found).count() == 0


def test_vendor_burst_and_members(spark):
    rows = [
        record(id=f"r{n}", dedup_key=f"k{n}", risk_level="high", affected_vendor="Quill-Motors", first_seen_at=BASE - timedelta(days=2 * n))
        for n in range(3)
    ]
    frame = records(spark, *rows)
    found = alerts_of(spark, frame).filter(F.col("triggering_rule").startswith("burst-"))
    assert [(row.threat_intelligence_id, row.triggering_rule) for row in found.collect()] == [("r0", "burst-vendor-quill_motors")]
    members = {(row.matched_intelligence_id, row.first_seen_at) for row in A.burst_members(found, frame).collect()}
    assert members == {(f"r{n}", BASE - timedelta(days=2 * n)) for n in range(3)}


def test_trailing_count_against_brute_force(spark):
    moments = [(key, BASE + timedelta(seconds=s)) for key, s in [("a", s * 7919 % 40000) for s in range(120)] + [("b", 5), ("b", 5), ("b", 3605)]]
    frame = spark.createDataFrame(moments, "key string, at timestamp").withColumns({"event": F.lit(True), "probe": F.lit(True)})
    span = 3600
    counted = {(row.key, row.at): row.n for row in trailing_count(frame, ["key"], "at", span * 1_000_000, "n", "event", "probe").collect()}
    for key, at in moments:
        expected = sum(1 for other, t in moments if other == key and at - timedelta(seconds=span) <= t <= at)
        assert counted[(key, at)] == expected


def raw_rows(spark, *rows):
    names = spark.createDataFrame([], schema.RAW).schema.names
    return spark.createDataFrame([tuple(row.get(name) for name in names) for row in rows], schema.RAW)


def raw_row(number, **values):
    at = BASE + timedelta(hours=number)
    row = {
        "id": f"raw{number}", "source_name": "feed", "source_type": "rss", "source_url": f"https://f.test/{number}", "external_id": f"e{number}",
        "fetched_at": at, "first_seen_at": at, "title": f"Item {number}", "processing_status": "collected", "metadata": {}, "created_at": at,
    }
    row.update(values)
    return row


CVE = "CVE-2031-70708"


def test_feed_and_catalogue_merge_into_one_record(spark):
    entry = {"cve": {"id": CVE, "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:acme:gw:1.0:*"}]}]}]}}
    import json

    nvd = raw_row(
        1, source_name="nvd", source_type="api", external_id=CVE, raw_content=json.dumps(entry),
        metadata={"cvss": '{"base_score":7.3,"base_severity":"CRITICAL"}', "cwe": '["CWE-79"]'},
    )
    kev = raw_row(2, source_name="cisa-kev", source_type="api", external_id=CVE, metadata={"vendor_project": "Newer", "date_added": "2026-05-01"})
    good, failed = N.normalize_stage(raw_rows(spark, nvd, kev))
    assert failed.count() == 0
    rows = M.merge_records(good, F.lit(BASE)).collect()
    assert len(rows) == 1
    merged = rows[0]
    assert (merged.cvss_score, merged.severity, merged.exploit_status, merged.affected_vendor) == (7.3, "critical", "exploited", "Newer")
    assert merged.source_names == ["cisa-kev", "nvd"]
    assert json.loads(merged.metadata["normalizers"]) == ["NvdNormalizer"]
    assert M.attributions(good).count() == 2


def test_replay_changes_no_record(spark):
    good, _ = N.normalize_stage(raw_rows(spark, raw_row(1), raw_row(2)))
    once = M.merge_records(good, F.lit(BASE))
    again = M.upsert_records(once, good, F.lit(BASE))
    assert {row.action for row in again.collect()} == {"updated"}
    assert again.select("id", "title", "tags").exceptAll(once.select("id", "title", "tags")).count() == 0


def test_sightings_keep_the_newest_twenty(spark):
    rows = [raw_row(n, source_url="https://f.test/same") for n in range(30)]
    good, _ = N.normalize_stage(raw_rows(spark, *rows))
    import json

    merged = M.merge_records(good, F.lit(BASE)).first()
    assert len(json.loads(merged.metadata["sightings"])) == 20


def test_limit_takes_the_newest_row(spark):
    assert N.newest_pending(raw_rows(spark, raw_row(1), raw_row(2)), 1).first().id == "raw2"
