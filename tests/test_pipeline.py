"""Landed files of three formats through the whole run, twice."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from fleetsight.plans import pipeline
from fleetsight.sources.tables import empty

CVE = "CVE-2031-70709"


def test_landed_files_to_alerts(spark, tmp_path):
    entry = {
        "id": CVE, "published": "2026-01-01T00:00:00.000", "descriptions": [{"lang": "en", "value": "Gateway accepts forged frames"}],
        "metrics": {"cvssMetricV31": [{"cvssData": {"version": "3.1", "baseScore": 8.1, "baseSeverity": "HIGH", "vectorString": "AV:N"}}]},
    }
    (tmp_path / "nvd.json").write_text(json.dumps({"vulnerabilities": [{"cve": entry}, {"cve": {"descriptions": []}}]}))
    (tmp_path / "kev.csv").write_text(
        "cveID,vendorProject,product,vulnerabilityName,dateAdded,cwes\n" + f'{CVE},Quill,Relay,"Frames, forged",2026-01-02,CWE-345;CWE-20\n'
    )
    (tmp_path / "feed.xml").write_text(
        "<rss><channel><item><title>Charger news</title><link>https://f.test/1</link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item></channel></rss>"
    )
    landed = {"nvd": str(tmp_path / "nvd.json"), "cisa-kev-csv": str(tmp_path / "kev.csv"), "rss": str(tmp_path / "feed.xml")}
    incoming = pipeline.collect(spark, landed)
    names = ("raw_intelligence", "threat_intelligence", "threat_intelligence_sources", "alerts")
    tables = {name: empty(spark, name) for name in names}
    now = F.lit(datetime(2026, 2, 1))
    first = pipeline.run(tables, incoming, now)
    records = {row.dedup_key: row for row in first["threat_intelligence"].collect()}
    assert len(records) == 2 and first["rejected"].count() == 1
    merged = records[f"cve:{CVE}"]
    assert (merged.cvss_score, merged.exploit_status, merged.affected_vendor, merged.cwe_id) == (8.1, "exploited", "Quill", "CWE-345")
    assert first["threat_intelligence_sources"].filter(F.col("threat_intelligence_id") == merged.id).count() == 2
    rules = {row.triggering_rule for row in first["alerts"].filter(F.col("threat_intelligence_id") == merged.id).collect()}
    assert {"known-exploited", f"multi-source-cve-{CVE}"} <= rules
    assert {row.processing_status for row in first["raw_intelligence"].collect()} == {"normalized"}


def test_runs_are_recorded(spark):
    from test_records import BASE, raw_row, raw_rows

    incoming = raw_rows(spark, *[raw_row(n, source_id="abc"[n % 3]) for n in range(6)])
    columns = "source_id string, skip_reason string, error_message string, attempts int"
    configs = spark.createDataFrame([("a", None, None, 2), ("b", None, "no answer", 1), ("c", "disabled", None, 1), ("d", None, None, 1)], columns)
    now = F.lit(BASE)
    names = ("raw_intelligence", "threat_intelligence", "threat_intelligence_sources", "alerts", "sources", "sync_states", "job_logs")
    tables = {name: empty(spark, name) for name in names}
    done = pipeline.run(tables, incoming, now, runs=pipeline.O.source_runs(configs, incoming, now, now))
    log = {row.source_id: row for row in done["job_logs"].collect()}
    assert {key: (row.status, row.items_seen, row.items_created) for key, row in log.items()} == {
        "a": ("success", 2, 2), "b": ("failed", 0, 0), "c": ("success", 0, 0), "d": ("success", 0, 0)
    }
    assert json.loads(log["a"].metadata)["retried"] == "true" and json.loads(log["c"].metadata)["reason"] == "disabled"
    states = {row.source_id: row for row in done["sync_states"].collect()}
    assert {key: row.consecutive_failures for key, row in states.items()} == {"a": 0, "b": 1, "c": 0, "d": 0}
    assert states["a"].cursor and states["d"].cursor is None
    # Rows of a run that did not succeed are not kept.
    assert {row.source_id for row in done["raw_intelligence"].collect()} == {"a"}
    again = pipeline.run({**tables, **{name: done[name] for name in names}}, incoming, now, runs=pipeline.O.source_runs(configs, incoming, now, now))
    assert {row.source_id: row.consecutive_failures for row in again["sync_states"].collect()} == {"a": 0, "b": 2, "c": 0, "d": 0}
    newest = {row.source_id: row.items_updated for row in again["job_logs"].collect() if row.items_updated}
    assert newest == {"a": 2} and again["raw_intelligence"].count() == 2
