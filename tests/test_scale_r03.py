"""Work that is done once per row, and rows that are dealt over tasks."""

import re

import pytest
from pyspark.sql import functions as F

from fleetsight import schema
from fleetsight.functions import text as T
from fleetsight.operators import normalize as N
from fleetsight.plans import fixtures as X
from fleetsight.plans.queries import reporting
from fleetsight.sources import cve, tables

ENTRY = (
    '{"cve":{"id":"CVE-2024-10001","references":"{\\"referenceData\\":[{\\"url\\":\\"https://poc.test/1\\"}]}",'
    '"configurations":[{"nodes":[{"cpeMatch":[{"criteria":"cpe:2.3:o:acme:gw:1.2:*"}]}]}]}}'
)


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_feed_entry_is_parsed_once_per_row(spark):
    pages = spark.createDataFrame([(f'{{"vulnerabilities":[{ENTRY}]}}',)], "payload string").select(
        "payload", F.lit("https://a.test/").alias("url"), F.lit("2024-05-01").cast("timestamp").alias("fetched_at")
    )
    items = cve.cve_items(cve.parse_pages(pages, schema.CVE_PAGE))
    raw = spark.createDataFrame(items.collect(), items.schema)
    normal = N.normalize(raw)
    assert len(re.findall(r"from_json\(StructField\(cve,", _plan(normal))) == 1
    row = normal.first()
    assert (row["dedup_key"], row["affected_vendor"], row["affected_product"], row["affected_version"]) == (
        "cve:CVE-2024-10001", "acme", "gw", "1.2"
    )
    assert row["exploit_status"] == "proof_of_concept"


@pytest.mark.parametrize("text", ["", " ", "a b", " a  b\t", "a \n b", " a  b 　", "\x1ca\x1f b\x85", "a​b  c"])
def test_squeeze_turns_runs_of_blanks_into_one(spark, text):
    blank = "[\t-\r\x1c-\x1f \x85\xa0  -     　]+"
    expected = re.sub(blank, " ", text).strip(" ")
    assert spark.createDataFrame([(text,)], "t string").select(T.squeeze("t")).first()[0] == expected


def test_identifiers_in_any_case_and_position(spark):
    texts = [None, "", "cve-", "xCVE-2024-1234", "see CVE-2024-123 or cVe-2024-56789.", "CVE-2024-1234_", "é CVE-2023-0001", "cwe-7x CWE-79"]
    rows = spark.createDataFrame([(text,) for text in texts], "t string").select(T.extract_cve("t"), T.extract_cwe("t")).collect()
    assert [row[0] for row in rows] == [None, None, None, None, "CVE-2024-56789", None, "CVE-2023-0001", None]
    assert [row[1] for row in rows] == [None] * 7 + ["CWE-79"]


def test_documents_of_one_row_group_are_dealt(spark, tmp_path):
    rows = spark.range(50).selectExpr(
        "IF(id % 5 = 0, NULL, id) AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "'s' AS source", "id AS n_chars"
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    raw = X.raw(spark, str(tmp_path))
    assert "RepartitionByExpression" in _plan(raw) and raw.count() == 50


def test_reports_are_counted_in_parts_of_bounded_rows(spark, tmp_path, monkeypatch):
    day = "timestamp_ntz '2024-05-01 00:00:00'"
    orders = spark.range(40).selectExpr(
        "IF(id = 39, NULL, id DIV 2 * 2) AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1.0D AS o_totalprice",
        f"{day} AS o_orderdate", "'5-LOW' AS o_orderpriority",
    )
    lines = spark.range(90).selectExpr(
        "IF(id % 9 = 0, NULL, id % 30) AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "1.0D AS l_quantity",
        f"{day} AS l_shipdate",
    )
    events = spark.range(30).selectExpr("id % 5 * 2 AS event_id", f"{day} AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value")
    for name, rows in (("orders", orders), ("lineitem", lines), ("events", events)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    found = []
    for rows in (1_000, 13):
        monkeypatch.setattr(tables, "PART_ROWS", rows)
        frame = reporting.report_line_counts(spark, str(tmp_path))
        parts = -(-130 // rows)
        # Rows of one file are dealt by id before anything is counted or joined.
        dealt = re.findall(r"RepartitionByExpression \[([ol])_orderkey#\d+L\], (\d+)", _plan(frame))
        assert set(dealt) == {("o", str(parts)), ("l", str(parts))}
        found.append(sorted(frame.collect(), key=str))
    assert found[0] == found[1] and len(found[0]) == 21
    # Every id but the last stands twice: headers and headings, its links or the names of both rows, its alerts or two lines.
    counts = {row["id"]: row["n_lines"] for row in found[0]}
    linked = [n for n in range(90) if n % 9]
    for key in range(0, 38, 2):
        own = [n for n in linked if n % 30 == key]
        names = sum(1 + (cust % 5 == 0) for cust in (key, key + 1))
        assert counts[key] == 40 + (len(own) or names) + (6 if key < 10 else 2), key
