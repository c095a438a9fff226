"""Work per row of external batches and postings: once per value, and only where a cheap test asks for it."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetsight.functions import keys, redact, text as T, urls
from fleetsight.operators import ingest as G
from fleetsight.operators import postings as P
from fleetsight.operators import search as S
from fleetsight.plans.queries.reading import external_batch


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def _orders(spark, folder):
    orders = spark.range(40).selectExpr(
        "IF(id = 39, NULL, id) AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1.0D AS o_totalprice",
        "timestamp_ntz '2024-05-01 00:00:00' AS o_orderdate", "'5-LOW' AS o_orderpriority",
    )
    orders.coalesce(1).write.parquet(f"{folder}/orders.parquet")


def test_external_rows_are_dealt_and_an_address_is_cleaned_once(spark, tmp_path, monkeypatch):
    _orders(spark, tmp_path)
    monkeypatch.setattr(G, "checkpointed", lambda frame: frame)
    batch = external_batch(spark, str(tmp_path))
    assert "RepartitionByExpression [o_orderkey" in _plan(batch) and batch.count() == 40
    cleaned = spark.createDataFrame(batch.collect(), batch.schema)
    prepared = G.prepare_external(cleaned, F.lit("2024-06-01").cast("timestamp"))
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    plan = _plan(prepared)
    assert re.search(r"RepartitionByExpression \[arrival[^]]*\], 1\b", plan)
    # Five parts for the canonical and five for the safe form; the parts of a part are not split again.
    assert len(re.findall(re.escape(urls._SPLIT), plan)) <= 10
    assert prepared.count() == 40


def test_owners_are_decided_on_keys(spark, tmp_path, monkeypatch):
    _orders(spark, tmp_path)
    monkeypatch.setattr(G, "checkpointed", lambda frame: frame)
    prepared = G.prepare_external(external_batch(spark, str(tmp_path)), F.lit("2024-06-01").cast("timestamp"))
    records = spark.createDataFrame([(7, "cve:X", "CVE-2024-10004")], "id long, dedup_key string, cve_id string")
    links = spark.createDataFrame([], "threat_intelligence_id long, external_id string, source_url string")
    slim = G._with_owner(G._matches(prepared, records, links))
    assert not {"title", "summary", "metadata", "raw_payload"} & set(slim.columns)
    owners = {row["arrival"]: row["owner"] for row in slim.collect()}
    whole = {row["arrival"]: row["owner"] for row in G._with_owner(G.match_external(prepared, records, links)).collect()}
    assert owners == whole and len(owners) == 40


@pytest.mark.parametrize(
    "given, canonical, safe",
    [
        (None, None, None),
        ("", None, ""),
        (" https://a.test/x?page=1\n", "https://a.test/x?page=1", None),
        ("https://a.test/x?page=1&token=2", "https://a.test/x?page=1&token=2", "https://a.test/x?page=1"),
        ("https://a.test/x?page=1&q=a b", "https://a.test/x?page=1&q=a b", "https://a.test/x?page=1&q=a+b"),
        ("https://a.test/x?", "https://a.test/x", "https://a.test/x"),
        ("https://a.test?x=1", "https://a.test/?x=1", "https://a.test?x=1"),
        ("HTTPS://A.test/B#c", "https://a.test/B", "https://a.test/B#c"),
        ("https://token.test/x?a=1", "https://token.test/x?a=1", "https://token.test/x?a=1"),
        ("https://u:p@a.test/x", "https://u:p@a.test/x", "https://a.test/x"),
        ("https://a.test/x?a=1\nb", "https://a.test/x?a=1\nb", "https://a.test/x?a=1%0Ab"),
    ],
)
def test_addresses_that_need_no_cleaning_are_left_alone(spark, given, canonical, safe):
    row = spark.createDataFrame([(given,)], "u string").select(urls.canonical_url("u"), urls.safe_url("u")).first()
    assert row[0] == canonical
    if safe is not None or given is None:
        assert row[1] == safe


def test_texts_and_json_are_looked_at_once(spark):
    rows = spark.createDataFrame([(None,), ("",), ("　a b\x1c",), ("aé\U0001f600",), ("token : x",), ("token x",), ("my_token=x",)], "t string")
    found = rows.select(T.strip("t"), redact.safe_text("t"), keys.canonical_json({"b": F.col("t"), "a": F.lit(1)})).collect()
    assert [row[0] for row in found] == [None, "", "a b", "aé\U0001f600", "token : x", "token x", "my_token=x"]
    assert [row[1] for row in found] == [None, "", "　a b\x1c", "aé\U0001f600", None, "token x", "my_token=x"]
    assert found[0][2] == '{"a":1,"b":null}' and found[3][2] == '{"a":1,"b":"aé\U0001f600"}'
    escaped = rows.select(keys.escape_non_ascii(F.col("t"))).collect()
    assert escaped[3][0] == "a\\u00e9\\ud83d\\ude00" and escaped[0][0] is None
    assert "to_json(array(" not in _plan(rows.select(keys.canonical_json({"b": F.col("t"), "a": F.col("t")})))


def test_runs_of_ids_are_packed_at_once():
    runs = [[5], [5, 5, 5], [-3, 0, 1 << 40], [1, 2, 300], list(range(0, 400, 2)), [7, 7, 70_000], [-(1 << 63), (1 << 63) - 1]]
    starts = np.cumsum([0] + [len(run) for run in runs[:-1]])
    packed = P.pack_all(np.array([id_ for run in runs for id_ in run], dtype=np.int64), starts)
    assert [P.unpack(one).tolist() for one in packed] == [sorted(set(run)) for run in runs]
    assert packed == [P.pack(np.array(sorted(set(run)), dtype=np.int64)) for run in runs]


@pytest.mark.parametrize("texts", [[], [None, ""], ["ab", "abc", None, "abcabc", "\x00\x7f1"], ["aé日", None, "😀😀😀", "ab", "xyz"]])
def test_gram_codes_of_plain_and_other_text(texts):
    owner, code, named = P._gram_codes(pa.array(texts, pa.string()))
    expected = [(row, text[k : k + 3]) for row, text in enumerate(texts) for k in range(len(text or "") - 2)]
    assert list(zip(owner.tolist(), [named[k] for k in code.tolist()])) == expected


def test_a_text_is_cut_into_words_only_if_it_holds_them(spark):
    texts = [None, "", "bypass of AUTH", "authbypass", "auth", "Auth, bypass!", "xauth bypass"]
    rows = spark.createDataFrame([(text,) for text in texts], "t string")
    test = P.holds_words(F.col("t"), "Auth Bypass", ["auth", "bypass"])
    plan = _plan(rows.filter(test))
    assert plan.index("Contains(lower(t") < plan.index("split(lower(t")
    found = rows.select("t", F.coalesce(test, F.lit(False)), S.matches_tokens(P.words(F.col("t")), "Auth Bypass")).collect()
    assert [row[1] for row in found] == [row[2] for row in found] == [text in ("bypass of AUTH", "Auth, bypass!") for text in texts]
    assert rows.filter(P.holds_words(F.col("t"), "-", [])).count() == 0
