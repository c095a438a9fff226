"""CVE feed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight import schema
from fleetsight.functions.dates import parse_when
from fleetsight.functions.nested import best_description, cwe_list, pick_cvss
from fleetsight.functions.text import none_if_blank, snippet
from fleetsight.sources.envelope import PAGE_ERROR, SourceInfo, page_entries, since, string_map, to_raw

SOURCE = SourceInfo("nvd", "api", "https://services.nvd.nist.gov/rest/json/cves/2.0")
ERROR_NO_ID = "CVE entry without an id"


def reference_urls(references: Column) -> Column:
    """Addresses of the object form of ``references``; the plain list form counts as none."""
    as_object = F.from_json(
        F.when(references.startswith("{"), references), "referenceData array<struct<url: string>>"
    )
    urls = F.transform(as_object["referenceData"], lambda item: item["url"])
    return F.coalesce(urls, F.array().cast("array<string>"))


def cve_items(pages: DataFrame, source: SourceInfo = SOURCE) -> DataFrame:
    """Raw rows of feed pages in the form of :data:`schema.CVE_PAGE`, with url and fetched_at.

    A page that does not parse gives one row with an error.
    """
    entries = page_entries(pages, "vulnerabilities")
    parsed = entries.withColumn("cve", F.from_json("entry", schema.CVE_ENTRY)["cve"])
    cve_id = none_if_blank(F.trim(F.col("cve.id")))
    summary = best_description("cve.descriptions")
    fields = parsed.withColumns({"cve_id": cve_id, "text": summary, "cvss": pick_cvss("cve.metrics")})
    items = fields.select(
        F.when(F.col("unread"), F.col("url")).otherwise(F.concat(F.lit(K.CVE_DETAIL_URL), "cve_id")).alias("source_url"),
        F.col("cve_id").alias("external_id"),
        F.when(F.col("text").isNotNull(), F.concat("cve_id", F.lit(" - "), "text"))
        .otherwise(F.col("cve_id"))
        .alias("title"),
        F.col("text").alias("summary"),
        snippet("text").alias("snippet"),
        F.col("entry").alias("raw_content"),
        F.coalesce(parse_when("cve.published"), parse_when("cve.lastModified")).alias("first_seen_at"),
        "fetched_at",
        string_map(
            {
                "published": F.col("cve.published"),
                "last_modified": F.col("cve.lastModified"),
                "vuln_status": F.col("cve.vulnStatus"),
                "cvss": F.coalesce(F.to_json("cvss"), F.lit("{}")),
                "cwe": F.to_json(cwe_list("cve.weaknesses")),
                "reference_count": F.size(reference_urls(F.col("cve.references"))),
                "response_url": F.col("url"),
            }
        ).alias("metadata"),
        F.when(F.col("unread"), PAGE_ERROR).when(F.col("cve_id").isNull(), ERROR_NO_ID).alias("error_message"),
    )
    return to_raw(items, source)


def parse_pages(payloads: DataFrame, page_schema: str) -> DataFrame:
    """Decode landed JSON text (columns payload, url, fetched_at) into page columns."""
    return payloads.select(
        "url", "fetched_at", F.inline(F.array(F.from_json("payload", page_schema)))
    )


def read_landed(spark: SparkSession, path: str, page_schema: str, multi_line: bool = True) -> DataFrame:
    """Landed JSON pages with their file address and file time."""
    return (
        spark.read.schema(page_schema)
        .option("multiLine", str(multi_line).lower())
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_modification_time").alias("fetched_at"))
    )


def read_cve_feed(spark: SparkSession, path: str, source: SourceInfo = SOURCE) -> DataFrame:
    return cve_items(read_landed(spark, path, schema.CVE_PAGE), source)


def in_window(raw: DataFrame, cursor: Column | None, now: Column) -> DataFrame:
    """Entries last modified in the polling window."""
    return since(raw, parse_when(F.col("metadata")["last_modified"]), cursor, now)
