"""Catalogue of exploited vulnerabilities, as JSON or CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight import schema
from fleetsight.functions.dates import parse_when
from fleetsight.functions.text import none_if_blank, snippet
from fleetsight.sources.cve import read_landed
from fleetsight.sources.envelope import PAGE_ERROR, SourceInfo, page_entries, string_map, to_raw

SOURCE = SourceInfo("cisa-kev", "api", "https://www.cisa.gov/known-exploited-vulnerabilities-catalog")
ERROR_NO_ID = "catalogue entry without a CVE id"


def first_value(entry: Column | str, *keys: str) -> Column:
    """First key with a value that is not blank."""
    column = F.col(entry) if isinstance(entry, str) else entry
    return F.coalesce(*[none_if_blank(F.trim(F.try_element_at(column, F.lit(key)))) for key in keys])


def cwe_values(entry: Column | str) -> Column:
    """Weakness ids given as a JSON list or as text split by ``;`` or ``,``."""
    text = first_value(entry, "cwes", "CWE")
    listed = F.from_json(F.when(text.startswith("["), text), "array<string>")
    members = F.transform(F.coalesce(listed, F.split(text, "[;,]")), lambda item: F.trim(item))
    return F.coalesce(F.filter(members, lambda item: item != ""), F.array().cast("array<string>"))


def kev_entries(entries: DataFrame, source: SourceInfo = SOURCE) -> DataFrame:
    """Raw rows of catalogue entries. ``entries`` has entry (JSON text), unread, url and fetched_at."""
    fields = entries.withColumn("fields", F.from_json("entry", "map<string,string>")).select(
        "entry",
        "unread",
        "url",
        "fetched_at",
        first_value("fields", "cveID", "cve_id", "CVE ID").alias("cve_id"),
        first_value("fields", "vulnerabilityName", "vulnerability_name").alias("name"),
        first_value("fields", "vendorProject", "vendor_project").alias("vendor"),
        first_value("fields", "product").alias("product"),
        first_value("fields", "dateAdded", "date_added").alias("date_added"),
        first_value("fields", "dueDate", "due_date").alias("due_date"),
        first_value("fields", "knownRansomwareCampaignUse", "known_ransomware_campaign_use").alias("ransomware"),
        first_value("fields", "notes").alias("notes"),
        cwe_values("fields").alias("cwes"),
    )
    name = F.coalesce("name", "cve_id")
    headline = F.concat(
        F.coalesce("vendor", F.lit("Unknown vendor")),
        F.lit(" "),
        F.coalesce("product", F.lit("unknown product")),
        F.lit(": "),
        name,
    )
    summary = F.when(F.col("notes").isNotNull(), F.concat(headline, F.lit(". "), "notes")).otherwise(headline)
    items = fields.withColumns({"name": name, "text": summary}).select(
        F.when(F.col("unread"), F.col("url")).otherwise(F.concat(F.lit(K.KEV_DETAIL_URL), "cve_id")).alias("source_url"),
        F.col("cve_id").alias("external_id"),
        F.concat("cve_id", F.lit(" - "), "name").alias("title"),
        F.col("text").alias("summary"),
        snippet("text").alias("snippet"),
        F.col("entry").alias("raw_content"),
        parse_when("date_added").alias("first_seen_at"),
        "fetched_at",
        string_map(
            {
                "vendor_project": F.col("vendor"),
                "product": F.col("product"),
                "vulnerability_name": F.col("name"),
                "date_added": F.col("date_added"),
                "due_date": F.col("due_date"),
                "known_ransomware_campaign_use": F.col("ransomware"),
                "notes": F.col("notes"),
                "cwes": F.to_json("cwes"),
                "response_url": F.col("url"),
            }
        ).alias("metadata"),
        F.when(F.col("unread"), PAGE_ERROR).when(F.col("cve_id").isNull(), ERROR_NO_ID).alias("error_message"),
    )
    return to_raw(items, source)


def kev_items(pages: DataFrame, source: SourceInfo = SOURCE) -> DataFrame:
    """Raw rows of catalogue pages in the form of :data:`schema.KEV_PAGE`; one that does not parse is a row with an error."""
    return kev_entries(page_entries(pages, "vulnerabilities"), source)


def read_kev(spark: SparkSession, path: str, source: SourceInfo = SOURCE) -> DataFrame:
    return kev_items(read_landed(spark, path, schema.KEV_PAGE), source)


def read_kev_csv(spark: SparkSession, path: str, source: SourceInfo = SOURCE) -> DataFrame:
    """The header names the fields; every column is text, so no inference pass runs."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    entries = rows.select(
        F.to_json(F.struct(*[F.col(f"`{name}`") for name in rows.columns])).alias("entry"),
        F.lit(False).alias("unread"),
        F.col("_metadata.file_path").alias("url"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
    )
    return kev_entries(entries, source)


def latest_date_added(raw: DataFrame) -> DataFrame:
    return raw.agg(F.max(F.col("metadata")["date_added"]).alias("latest_date_added"))
