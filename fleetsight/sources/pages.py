"""Vendor pages: metadata, links and advisory links from HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.functions.keys import canonical_json, sha256
from fleetsight.functions.text import col, first_text, none_if_blank, snippet, squeeze, strip_markup, unescape_each, unescape_entities
from fleetsight.functions.urls import absolute_url, looks_like_advisory
from fleetsight.sources.envelope import SourceInfo, string_map, to_raw

SOURCE = SourceInfo("vendor-advisories", "vendor")

# What counts as title, description, heading, canonical address and link.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
DESCRIPTION = r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']+)["']"""
DESCRIPTION_REVERSED = r"""(?is)<meta[^>]+content=["']([^"']+)["'][^>]+name=["']description["']"""
HEADING = r"(?is)<h1[^>]*>(.*?)</h1>"
CANONICAL = r"""(?is)<link[^>]+rel=["']canonical["'][^>]+href=["']([^"']+)["']"""
LINK = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""


def _tag_text(html: Column, pattern: str) -> Column:
    return none_if_blank(F.regexp_extract(html, pattern, 1))


def page_metadata(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Title, description, heading, canonical address and content hash beside the given columns."""
    source = col(html)
    raw_text = pages.withColumns(
        {
            "title": _tag_text(source, TITLE),
            "description": F.coalesce(_tag_text(source, DESCRIPTION), _tag_text(source, DESCRIPTION_REVERSED)),
            "heading": _tag_text(source, HEADING),
            "canonical_href": _tag_text(source, CANONICAL),
            "content_hash": sha256(source),
        }
    )
    return raw_text.withColumns(
        {
            **{name: strip_markup(name) for name in ("title", "description", "heading")},
            "canonical_url": F.when(
                F.col("canonical_href").isNotNull(), absolute_url(url, unescape_entities("canonical_href"))
            ),
        }
    ).drop("canonical_href")


def _links(pages: DataFrame, keys: tuple[str, ...], html: str, url: str) -> DataFrame:
    """The keys, the page address and ``links``: resolved address and tag-free label, in page order.

    Everything stays inside the row, so there is no shuffle and no regrouping.
    """
    anchors = pages.select(*keys, col(url).alias("page_url"), F.regexp_extract_all(html, F.lit(LINK), F.lit(0)).alias("a"))
    texts = anchors.select(
        *keys,
        "page_url",
        unescape_each(F.transform("a", lambda anchor: F.regexp_extract(anchor, LINK, 1))).alias("hrefs"),
        unescape_each(
            F.transform("a", lambda anchor: F.regexp_replace(F.regexp_extract(anchor, LINK, 2), "<[^>]+>", " "))
        ).alias("labels"),
    )
    links = F.transform(
        F.arrays_zip("hrefs", "labels"),
        lambda link: F.struct(
            absolute_url(F.col("page_url"), link["hrefs"]).alias("link_url"),
            squeeze(link["labels"]).alias("link_text"),
        ),
    )
    return texts.select(*keys, "page_url", links.alias("links"))


def page_links(pages: DataFrame, *keys: str, html: str = "html", url: str = "url") -> DataFrame:
    """One row per link: the keys, position, absolute address and label."""
    links = _links(pages, keys, html, url)
    return links.select(*keys, "page_url", F.posexplode("links").alias("position", "link")).select(
        *keys, "page_url", "position", "link.link_url", "link.link_text"
    )


def advisory_links(
    pages: DataFrame, *keys: str, html: str = "html", url: str = "url", limit: int | None = None
) -> DataFrame:
    """Links of each page that look like advisories, with a PDF flag; the first ``limit`` if there is a limit."""
    named = F.transform(
        "links",
        lambda link: F.struct(
            link["link_url"].alias("link_url"), first_text(link["link_text"], link["link_url"]).alias("link_text")
        ),
    )
    kept = F.filter(
        named,
        lambda link: looks_like_advisory(link["link_url"], link["link_text"], K.PDF_LABEL_TERMS, K.ADVISORY_TERMS),
    )
    links = _links(pages, keys, html, url).select(
        *keys, "page_url", F.posexplode(kept if limit is None else F.slice(kept, 1, limit)).alias("position", "link")
    )
    return links.select(*keys, "page_url", "position", "link.link_url", "link.link_text").withColumn(
        "is_pdf", F.lower(F.substring_index("link_url", "?", 1)).endswith(".pdf")
    )


ENDPOINT_COLUMNS = ("vendor", "endpoint_url", "verification_status")


def page_items(pages: DataFrame, source: SourceInfo = SOURCE) -> DataFrame:
    """Raw rows of vendor endpoints.

    ``pages`` has vendor, endpoint_url, verification_status, endpoint_type, http_status, content_type, url, html
    and fetched_at. The page text itself is never kept.
    """
    described = page_metadata(pages)
    summary = first_text("description", "heading", "title")
    items = described.select(
        first_text("canonical_url", "url").alias("source_url"),
        sha256(canonical_json({"url": F.col("url"), "content_hash": F.col("content_hash")})).alias("external_id"),
        first_text("title", F.concat(F.coalesce("vendor", F.lit("Vendor")), F.lit(" advisory endpoint"))).alias("title"),
        summary.alias("summary"),
        snippet(summary).alias("snippet"),
        F.lit(None).cast("string").alias("raw_content"),
        F.lit(None).cast("timestamp").alias("first_seen_at"),
        "fetched_at",
        string_map(
            {
                **{name: F.col(name) for name in ENDPOINT_COLUMNS},
                "endpoint_type": F.col("endpoint_type"),
                "final_url": F.col("url"),
                "http_status": F.col("http_status"),
                "content_type": F.col("content_type"),
                **{name: F.col(name) for name in ("title", "description", "heading", "canonical_url", "content_hash")},
            }
        ).alias("metadata"),
    )
    return to_raw(items, source, "metadata_only")


def link_items(pages: DataFrame, source: SourceInfo = SOURCE) -> DataFrame:
    """Raw rows of the advisory links found on vendor endpoints."""
    links = advisory_links(pages, *ENDPOINT_COLUMNS, "fetched_at")
    nothing = F.lit(None).cast("string")
    items = links.select(
        F.col("link_url").alias("source_url"),
        sha256(canonical_json({"vendor": F.col("vendor"), "url": F.col("link_url")})).alias("external_id"),
        strip_markup("link_text").alias("title"),
        nothing.alias("summary"),
        nothing.alias("snippet"),
        nothing.alias("raw_content"),
        F.lit(None).cast("timestamp").alias("first_seen_at"),
        "fetched_at",
        string_map(
            {
                **{name: F.col(name) for name in ENDPOINT_COLUMNS},
                "parent_url": F.col("page_url"),
                "link_text": F.col("link_text"),
                "is_pdf": F.when(F.col("is_pdf"), F.lit("true")).otherwise(F.lit("false")),
            }
        ).alias("metadata"),
    )
    return to_raw(items, source, "metadata_only")


def vendor_items(pages: DataFrame, source: SourceInfo = SOURCE) -> DataFrame:
    return page_items(pages, source).unionByName(link_items(pages, source))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed HTML files, one page per file, with file address and time."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("html"),
        F.col("_metadata.file_path").alias("url"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
    )


def read_vendor_pages(spark: SparkSession, path: str, vendor: str | None = None) -> DataFrame:
    """Raw rows of landed vendor pages and their advisory links."""
    given = F.lit(vendor).cast("string")
    endpoints = read_pages(spark, path).withColumns(
        {
            "vendor": given,
            "endpoint_url": F.col("url"),
            "verification_status": F.lit(None).cast("string"),
            "endpoint_type": F.lit(None).cast("string"),
            "http_status": F.lit(None).cast("int"),
            "content_type": F.lit("text/html"),
        }
    )
    return vendor_items(endpoints)
