"""RSS 2.0 and Atom feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import schema
from fleetsight.functions.dates import parse_when
from fleetsight.functions.text import first_text, none_if_blank, snippet, strip_markup
from fleetsight.sources.envelope import PAGE_ERROR, SourceInfo, page_entries, string_map, to_raw

SOURCE = SourceInfo("rss", "rss")
XML_OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "_"}
ITEM_FIELDS = ("title", "link", "guid", "summary", "published", "updated")


def _text(value: Column) -> Column:
    return none_if_blank(strip_markup(value))


def _rss_item(item: Column) -> Column:
    names = {"summary": "description", "published": "pubDate"}
    return F.struct(*[item[names.get(name, name)].alias(name) for name in ITEM_FIELDS], F.lit(False).alias("atom"))


def _atom_entry(entry: Column) -> Column:
    links = F.filter(
        entry["link"],
        lambda link: none_if_blank(link["_href"]).isNotNull() & (link["_rel"].isNull() | (link["_rel"] == "alternate")),
    )
    return F.struct(
        entry["title"].alias("title"),
        F.get(links, F.lit(0))["_href"].alias("link"),
        entry["id"].alias("guid"),
        first_text(entry["summary"], entry["content"]).alias("summary"),
        entry["published"].alias("published"),
        entry["updated"].alias("updated"),
        F.lit(True).alias("atom"),
    )


def feed_items(feeds: DataFrame, source: SourceInfo = SOURCE) -> DataFrame:
    """Raw rows of landed feeds. ``feeds`` has payload (XML text), feed_name, feed_url, url and fetched_at.

    A feed that does not parse gives one row with an error.
    """
    parsed = feeds.withColumn("feed", F.from_xml("payload", schema.FEED, XML_OPTIONS))
    nothing = F.array().cast(
        "array<struct<title:string,link:string,guid:string,summary:string,published:string,updated:string,atom:boolean>>"
    )
    items = F.concat(
        F.coalesce(F.transform("feed.channel.item", _rss_item), nothing),
        F.coalesce(F.transform("feed.entry", _atom_entry), nothing),
    )
    broken = F.col("feed._corrupt_record").isNotNull() & F.col("feed.channel").isNull() & F.col("feed.entry").isNull()
    shaped = parsed.withColumns({"items": F.when(~broken, items), "_corrupt_record": F.col("feed._corrupt_record")})
    return item_rows(page_entries(shaped, "items").withColumnRenamed("entry", "item"), source)


def item_rows(items: DataFrame, source: SourceInfo = SOURCE) -> DataFrame:
    """Raw rows of single items. ``items`` has item, unread, feed_name, feed_url, url and fetched_at."""
    # Element text is cleaned; an Atom link is an attribute and stays as it is.
    attribute = F.when(F.col("item.atom"), F.col("item.link"))
    clean = items.select(
        "unread",
        "feed_name",
        "feed_url",
        "url",
        "fetched_at",
        *[_text(F.col(f"item.{name}")).alias(name) for name in ITEM_FIELDS if name != "link"],
        F.coalesce(attribute, _text(F.when(~F.col("item.atom"), F.col("item.link")))).alias("link"),
    )
    address = first_text("link", "guid", "url")
    # Title and summary are cleaned a second time, which matters for text that was encoded twice.
    described = clean.withColumns({"headline": strip_markup(first_text("title", address)), "body": _text(F.col("summary"))})
    rows = described.select(
        address.alias("source_url"),
        first_text("guid", address).alias("external_id"),
        F.col("headline").alias("title"),
        F.col("body").alias("summary"),
        snippet("body").alias("snippet"),
        F.to_json(F.struct(*sorted(ITEM_FIELDS)), {"ignoreNullFields": "false"}).alias("raw_content"),
        F.coalesce(parse_when("published"), parse_when("updated")).alias("first_seen_at"),
        "fetched_at",
        string_map(
            {
                "feed_name": F.col("feed_name"),
                "feed_url": F.col("feed_url"),
                "published": F.col("published"),
                "updated": F.col("updated"),
                "response_url": F.col("url"),
            }
        ).alias("metadata"),
        F.when(F.col("unread"), PAGE_ERROR).alias("error_message"),
    )
    return to_raw(rows, source)


_ITEM = "title string, link string, guid string, description string, pubDate string, updated string"
_ENTRY = (
    "title string, link array<struct<_href: string, _rel: string>>, id string, summary string, content string, "
    "published string, updated string"
)


def _read(spark: SparkSession, path: str, row_tag: str, row_schema: str, shape, name: str | None, url: str | None):
    rows = (
        spark.read.format("xml").options(**XML_OPTIONS).option("rowTag", row_tag).schema(row_schema).load(path)
    )
    item = shape(F.struct(*rows.columns))
    return rows.select(
        item.alias("item"),
        F.lit(False).alias("unread"),
        F.lit(name).cast("string").alias("feed_name"),
        F.lit(url).cast("string").alias("feed_url"),
        F.col("_metadata.file_path").alias("url"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
    )


def read_rss(spark: SparkSession, path: str, name: str | None = None, url: str | None = None) -> DataFrame:
    """Landed RSS files; the reader splits large files at item boundaries."""
    return item_rows(_read(spark, path, "item", _ITEM, _rss_item, name, url))


def read_atom(spark: SparkSession, path: str, name: str | None = None, url: str | None = None) -> DataFrame:
    return item_rows(_read(spark, path, "entry", _ENTRY, _atom_entry, name, url))


def latest_seen(raw: DataFrame) -> DataFrame:
    return raw.agg(F.max("first_seen_at").alias("latest_seen"))
