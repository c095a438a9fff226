"""Vehicle recalls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight import schema
from fleetsight.functions.dates import bool_value, parse_when
from fleetsight.functions.text import snippet, software_related
from fleetsight.sources.envelope import PAGE_ERROR, SourceInfo, string_map, to_raw
from fleetsight.sources.kev import first_value

SOURCE = SourceInfo("nhtsa-recalls", "api", "https://api.nhtsa.gov/recalls/recallsByVehicle")


def vehicle_years(vehicles: DataFrame, base_year: int, count: int = K.MODEL_YEARS) -> DataFrame:
    """Every vehicle with its last ``count`` model years, as an explode rather than a cross join."""
    if count <= 0:
        return vehicles.withColumn("model_year", F.lit(base_year)).limit(0)
    years = F.sequence(F.lit(base_year - count + 1), F.lit(base_year))
    return vehicles.withColumn("model_year", F.explode(years))


def recall_entries(responses: DataFrame) -> DataFrame:
    """One row per recall. ``responses`` has make, model, model_year, url, fetched_at and Results (JSON texts)."""
    entries = responses.select(
        "make", "model", "model_year", "url", "fetched_at", F.posexplode("Results").alias("position", "entry")
    ).withColumn("fields", F.from_json("entry", "map<string,string>"))
    component = first_value("fields", "Component", "component")
    summary = first_value("fields", "Summary", "summary")
    over_the_air = bool_value(
        first_value("fields", "OverTheAirUpdate", "overTheAirUpdate", "over_the_air_update")
    )
    return entries.withColumns(
        {
            "campaign": first_value(
                "fields", "NHTSACampaignNumber", "nhtsaCampaignNumber", "campaignNumber", "campaign_number"
            ),
            "component": component,
            "summary": summary,
            "over_the_air": over_the_air,
            "software_related": software_related(over_the_air, component, summary),
        }
    )


def first_per_campaign(entries: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Software related recalls not collected before; the first mention in the batch wins.

    A campaign can be listed under very many vehicles, so the first one is picked by an
    aggregate with a map-side part instead of a window over the whole campaign.
    """
    wanted = entries.filter(F.col("campaign").isNotNull() & F.col("software_related"))
    if seen is not None:
        wanted = wanted.join(seen.select("campaign").distinct(), "campaign", "left_anti")
    others = [name for name in wanted.columns if name != "campaign"]
    order = F.struct("make", "model", "model_year", "position")
    return wanted.groupBy("campaign").agg(F.min_by(F.struct(*others), order).alias("first")).select("campaign", "first.*")


def unread_items(responses: DataFrame) -> DataFrame:
    """Responses that do not parse, each as one item with an error."""
    unread = responses.filter(F.col("Results").isNull() & F.col("_corrupt_record").isNotNull())
    texts = [F.lit(None).cast("string").alias(name) for name in ("external_id", "title", "summary", "snippet", "raw_content")]
    vehicle = {name: F.col(name) for name in ("make", "model", "model_year")}
    return unread.select(
        F.col("url").alias("source_url"),
        *texts,
        F.lit(None).cast("timestamp").alias("first_seen_at"),
        "fetched_at",
        string_map({**vehicle, "response_url": F.col("url")}).alias("metadata"),
        F.lit(PAGE_ERROR).alias("error_message"),
    )


def recall_items(responses: DataFrame, source: SourceInfo = SOURCE, seen: DataFrame | None = None) -> DataFrame:
    """Raw rows of the campaigns, and one with an error for each response that does not parse."""
    recalls = first_per_campaign(recall_entries(responses), seen)
    fields = F.col("fields")
    given = F.map_filter(fields, lambda key, value: key.isin(*K.RECALL_CONTENT_KEYS) & value.isNotNull())
    content = F.map_concat(
        string_map(
            {
                "campaign_number": F.col("campaign"),
                "make": F.col("make"),
                "model": F.col("model"),
                "model_year": F.col("model_year"),
                "over_the_air_update": F.col("over_the_air"),
            }
        ),
        given,
    )
    received = first_value("fields", "ReportReceivedDate", "reportReceivedDate")
    items = recalls.select(
        F.concat(F.lit(K.RECALL_DETAIL_URL), "campaign").alias("source_url"),
        F.col("campaign").alias("external_id"),
        F.concat_ws(" ", "make", "model", F.col("model_year").cast("string"), F.lit("召回"), "campaign").alias("title"),
        "summary",
        snippet("summary").alias("snippet"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(content)))).alias("raw_content"),
        F.coalesce(parse_when(received), parse_when(first_value("fields", "report_received_date"))).alias("first_seen_at"),
        "fetched_at",
        string_map(
            {
                "make": F.col("make"),
                "model": F.col("model"),
                "model_year": F.col("model_year"),
                "campaign_number": F.col("campaign"),
                "manufacturer": first_value("fields", "Manufacturer", "manufacturer"),
                "report_received_date": received,
                "component": F.col("component"),
                "recall_type": first_value("fields", "Type", "RecallType"),
                "over_the_air_update": F.col("over_the_air"),
                "software_related": F.col("software_related"),
                "response_url": F.col("url"),
            }
        ).alias("metadata"),
    )
    if "_corrupt_record" in responses.columns:
        none = F.lit(None).cast("string")
        items = items.withColumn("error_message", none).unionByName(unread_items(responses))
    return to_raw(items, source)


def read_recalls(spark: SparkSession, path: str, source: SourceInfo = SOURCE, seen: DataFrame | None = None) -> DataFrame:
    """Landed responses, laid out as ``make=../model=../model_year=..`` folders."""
    pages = (
        spark.read.schema(schema.RECALL_PAGE + ", make string, model string, model_year int")
        .option("multiLine", "true")
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_modification_time").alias("fetched_at"))
    )
    return recall_items(pages, source, seen)


def seen_campaigns(raw: DataFrame) -> DataFrame:
    """Cursor of the reader: the set of campaigns, as rows."""
    return raw.select(F.col("external_id").alias("campaign")).distinct()
