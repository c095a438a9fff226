"""Report tables: CSV exports, Markdown reports and the executive summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.functions.dates import iso_micros
from fleetsight.functions.redact import safe_text
from fleetsight.functions.text import none_if_blank
from fleetsight.functions.urls import safe_url
from fleetsight.operators.search import ALERT_ORDERS, RECORD_ORDERS, SearchParams, alert_details, detail_alerts, detail_sources, page, search


def _joined(values: Column) -> Column:
    return F.array_join(values, " | ")


def intelligence_rows(records: DataFrame) -> DataFrame:
    """Export columns of whole tables, under plain names."""
    urls = F.filter(F.transform("source_urls", safe_url), lambda url: none_if_blank(url).isNotNull())
    return records.select(
        F.col("id").cast("string").alias("id"),
        safe_text("title").alias("title"),
        safe_text("summary").alias("summary"),
        "intelligence_type",
        "cve_id",
        "severity",
        "risk_level",
        F.col("risk_score").cast("double").alias("risk_score"),
        "status",
        safe_text("affected_vendor").alias("affected_vendor"),
        safe_text("affected_product").alias("affected_product"),
        "vehicle_component",
        "attack_surface",
        _joined(F.col("source_names")).alias("source_names"),
        _joined(urls).alias("source_urls"),
        iso_micros("first_seen_at").alias("first_seen_at"),
        iso_micros("last_seen_at").alias("last_seen_at"),
    )


def alert_rows(alerts: DataFrame, records: DataFrame) -> DataFrame:
    return alert_details(alerts, records).select(
        F.col("id").cast("string").alias("id"),
        safe_text("title").alias("title"),
        F.col("threat_intelligence_id").cast("string").alias("threat_intelligence_id"),
        "triggering_rule",
        "risk_level",
        "status",
        iso_micros("triggered_at").alias("triggered_at"),
        "notes",
        safe_text("intelligence_title").alias("intelligence_title"),
        "cve_id",
        _joined(F.col("source_names")).alias("source_names"),
    )


def with_headers(rows: DataFrame, headers: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(name).alias(header) for name, header in headers.items()])


def intelligence_export(
    records: DataFrame, links: DataFrame, params: SearchParams = SearchParams(), limit: int = K.EXPORT_LIMIT
) -> DataFrame:
    """The first ``limit`` rows of a search, in its order, with the report headers."""
    rows = page(search(records, links, params), RECORD_ORDERS[params.sort](), 1, limit, limit)
    return with_headers(intelligence_rows(rows), K.INTELLIGENCE_CSV_HEADERS)


def alert_export(alerts: DataFrame, records: DataFrame, sort: str = "recent", limit: int = K.EXPORT_LIMIT) -> DataFrame:
    chosen = page(alerts, ALERT_ORDERS[sort](), 1, limit, limit)
    return with_headers(alert_rows(chosen, records), K.ALERT_CSV_HEADERS)


def write_csv(report: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers; an export of ``limit`` rows comes sorted from one task and is one part."""
    report.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


HEADER_SECTION, SOURCE_SECTION, ALERT_HEADING, ALERT_SECTION = 0, 1, 2, 3


def report_lines(records: DataFrame, links: DataFrame, alerts: DataFrame) -> DataFrame:
    """Markdown reports as rows (id, section, position, line).

    A report is the lines of one id ordered by section and position. Lines stay rows, so a
    record with very many sources or alerts never has to fit into one value.
    """
    t = K.REPORT_TEXT

    def fact(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- {t[label]}："), value)

    def shown(name: str) -> Column:
        return F.coalesce(none_if_blank(safe_text(name)), F.lit("-"))

    score = F.when(F.col("risk_score").isNull() | (F.col("risk_score") == 0), F.lit("-")).otherwise(
        F.col("risk_score").cast("double").cast("string")
    )
    header = records.select(
        "id",
        F.lit(HEADER_SECTION).alias("section"),
        F.posexplode(
            F.array(
                F.concat(F.lit("# "), F.coalesce(none_if_blank(safe_text("title")), F.lit(t["untitled"]))),
                F.lit(""),
                fact("id", F.col("id").cast("string")),
                fact("type", F.col("intelligence_type")),
                fact("status", F.col("status")),
                fact("cve", F.coalesce(none_if_blank("cve_id"), F.lit("-"))),
                fact("severity", F.col("severity")),
                fact("risk", F.concat(F.col("risk_level"), F.lit("（"), score, F.lit("）"))),
                fact("vendor", shown("affected_vendor")),
                fact("product", shown("affected_product")),
                F.lit(""),
                F.lit(f"## {t['summary']}"),
                F.lit(""),
                shown("summary"),
                F.lit(""),
                F.lit(f"## {t['sources']}"),
                F.lit(""),
            )
        ).alias("place", "line"),
    )
    external = none_if_blank("external_id")
    suffix = F.when(external.isNotNull(), F.concat(F.lit(" ("), external, F.lit(")"))).otherwise(F.lit(""))
    name = F.coalesce(none_if_blank(safe_text("source_name")), F.lit(t["source"]))
    sources = detail_sources(records, links).select(
        "id",
        F.lit(SOURCE_SECTION).alias("section"),
        F.lit(0).alias("place"),
        F.concat(F.lit("- "), name, F.lit(": "), "source_url", suffix).alias("line"),
    )
    heading = records.select(
        "id",
        F.lit(ALERT_HEADING).alias("section"),
        F.posexplode(F.array(F.lit(""), F.lit(f"## {t['alerts']}"), F.lit(""))).alias("place", "line"),
    )
    related = detail_alerts(records, alerts)
    label = F.coalesce(none_if_blank(safe_text("title")), F.col("alert_id").cast("string"))
    alert_lines = related.select(
        "id",
        F.lit(ALERT_SECTION).alias("section"),
        (-F.unix_micros("triggered_at")).alias("place"),
        F.concat(F.lit("- "), label, F.lit(": "), "risk_level", F.lit(" / "), "status").alias("line"),
    )
    quiet = records.join(related.select("id").distinct(), "id", "left_anti").select(
        "id", F.lit(ALERT_SECTION).alias("section"), F.lit(0).alias("place"), F.lit(f"- {t['none']}").alias("line")
    )
    parts = [header, sources, heading, alert_lines, quiet]
    lines = parts[0].withColumn("place", F.col("place").cast("long"))
    for part in parts[1:]:
        lines = lines.unionByName(part.withColumn("place", F.col("place").cast("long")))
    return lines


def write_reports(lines: DataFrame, path: str) -> None:
    """Text files in which the lines of a report follow each other; split by range, not by report."""
    lines.orderBy("id", "section", "place", "line").select("line").write.mode("overwrite").text(path)


def executive_summary(records: DataFrame, alerts: DataFrame, limit: int = K.SUMMARY_LIMIT) -> dict[str, DataFrame]:
    """Counts over the whole tables, and the rows that head each list."""
    totals = records.agg(
        F.count(F.lit(1)).alias("included"), F.count_if(F.col("risk_level").isin(*K.HIGH_RISK_LEVELS)).alias("high_risk")
    )
    alert_totals = alerts.agg(
        F.count(F.lit(1)).alias("included"), F.count_if(F.col("status") == "open").alias("open_alerts")
    )
    counts = totals.select(
        F.inline(
            F.array(
                F.struct(F.lit("intelligence").alias("metric"), F.col("included").alias("value")),
                F.struct(F.lit("high_risk_intelligence").alias("metric"), F.col("high_risk").alias("value")),
            )
        )
    ).unionByName(
        alert_totals.select(
            F.inline(
                F.array(
                    F.struct(F.lit("alerts").alias("metric"), F.col("included").alias("value")),
                    F.struct(F.lit("open_alerts").alias("metric"), F.col("open_alerts").alias("value")),
                )
            )
        )
    )
    return {
        "counts": counts,
        "intelligence": page(records, RECORD_ORDERS["risk_score"](), 1, min(limit, K.SUMMARY_ROWS)).select(
            "id", "cve_id", "risk_level", F.coalesce(none_if_blank(safe_text("title")), F.col("id").cast("string")).alias("title")
        ),
        "alerts": page(alerts, ALERT_ORDERS["risk_level"](), 1, min(limit, K.SUMMARY_ROWS)).select(
            "id", "risk_level", "status", F.coalesce(none_if_blank(safe_text("title")), F.col("id").cast("string")).alias("title")
        ),
    }
