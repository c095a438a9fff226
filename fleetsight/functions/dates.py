"""Times and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetsight import constants as K
from fleetsight.functions.text import col, lookup, none_if_blank

# Zone names of mail dates.
MAIL_ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "AST": "-0400", "ADT": "-0300", "EST": "-0500",
    "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
_MAIL_DATE = (
    r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}:\d{2}(?::\d{2})?)(?:\s+(\S+))?"
)


def _mail_date(text: Column) -> Column:
    day, month, year, clock, zone = [F.regexp_extract(text, _MAIL_DATE, group) for group in range(1, 6)]
    offset = F.when(zone.rlike(r"^[+-]\d{4}$"), zone).otherwise(
        F.coalesce(lookup(F.upper(zone), MAIL_ZONES), F.lit("+0000"))
    )
    seconds = F.when(F.length(clock) > 5, clock).otherwise(F.concat(clock, F.lit(":00")))
    rebuilt = F.concat_ws(" ", day, F.initcap(month), year, seconds, offset)
    return F.when(day != "", F.try_to_timestamp(rebuilt, F.lit("d MMM yyyy H:mm:ss Z")))


def parse_when(value: Column | str) -> Column:
    """ISO, mail, ``yyyy-MM-dd``, ``MM/dd/yyyy`` or ``yyyy/MM/dd`` text as a UTC time, else null."""
    text = F.trim(col(value))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ]\d{2})"), F.try_to_timestamp(text))
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    american = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("M/d/yyyy")))
    slashed = F.when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_timestamp(text, F.lit("yyyy/M/d")))
    return F.coalesce(iso, compact, _mail_date(text), american, slashed)


def iso_utc(value: Column | str) -> Column:
    return F.date_format(col(value), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_micros(value: Column | str) -> Column:
    """ISO text with an explicit zero offset; the fraction only when there is one."""
    moment = col(value)
    fraction = F.when(F.unix_micros(moment) % 1_000_000 != 0, F.date_format(moment, ".SSSSSS")).otherwise(F.lit(""))
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def utc_day(value: Column | str) -> Column:
    return F.to_date(col(value))


def float_or_none(value: Column | str) -> Column:
    return none_if_blank(F.trim(col(value).cast("string"))).try_cast("double")


def bounded_score(score: Column) -> Column:
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 2)


def risk_level_for_score(score: Column | str) -> Column:
    result = F.lit("low")
    for threshold, level in reversed(K.LEVEL_THRESHOLDS):
        result = F.when(col(score) >= threshold, F.lit(level)).otherwise(result)
    return result


def rank_of(value: Column | str, ordered: tuple[str, ...], unknown: int = 0, first: int = 0) -> Column:
    """Position in a weakest-first tuple."""
    return lookup(col(value), {name: position + first for position, name in enumerate(ordered)}, unknown)


def at_least_risk(level: Column | str, floor: str) -> Column:
    rank = F.greatest(rank_of(level, K.RISK_LEVELS), F.lit(K.RISK_LEVELS.index(floor)))
    return F.get(F.array(*[F.lit(name) for name in K.RISK_LEVELS]), rank)


def bool_value(value: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(value).cast("string"))).isin(*K.TRUE_WORDS), F.lit(False))
