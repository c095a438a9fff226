"""Counts over a trailing time range, for keys of any size.

A window over a whole key would put a third of all rows into one task when one vendor
dominates. Here a trailing count becomes a running sum of +1 at a row's time and -1 just
after it leaves the range, and the running sum is built from three bounded levels:
micro-seconds within a second, seconds within an hour, hours within the key. Every level is
summed map-side first, so no window sees more rows than its level has steps: two million,
3,600, and the number of hours in the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3_600


def _floor_div(value: Column, size: int) -> Column:
    return ((value - F.pmod(value, F.lit(size))) / size).cast("long")


def trailing_count(
    rows: DataFrame, keys: list[str], time: str, span_micros: int, name: str, is_event: str, is_probe: str
) -> DataFrame:
    """Distinct (keys, time) of probe rows with the number of event rows in ``[time - span, time]``.

    ``is_event`` and ``is_probe`` name boolean columns; a row may be both. Both ends count. Keys, time
    and flags must not be null.
    """
    moment = F.unix_micros(F.col(time))
    # Steps are half micro-seconds: an event counts from its own step on and stops counting
    # one half step after the last probe time that may still see it.
    here = F.struct(
        (moment * 2).alias("step"), F.col(is_event).cast("int").alias("delta"), F.col(is_probe).cast("int").alias("probe")
    )
    leaving = F.struct(
        ((moment + span_micros) * 2 + 1).alias("step"), F.lit(-1).alias("delta"), F.lit(0).alias("probe")
    )
    placed = F.when(F.col(is_event), F.array(here, leaving)).otherwise(F.array(here))
    steps = (
        rows.select(*keys, F.inline(placed))
        .groupBy(*keys, "step")
        .agg(F.sum("delta").alias("delta"), F.max("probe").alias("is_probe"))
    )
    second = _floor_div(F.col("step"), 2 * SECOND)
    hour = _floor_div(F.col("second"), HOUR)
    placed = steps.withColumn("second", second)
    seconds = placed.groupBy(*keys, "second").agg(F.sum("delta").alias("delta")).withColumn("hour", hour)
    hours = seconds.groupBy(*keys, "hour").agg(F.sum("delta").alias("delta"))

    def before(level: list[str], order: str) -> Column:
        frame = Window.partitionBy(*keys, *level).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("delta").over(frame), F.lit(0))

    hours_before = hours.select(*keys, "hour", before([], "hour").alias("before_hour"))
    seconds_before = (
        seconds.withColumn("in_hour", before(["hour"], "second"))
        .join(hours_before, [*keys, "hour"])
        .select(*keys, "second", (F.col("in_hour") + F.col("before_hour")).alias("before_second"))
    )
    within = Window.partitionBy(*keys, "second").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("in_second", F.sum("delta").over(within)).filter(F.col("is_probe") == 1)
    return running.join(seconds_before, [*keys, "second"]).select(
        *keys,
        F.timestamp_micros(_floor_div(F.col("step"), 2)).alias(time),
        (F.col("in_second") + F.col("before_second")).cast("long").alias(name),
    )
