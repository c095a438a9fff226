"""Keyed state of streams: burst counts per time block, health per source.

State lives in Spark's own state store, so a batch that is run again finds the state of the batch before it,
and a restarted stream goes on where it ended. Results of each batch go to a folder of that batch.

Bursts. A key is a scope, a value and a block of time (``block_hours``, which divides seven days), so no key
holds more of a busy vendor than two blocks. An event is known to its own block and to the blocks that its
seven days reach: those in between need its number only, the last one its time. So a row that comes late, or
before older ones, corrects the counts of rows that were there already; counts only grow, and the largest
one of a row is its result. A block's state goes when the watermark has passed its end, as nothing can come
to it any more; rows later than the watermark's delay are left to the batch rule.

Health. State of a source is its last success, the cursor, the last run and the failures since that success,
by time and id, so that repeated rows change nothing and a success that comes late still ends the failures
before it. Its size is the number of failures since the last success.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetsight import constants as K
from fleetsight.operators import alerts as A
from fleetsight.operators import ops as O
from fleetsight.session import scratch_folder

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MICROS = 3_600_000_000
OWN, LAST, BETWEEN = 0, 1, 2


def with_state_store(spark: SparkSession) -> None:
    """Keyed processors need the state store that keeps rows on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)


def _numbers(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", dtype=np.int64)


def _strings(values: list) -> pd.Series:
    return pd.Series(values, dtype=object)


class Batches:
    """One folder per micro-batch; a batch that is run again replaces its own."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def read(self, columns: str) -> DataFrame:
        return self.spark.read.schema(f"{columns}, batch int").parquet(self.folder)


# --- bursts ---------------------------------------------------------------------
class BurstBlock(StatefulProcessor):
    """Counts of the trailing days for the rows of one block of a scope's value."""

    def __init__(self, block_micros: int, span_micros: int, minimum: int) -> None:
        self.block_micros, self.span, self.minimum = block_micros, span_micros, minimum

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("block", "own binary, last binary, between long, times binary, ids array<string>")

    def counts(self, times: np.ndarray, own: np.ndarray, last: np.ndarray, between: int) -> np.ndarray:
        return np.searchsorted(own, times, "right") + between + last.size - np.searchsorted(last, times - self.span, "left")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scope, value, block = key
        held = self.state.get() if self.state.exists() else None
        if held is None:
            self.handle.registerTimer((block + 1) * self.block_micros // 1000)
        own, last, times = (_numbers(held[k] if held else None) for k in (0, 1, 3))
        between, ids = (held[2], list(held[4])) if held else (0, [])
        before = self.counts(times, own, last, between)
        for part in rows:
            part_kind, part_time, is_event = part["kind"].to_numpy(), part["micros"].to_numpy(), part["is_event"].to_numpy(dtype=bool)
            mine = part_kind == OWN
            own = np.concatenate([own, part_time[mine & is_event]])
            last = np.concatenate([last, part_time[part_kind == LAST]])
            between += int((part_kind == BETWEEN).sum())
            times = np.concatenate([times, part_time[mine]])
            ids += part["id"][mine].tolist()
        own, last = np.sort(own), np.sort(last)
        self.state.update((own.tobytes(), last.tobytes(), between, times.tobytes(), ids))
        after = self.counts(times, own, last, between)
        new = after >= self.minimum
        new[: before.size] &= after[: before.size] != before
        at = np.flatnonzero(new)
        if at.size:
            yield pd.DataFrame({
                "id": _strings([ids[k] for k in at]), "scope": _strings([scope] * at.size), "value": _strings([value] * at.size),
                "micros": times[at], "match_count": after[at].astype(np.int64),
            })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


_BURSTS = "id string, scope string, value string, micros long, match_count long"


def burst_counts(
    records: DataFrame, delay: str, days: int = K.BURST_DAYS, minimum: int = K.BURST_MIN_ITEMS, block_hours: int = 24
) -> DataFrame:
    """Stream of new or larger counts of records in a burst; ``records`` is a stream of records.

    An event becomes one narrow row for each block it reaches: eight with blocks of a day, 169 with hours,
    for vendors of which a day alone is too much for one key.
    """
    if days * 24 % block_hours:
        raise ValueError("blocks must divide the trailing days")
    with_state_store(records.sparkSession)
    block_micros, reach = block_hours * HOUR_MICROS, days * 24 // block_hours
    high = F.coalesce(F.col("risk_level").isin(*K.HIGH_RISK_LEVELS), F.lit(False))
    timed = records.withColumns({"is_event": high, "id": F.col("id").cast("string")}).withWatermark("first_seen_at", delay)
    rows = A._scopes(timed, "id", "is_event").withColumn("micros", F.unix_micros("first_seen_at"))
    block = F.floor(F.col("micros") / block_micros)
    ahead = F.when(F.col("is_event"), F.sequence(F.lit(0), F.lit(reach))).otherwise(F.array(F.lit(0)))
    placed = rows.withColumn("block", block).withColumn("ahead", F.explode(ahead))
    kind = F.when(F.col("ahead") == 0, OWN).when(F.col("ahead") == reach, LAST).otherwise(BETWEEN)
    placed = placed.select(
        "scope", "value", (F.col("block") + F.col("ahead")).alias("block"), kind.alias("kind"), "micros", "is_event", "id", "first_seen_at"
    )
    processor = BurstBlock(block_micros, days * 24 * HOUR_MICROS, minimum)
    return placed.groupBy("scope", "value", "block").transformWithStateInPandas(processor, _BURSTS, "Update", "EventTime")


class BurstDetector(Batches):
    """Bursts found so far: the largest count of each record, vendors before components."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        super().__init__(spark, folder or scratch_folder(spark, "bursts"))

    def bursts(self) -> DataFrame:
        vendor_first = F.struct(F.when(F.col("scope") == "vendor", 0).otherwise(1), -F.col("match_count"))
        best = F.min_by(F.struct("scope", "value", "match_count", F.timestamp_micros("micros").alias("first_seen_at")), vendor_first)
        return self.read(_BURSTS).groupBy("id").agg(best.alias("burst")).select("id", "burst.*")


# --- source health --------------------------------------------------------------
class SourceState(StatefulProcessor):
    """Last success, cursor, last run and failures since of one source."""

    def __init__(self, id_type: str) -> None:
        self.id_type = id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        run = f"struct<micros: long, id: {self.id_type}>"
        self.state = handle.getValueState(
            "source",
            f"success {run}, cursor_run {run}, cursor string, run {run}, status string, finished long, failures array<{run}>",
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (None, None, None, None, None, None, [])
        success, cursor_run, last = (tuple(held[k]) if held[k] is not None else None for k in (0, 1, 3))
        cursor, status, finished, failures = held[2], held[4], held[5], {tuple(run) for run in held[6]}
        every = chain.from_iterable(part.itertuples(index=False) for part in rows)
        for row in every:
            run = (int(row.micros), row.id if isinstance(row.id, str) else int(row.id))
            if row.run_status == "success":
                success = max(success or run, run)
                if row.next_cursor is not None and run >= (cursor_run or run):
                    cursor_run, cursor = run, row.next_cursor
            elif row.run_status == "failed":
                failures.add(run)
            if run >= (last or run):
                last, status = run, "failed" if row.run_status == "failed" else "success"
            if not pd.isna(row.finished):
                finished = max(finished if finished is not None else int(row.finished), int(row.finished))
        kept = sorted(run for run in failures if success is None or run > success)
        self.state.update((success, cursor_run, cursor, last, status, finished, kept))
        yield pd.DataFrame({
            "source_id": pd.Series([key[0]], dtype=object if isinstance(key[0], str) else None), "cursor": _strings([cursor]), "status": _strings([status]), "finished": pd.array([finished], dtype="Int64"),
            "consecutive_failures": [len(kept)],
        })

    def close(self) -> None:
        pass


_HEALTH = "cursor string, status string, finished long, consecutive_failures long"


def source_health(jobs: DataFrame) -> DataFrame:
    """Stream of changed source states; ``jobs`` is a stream of job rows. Rows without a source are left out."""
    with_state_store(jobs.sparkSession)
    types = {name: jobs.schema[name].dataType.simpleString() for name in ("id", "source_id")}
    runs = O.with_job_facts(jobs.filter(F.col("source_id").isNotNull())).select(
        "source_id", "id", O._micros("finished_at").alias("micros"), F.unix_micros("finished_at").alias("finished"),
        "run_status", O.job_text("metadata", "next_cursor").alias("next_cursor"),
    )
    columns = f"source_id {types['source_id']}, {_HEALTH}"
    return runs.groupBy("source_id").transformWithStateInPandas(SourceState(types["id"]), columns, "Update", "None")


class SourceHealth(Batches):
    """The newest state of every source."""

    def __init__(self, spark: SparkSession, source_type: str = "bigint", folder: str | None = None) -> None:
        super().__init__(spark, folder or scratch_folder(spark, "health"))
        self.columns = f"source_id {source_type}, {_HEALTH}"

    def states(self) -> DataFrame:
        state = F.struct("cursor", "status", F.timestamp_micros("finished").alias("last_run_at"), "consecutive_failures")
        return self.read(self.columns).groupBy("source_id").agg(F.max_by(state, "batch").alias("s")).select("source_id", "s.*")
