"""Which reader serves which connector key; users add their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetsight.sources import cve, feeds, kev, pages, recalls

Reader = Callable[[SparkSession, str], DataFrame]

READERS: dict[str, Reader] = {
    "nvd": cve.read_cve_feed,
    "cisa-kev": kev.read_kev,
    "cisa-kev-csv": kev.read_kev_csv,
    "rss": feeds.read_rss,
    "atom": feeds.read_atom,
    "nhtsa-recalls": recalls.read_recalls,
    "vendor-advisories": pages.read_vendor_pages,
}


def register(key: str, reader: Reader) -> None:
    READERS[key.strip().lower()] = reader


def read(spark: SparkSession, key: str, path: str) -> DataFrame:
    if key not in READERS:
        raise KeyError(f"no reader registered for {key}; known: {sorted(READERS)}")
    return READERS[key](spark, path)
