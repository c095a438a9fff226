"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: str = "8", app: str = "fleetsight", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter makes the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings that results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def is_local(master: str) -> bool:
    """Driver and executors are one process."""
    return master == "local" or master.startswith("local[")


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="fleetsight-")


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the shared checkpoint folder the cluster names.

    Where that setting is missing a local folder is used, but only by a local master: elsewhere executors
    would write to their own disks and reads would miss rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or _local_folder()).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(frame):
    """Cut lineage through reliable storage, so that a lost executor does not recompute or change rows."""
    spark = frame.sparkSession
    path = scratch_folder(spark, "rows")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
