"""Session settings the jobs expect. On a cluster the submitting side may override any of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan at run time: coalesce small shuffle partitions, split skewed join partitions,
    # switch to a broadcast join once a side's real size is known.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more shuffle: one batch, farm or lot may hold a
    # large part of all rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Counts, minima and maxima by a partition column come from parquet footers where the scan allows it.
    "spark.sql.parquet.aggregatePushdown": "true",
    # Recording the Python call site of every column expression takes longer than planning here.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "cropline", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> None:
    """Apply the run-time part of the settings to a session somebody else built."""
    for key, value in SETTINGS.items():
        if key.startswith(("spark.sql.adaptive.", "spark.sql.parquet.")):
            spark.conf.set(key, value)


def work_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one that the session names in spark.checkpoint.dir.

    Where the setting is missing, a local session takes a temporary folder; a cluster must name a shared one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cropline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
