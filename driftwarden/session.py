"""Spark session settings and the shared scratch location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # do not record a Python stack for every column expression; plans here have thousands
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def shuffle_partitions(input_bytes: int, partition_bytes: int = 256 << 20) -> int:
    """Partitions so that each holds about ``partition_bytes`` when all input is shuffled once.

    Adaptive execution merges small partitions but splits large ones only in skewed joins, so a
    session must start from enough of them for its data.
    """
    return max(8, -(-input_bytes // partition_bytes))


def build_session(app_name: str = "driftwarden", master: str | None = None, input_bytes: int | None = None,
                  **conf: str) -> SparkSession:
    """Create (or reuse) a session sized for its input; pass further settings as ``**{"spark.key": "value"}``."""
    builder = SparkSession.builder.appName(app_name)
    if input_bytes is not None:
        conf = {"spark.sql.shuffle.partitions": str(shuffle_partitions(input_bytes)), **conf}
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh, never reused path in the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a single-machine session that
    leaves it unset gets a temporary folder; on a cluster an unset folder is an error, because
    executors could not read what the driver's machine holds.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = os.path.join(tempfile.gettempdir(), "driftwarden-scratch")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage.

    Used for small per-run results (evidence, findings) that several reports read, so the table
    scans behind them run once and survive the loss of an executor.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, purpose: str) -> tuple[DataFrame, int]:
    """``materialize`` with the number of rows, counted while they are written."""
    path, seen = scratch_path(df.sparkSession, purpose), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]
