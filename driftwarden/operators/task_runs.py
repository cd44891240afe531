"""Metrics of migration task runs from their logs (``dag_id, task_id, run_id, file_name, modified_at, log_text``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.functions.log_text import parse_task_log
from driftwarden.sources.local import small_frame
from driftwarden.sources.task_logs import list_task_logs, scan_task_logs

LOG_KEY = ("dag_id", "task_id", "run_id", "file_name")


def latest_log(logs: DataFrame, run_id: str | None = None, few_tasks: bool = False) -> DataFrame:
    """The log that counts for each task.

    With a run given: its last file by name. Otherwise, and for tasks without a log in that
    run: the newest file of all runs. The choice is an aggregate over file identities, so a
    task with millions of logs is never sorted in one place. ``few_tasks`` tells that the logs
    are of a short list of tasks: the choice (one row per task) is then broadcast and no log
    text is shuffled.
    """
    in_run = F.lit(False) if run_id is None else F.col("run_id") == run_id
    rank = F.struct(
        in_run.alias("in_run"), F.when(in_run, F.col("file_name")).alias("by_name"),
        F.when(~in_run, F.col("modified_at")).alias("by_time"), F.col("run_id"), F.col("file_name"))
    chosen = logs.groupBy("dag_id", "task_id").agg(F.max(rank).alias("pick")).select(
        "dag_id", "task_id", "pick.run_id", "pick.file_name")
    return logs.join(F.broadcast(chosen) if few_tasks else chosen, list(LOG_KEY), "left_semi")


def read_latest_logs(spark: SparkSession, base: str, dag_id: str, tasks: Sequence[str], run_id: str | None = None,
                     suffix: str = ".log") -> DataFrame:
    """``latest_log`` of the listed tasks from a folder of logs, chosen by names and times alone.

    Only the chosen files are opened, one per listed task at most, however many logs the archive holds.
    """
    listed = list_task_logs(spark, base, dag_id, suffix).filter(F.col("task_id").isin(*tasks))
    chosen = latest_log(listed, run_id, few_tasks=True).select("file_path").collect()  # at most one per task
    return scan_task_logs(spark, base, dag_id, suffix=suffix, paths=[r.file_path for r in chosen])


def task_metrics(logs: DataFrame) -> DataFrame:
    """Parsed metrics of every log."""
    parsed = parse_task_log(F.col("log_text"))
    return logs.select(*LOG_KEY, *[c.alias(name) for name, c in parsed.items()])


def task_status(logs: DataFrame, dag_id: str, tasks: Sequence[str], run_id: str | None = None) -> DataFrame:
    """The latest metrics of each listed task; a task without any log is NOT_FOUND."""
    listed = small_frame(logs.sparkSession, [(t,) for t in tasks], "task_id STRING")
    of_dag = logs.filter((F.col("dag_id") == dag_id) & F.col("task_id").isin(*tasks))
    found = task_metrics(latest_log(of_dag, run_id, few_tasks=True))
    counts = ["duration_seconds", "records_processed", "records_failed"]
    # one log per listed task
    joined = listed.join(F.broadcast(found), "task_id", "left").fillna(0, counts)
    absent = F.concat(F.lit("No logs found for task: "), F.col("task_id"))
    return joined.select(
        "task_id", "run_id", F.coalesce("status", F.lit("NOT_FOUND")).alias("status"), *counts,
        F.when(F.col("status").isNull(), absent).otherwise(F.col("error_message")).alias("error_message"),
        "partitions", "shuffled_bytes", "failed_tasks")


def run_totals(metrics: DataFrame) -> DataFrame:
    """Per run: total duration and records, and how many tasks failed."""
    return metrics.groupBy("dag_id", "run_id").agg(
        F.sum("duration_seconds").alias("duration_seconds"),
        F.sum("records_processed").alias("records_processed"),
        F.count_if(F.col("status") == "FAILED").alias("failed_task_count"))
