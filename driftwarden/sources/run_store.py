"""Run history and nested run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_DDL = "run_id STRING, migration STRING, status STRING, started_at TIMESTAMP_NTZ, health_score INT, issues_found BIGINT"
RUN_COLUMNS = [field.split()[0] for field in RUN_DDL.split(",")]


def append_run(runs: DataFrame, path: str) -> None:
    """Add finished runs to the history; earlier files are never rewritten."""
    runs.select(RUN_COLUMNS).write.mode("append").parquet(path)


def run_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_DDL).parquet(path)


def write_report_json(evidence: DataFrame, issues: DataFrame, path: str, findings: DataFrame | None = None,
                      run: DataFrame | None = None) -> None:
    """One JSON object per table: its evidence, issues and findings, and the record of the run (``RUN_COLUMNS``, one row).

    Issues and findings are bounded by the columns of a table plus a few, so the lists are safe to collect per table.
    """
    if findings is not None:
        of_table = findings.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct(
            "root_cause", "confidence", "priority", "affected_rows", "recommended_fix"))).alias("findings"))
        evidence = evidence.join(F.broadcast(of_table), "table_name", "left")
    if run is not None:
        record = run.select(RUN_COLUMNS).first()
        evidence = evidence.withColumns({c: F.lit(str(record[c]) if c == "started_at" else record[c]) for c in RUN_COLUMNS})
    per_table = issues.groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.struct("issue_no", "issue_type", "severity", "detail"))).alias("issues"))
    (
        evidence.join(F.broadcast(per_table), "table_name", "left")
        .withColumn("issues", F.coalesce("issues", F.array().cast(per_table.schema["issues"].dataType)))
        .write.mode("overwrite").json(path)
    )
