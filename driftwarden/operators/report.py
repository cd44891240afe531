"""Report tables: flat projections of evidence and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.functions import labels
from driftwarden.operators.root_cause import findings_per_table, score_of_tables

ABSENT = "—"


def report_schema(changes: DataFrame, extra_severity: str = "INFO") -> DataFrame:
    """Schema drift lines, with row counts if the catalog was profiled.

    ``extra_severity`` is INFO in the printed report and WARNING on the dashboard.
    """
    change = F.col("change")
    rows = [F.coalesce("source_row_count", "target_row_count").alias("row_count")]
    return changes.filter(change != "SAME").select(
        "table_name", change.alias("issue"), "column_name",
        F.coalesce("source_data_type", F.lit(ABSENT)).alias("source_type"),
        F.coalesce("target_data_type", F.lit(ABSENT)).alias("target_type"),
        F.when(change == "MISSING", "CRITICAL").when(change == "EXTRA", extra_severity)
        .otherwise("WARNING").alias("severity"), *(rows if "source_row_count" in changes.columns else []))


def report_recon(recon: DataFrame) -> DataFrame:
    return recon.select(
        "table_name", "source_count", "target_count", "delta",
        labels.percent_text(F.col("delta_pct")).alias("delta_pct"), "checksum_match", "row_status")


def report_cdc(gaps: DataFrame) -> DataFrame:
    return gaps.select(
        "table_name", "total_events", "captured", "missed",
        labels.percent_text(F.col("gap_rate")).alias("gap_rate"), labels.cdc_risk(F.col("missed")).alias("risk"))


def report_cdc_patterns(patterns: DataFrame) -> DataFrame:
    """All tables' reasons in one list."""
    described = F.col("description") if "description" in patterns.columns else F.lit(None).cast("string")
    return patterns.select(
        "reason", F.col("event_count").cast("string").alias("event_count"),
        F.coalesce(described, F.lit("")).alias("description"))


def report_findings(findings: DataFrame) -> DataFrame:
    return findings.select(
        "table_name", "root_cause", "priority", labels.confidence_pct(F.col("confidence")).alias("confidence"),
        "affected_rows", "recommended_fix")


def report_summary(findings: DataFrame, issue_score: DataFrame | None = None,
                   duration_seconds: float = 0) -> DataFrame:
    """The headline row of a run: score, counts, band and advice.

    Figures come from the findings; a run without any uses ``issue_score`` (the row of
    ``health_score``) instead.
    """
    zero = F.lit(0).cast("bigint")
    rows = findings_per_table(findings).agg(
        score_of_tables().alias("health_score"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("critical_count", "warning_count", "root_causes_found")],
        F.count(F.lit(1)).alias("tables_count"))
    if issue_score is not None:
        by_issues = issue_score.select(
            "health_score", "critical_count", "warning_count",
            (F.col("critical_count") + F.col("warning_count")).alias("root_causes_found"),
            F.lit(-1).cast("bigint").alias("tables_count"))
        # two one-row frames: the findings row wins if it saw any table
        rows = rows.unionByName(by_issues).filter("tables_count <> 0").orderBy(F.desc("tables_count")).limit(1)
    band = labels.score_band(F.col("health_score"), "report")
    return rows.withColumns({
        "duration": F.lit(f"{duration_seconds}s"), "band": band, "recommendation": labels.recommendation(band)})


def table_status_from_findings(findings: DataFrame) -> DataFrame:
    """The worst status among a table's findings."""
    status = labels.finding_status(F.col("root_cause"), F.col("priority"))
    return findings.groupBy("table_name").agg(
        labels.status_of_rank(F.max(labels.severity_rank(status))).alias("status"))


def result_severity(evidence: DataFrame, findings: DataFrame, samples: DataFrame | None = None,
                    task_status: DataFrame | None = None) -> DataFrame:
    """Display severity of each result of a run. Reads evidence and findings; pass materialized ones.

    A value comparison always shows as a warning and a task log as information.
    """
    per_table = evidence.select("table_name", F.inline(F.array(
        F.struct(F.lit("schema_diff").alias("result"), labels.schema_severity_display(
            F.size("missing_columns"), F.size("type_mismatches"), F.col("schema_severity")).alias("severity")),
        F.struct(F.lit("row_recon").alias("result"), labels.recon_severity_display(
            F.col("row_status"), F.col("delta_pct")).alias("severity")),
        F.struct(F.lit("cdc_gap").alias("result"), labels.cdc_severity_display(F.col("missed")).alias("severity")))))
    causes = findings.select(
        "table_name", F.concat_ws(":", F.lit("root_cause"), "root_cause").alias("result"),
        labels.finding_severity(F.col("root_cause"), F.col("priority")).alias("severity"))
    results = per_table.unionByName(causes)
    if samples is not None:
        results = results.unionByName(samples.select(
            "table_name", F.concat_ws(":", F.lit("sample_diff"), "column_name").alias("result"), F.lit("warning").alias("severity")))
    if task_status is not None:
        results = results.unionByName(task_status.select(
            F.lit(None).cast("string").alias("table_name"), F.concat_ws(":", F.lit("task_log"), "task_id").alias("result"),
            F.lit("info").alias("severity")))
    return results


def score_trend(history: DataFrame) -> DataFrame:
    """Change of the score against the previous run of the same migration (one row per run)."""
    previous = F.lag("health_score").over(Window.partitionBy("migration").orderBy("started_at"))
    return history.select(
        "migration", "run_id", "started_at", "health_score",
        (F.col("health_score") - previous).alias("score_change"))
