"""Evidence per table, issues with severities, table status and health score.

Evidence has one row per table, so everything below it is tiny; each operator is a single
projection or aggregate over it and the table scans behind it run once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden import config as cfg
from driftwarden.functions import labels
from driftwarden.sources.local import table_list


def assemble_evidence(schema: DataFrame, recon: DataFrame, gaps: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Join the three results per table. Each has at most one row per listed table, hence the broadcasts."""
    evidence = table_list(schema.sparkSession, tables)
    for result in (schema, recon, gaps):
        evidence = evidence.join(F.broadcast(result), "table_name", "left")
    return evidence


def _issue_array(critical_columns: Sequence[str]) -> Column:
    """All issues of an evidence row, in reporting order."""
    def issue(kind: str, severity: Column | str, detail: Column) -> Column:
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return F.struct(F.lit(kind).alias("issue_type"), severity.alias("severity"), detail.alias("detail"))

    def when_true(condition: Column, entry: Column) -> Column:
        return F.when(condition, F.array(entry)).otherwise(F.array())

    def severity_if(critical: Column) -> Column:
        return F.when(critical, "CRITICAL").otherwise("WARNING")

    missing = F.transform("missing_columns", lambda c: issue(
        "MISSING_COLUMN", "CRITICAL", labels.missing_column_detail(c["column_name"], c["source_data_type"])))
    mismatched = F.transform("type_mismatches", lambda c: issue(
        "TYPE_MISMATCH", severity_if(c["column_name"].isin(*critical_columns)),
        labels.type_mismatch_detail(c["column_name"], c["source_data_type"], c["target_data_type"])))
    extra = F.transform("extra_columns", lambda c: issue(
        "EXTRA_COLUMN", "WARNING", labels.extra_column_detail(c["column_name"], c["target_data_type"])))
    # signed on purpose: a target with surplus rows is a warning
    rows = when_true(F.col("row_status") == "MISMATCH", issue(
        "ROW_COUNT_MISMATCH", severity_if(F.col("delta_pct") > cfg.CRITICAL_ROW_DRIFT_PCT),
        labels.row_mismatch_detail(*[F.col(c) for c in ("source_count", "target_count", "delta", "delta_pct")])))
    gaps = when_true(F.col("missed") > 0, issue(
        "CDC_GAP", "CRITICAL", labels.cdc_gap_detail(F.col("missed"), F.col("gap_rate"))))
    return F.concat(missing, mismatched, extra, rows, gaps)


def recon_issues(evidence: DataFrame, critical_columns: Sequence[str] = cfg.ISSUE_CRITICAL_COLUMNS) -> DataFrame:
    """One row per issue."""
    return evidence.select(
        "table_name", "table_ordinal", F.posexplode(_issue_array(critical_columns)).alias("pos", "issue"),
    ).select("table_name", "table_ordinal", (F.col("pos") + 1).alias("issue_no"), "issue.*")


def table_health(evidence: DataFrame, critical_columns: Sequence[str] = cfg.ISSUE_CRITICAL_COLUMNS) -> DataFrame:
    """Issue counts, status and score deduction of every table."""
    issues = _issue_array(critical_columns)
    of_severity = lambda level: F.size(F.filter("issues", lambda i: i["severity"] == level))
    penalty = drift_penalty(F.col("delta_pct"), F.col("gap_rate"))
    return (
        evidence.withColumn("issues", issues)
        .withColumns({"issues_found": F.size("issues"), "critical_count": of_severity("CRITICAL"),
                      "warning_count": of_severity("WARNING")})
        .withColumn("status", F.when(F.col("critical_count") > 0, "CRITICAL")
                    .when(F.col("issues_found") > 0, "WARNING").otherwise("HEALTHY"))
        .withColumn("deduction", F.col("critical_count") * cfg.CRITICAL_POINTS
                    + F.col("warning_count") * cfg.WARNING_POINTS + penalty)
        .select("table_name", "table_ordinal", "issues_found", "critical_count", "warning_count", "status", "deduction")
    )


def drift_penalty(delta_pct: Column, gap_rate: Column) -> Column:
    rows = F.when(F.abs(delta_pct) > cfg.ROW_DRIFT_LIMIT_PCT, cfg.ROW_DRIFT_POINTS).otherwise(0)
    gap = F.when(gap_rate > cfg.CDC_GAP_LIMIT_PCT, cfg.CDC_GAP_POINTS).otherwise(0)
    return rows + gap


def score_from(deduction: Column) -> Column:
    return F.greatest(F.lit(0), 100 - F.coalesce(deduction, F.lit(0))).cast("int")


def health_score(health: DataFrame) -> DataFrame:
    """One row: issue totals and the 0-100 score of the run."""
    return health.agg(
        F.coalesce(F.sum("issues_found"), F.lit(0)).alias("issues_found"),
        F.coalesce(F.sum("critical_count"), F.lit(0)).alias("critical_count"),
        F.coalesce(F.sum("warning_count"), F.lit(0)).alias("warning_count"),
        score_from(F.sum("deduction")).alias("health_score"))


def health_score_by_table(health: DataFrame) -> DataFrame:
    """The score each table would give on its own."""
    return health.select("table_name", score_from(F.col("deduction")).alias("health_score"))


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issue counts per table and, as table 'ALL', over the run."""
    is_total = F.grouping("table_name") == 1
    return issues.rollup("table_name").agg(
        F.count("issue_type").alias("issues_found"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_count"),
        is_total.alias("is_total"),
    ).withColumn("table_name", F.when(F.col("is_total"), "ALL").otherwise(F.col("table_name"))).drop("is_total")


def needs_root_cause(score: DataFrame) -> DataFrame:
    """The run's summary row if there is anything to explain, otherwise nothing."""
    return score.filter(F.col("issues_found") > 0)


def runs_from_gaps(gaps_by_day: DataFrame, migration: str) -> DataFrame:
    """One run record per day from daily capture gaps: every gap is a critical issue."""
    rate_over = F.col("gap_rate") > cfg.CDC_GAP_LIMIT_PCT
    deduction = cfg.CRITICAL_POINTS * F.count_if(F.col("missed") > 0) + cfg.CDC_GAP_POINTS * F.count_if(rate_over)
    per_run = gaps_by_day.groupBy("as_of").agg(
        F.count_if(F.col("missed") > 0).alias("issues_found"), score_from(deduction).alias("health_score"),
        F.max("follows_activity").alias("follows_activity"))
    return per_run.filter("follows_activity").select(
        F.date_format("as_of", "yyyyMMdd").alias("run_id"), F.lit(migration).alias("migration"),
        F.lit("recon_complete").alias("status"), F.col("as_of").alias("started_at"), "health_score", "issues_found")
