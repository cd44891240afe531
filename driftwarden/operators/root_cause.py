"""Rule-based root causes of the drift found in the evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwarden import config as cfg
from driftwarden.functions.labels import mismatch_type_of
from driftwarden.operators.issues import drift_penalty, score_from
from driftwarden.sources.local import rule_table

# what a finding keeps of its table's evidence
EVIDENCE_FIELDS = ("source_count", "delta", "delta_pct", "missed", "gap_rate")


def derived_mismatches(evidence: DataFrame) -> DataFrame:
    """One row per distinct problem of a table, or one HEALTHY row. Explicit row counts come along."""
    source_count, missed, delta = F.col("source_count"), F.col("missed"), F.col("delta")
    has_missing = F.size("missing_columns") > 0
    has_mismatch = F.size("type_mismatches") > 0

    def problem(kind: Column | str, rows: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("mismatch_type"), rows.cast("bigint").alias("explicit_rows"))

    def if_true(condition: Column, entry: Column) -> Column:
        return F.when(condition, F.array(entry)).otherwise(F.array())

    type_problems = F.transform("type_mismatches", lambda c: problem(
        mismatch_type_of(c["source_data_type"], c["target_data_type"]), source_count))
    only_checksum = (
        (F.col("row_status") == "MISMATCH") & (delta == 0) & ~has_missing & ~has_mismatch & (missed == 0))
    problems = F.concat(
        if_true(has_missing, problem("MISSING_COLUMN", source_count)),
        type_problems,
        if_true(missed > 0, problem("CDC_TRIGGER_SKIP", missed)),
        if_true(delta > 0, problem("SOFT_DELETE", F.abs(delta))),
        if_true(only_checksum, problem("NULL_EMPTY", source_count)))
    clean = F.array(problem("HEALTHY", F.lit(0)))
    listed = evidence.withColumn("problems", problems).withColumn(
        "problems", F.when(F.size("problems") > 0, F.col("problems")).otherwise(clean))
    kept = [c for c in ("table_ordinal", *EVIDENCE_FIELDS, "sample_affected") if c in evidence.columns]
    return listed.select("table_name", *kept, F.posexplode("problems").alias("pos", "p")).select(
        "table_name", *kept, (F.col("pos") + 1).alias("finding_no"), "p.*")


def infer_rule_key(has_diff_type: bool = False) -> Column:
    """The most specific rule the evidence of a table supports."""
    diff_type = F.col("diff_type") if has_diff_type else F.lit(None).cast("string")
    flags = F.exists("type_mismatches", lambda c: c["column_name"] == "active_flag")
    no_lists = (F.size("missing_columns") == 0) & (F.size("type_mismatches") == 0)
    clean = no_lists & (F.col("gap_rate") == 0) & (F.col("delta") == 0) & (F.col("missed") == 0) & (
        F.coalesce(diff_type, F.lit("")) == "")
    by_diff = diff_type.isin("FLOAT_ROUNDING", "TZ_DRIFT", "NULL_EMPTY", "TYPE_COERCION_BOOL")
    return (
        F.when(F.size("missing_columns") > 0, "MISSING_COLUMN")
        .when(flags, "TYPE_COERCION_BOOL")
        .when(F.col("gap_rate") > 0, "CDC_TRIGGER_SKIP")
        .when(by_diff, diff_type)
        .when(F.col("delta") > 0, "SOFT_DELETE")
        .when(F.col("schema_severity").isin("CRITICAL", "WARNING"), "MISSING_COLUMN")
        .when(F.col("row_status") == "MISMATCH", "SOFT_DELETE")
        .when(clean, "HEALTHY")
        .otherwise("UNKNOWN")
    )


def affected_rows(root_cause: Column, explicit: Column, sample_affected: Column) -> Column:
    """Explicit count if given, else the count that fits the cause."""
    source_count = F.col("source_count")
    by_cause = (
        F.when(root_cause.isin("CDC_SCHEMA_DRIFT", "CDC_TRIGGER_GAP"),
               F.when(F.col("missed") > 0, F.col("missed")).otherwise(source_count))
        .when(root_cause.isin("TYPE_COERCION", "TZ_MISMATCH", "NULL_EMPTY_MISMATCH"),
              F.coalesce(F.nullif(sample_affected, F.lit(0)), source_count))
        .when(root_cause == "SOFT_DELETE_MISMATCH", F.abs(F.col("delta")))
        .otherwise(0)
    )
    return F.when(root_cause == "HEALTHY", 0).when(explicit > 0, explicit).otherwise(by_cause).cast("bigint")


def classify(problems: DataFrame, rules: Sequence[cfg.RootCauseRule] = cfg.ROOT_CAUSE_RULES) -> DataFrame:
    """Attach root cause, confidence, priority, fix and affected rows by ``rule_key``.

    The rule table is a handful of constants, hence the broadcast; an unlisted key gets the
    UNKNOWN rule.
    """
    known = [r.mismatch_type for r in rules]
    key = F.when(F.col("rule_key").isin(*known), F.col("rule_key")).otherwise(cfg.UNKNOWN_RULE.mismatch_type)
    sample = F.col("sample_affected") if "sample_affected" in problems.columns else F.lit(None).cast("bigint")
    ruled = problems.withColumn("rule_key", key).join(
        F.broadcast(rule_table(problems.sparkSession, rules)), "rule_key")
    return ruled.withColumn("affected_rows", affected_rows(F.col("root_cause"), F.col("explicit_rows"), sample))


FINDING_COLUMNS = ("table_name", "table_ordinal", "finding_no", "rule_key", "root_cause", "confidence", "priority",
                   "affected_rows", "recommended_fix", *EVIDENCE_FIELDS)


def root_causes(evidence: DataFrame, rules: Sequence[cfg.RootCauseRule] = cfg.ROOT_CAUSE_RULES) -> DataFrame:
    """Findings: every derived mismatch with its root cause."""
    problems = derived_mismatches(evidence).withColumnRenamed("mismatch_type", "rule_key")
    return classify(problems, rules).select(*FINDING_COLUMNS)


def root_causes_inferred(evidence: DataFrame,
                         rules: Sequence[cfg.RootCauseRule] = cfg.ROOT_CAUSE_RULES) -> DataFrame:
    """One finding per table from the evidence alone (optional column ``diff_type``)."""
    problems = evidence.withColumns({
        "rule_key": infer_rule_key("diff_type" in evidence.columns),
        "explicit_rows": F.lit(0).cast("bigint"),
        "finding_no": F.lit(1)})
    return classify(problems, rules).select(*FINDING_COLUMNS)


def complete_coverage(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Add an inferred finding for every table that has none. Both inputs are per-run summaries."""
    covered = F.broadcast(findings.select("table_name").distinct())
    return findings.unionByName(root_causes_inferred(evidence.join(covered, "table_name", "left_anti")))


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.count_if(F.col("priority") == "P1").alias("p1_count"),
        F.count_if(F.col("priority") == "P2").alias("p2_count"),
        F.count_if(F.col("root_cause") != "HEALTHY").alias("root_causes_found"),
        F.count(F.lit(1)).alias("finding_count"))


def tables_investigated(findings: DataFrame) -> DataFrame:
    return findings.select("table_name").distinct()


def findings_per_table(findings: DataFrame) -> DataFrame:
    """P1, P2 and all non-healthy findings of each table, and its drift penalty.

    Every finding carries its table's drift figures, so the penalties need no second look at
    the evidence.
    """
    real = F.col("root_cause") != "HEALTHY"
    return findings.groupBy("table_name").agg(
        F.count_if(real & (F.col("priority") == "P1")).alias("critical_count"),
        F.count_if(real & (F.col("priority") == "P2")).alias("warning_count"),
        F.count_if(real).alias("root_causes_found"),
        F.max(drift_penalty(F.col("delta_pct"), F.col("gap_rate"))).alias("penalty"))


def score_of_tables() -> Column:
    """Aggregate over ``findings_per_table``: the score of the run."""
    return score_from(F.sum(
        F.col("critical_count") * cfg.CRITICAL_POINTS + F.col("warning_count") * cfg.WARNING_POINTS
        + F.col("penalty")))


def health_score_findings(findings: DataFrame) -> DataFrame:
    """One row: the score and the P1/P2 counts, healthy tables not counted."""
    zero = F.lit(0).cast("bigint")
    return findings_per_table(findings).agg(
        score_of_tables().alias("health_score"),
        F.coalesce(F.sum("critical_count"), zero).alias("critical_count"),
        F.coalesce(F.sum("warning_count"), zero).alias("warning_count"))


def recommended_fixes(findings: DataFrame, run_id: str) -> DataFrame:
    """Numbered fixes of one run in finding order. A run has a few findings per table."""
    order = Window.partitionBy("run_id").orderBy("table_ordinal", "finding_no")
    return (
        findings.filter(F.col("root_cause") != "HEALTHY").withColumn("run_id", F.lit(run_id))
        .select(F.row_number().over(order).cast("bigint").alias("fix_no"), "priority", "table_name", "root_cause",
                "recommended_fix")
    )
