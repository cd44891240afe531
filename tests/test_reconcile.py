"""Golden figures of a whole reconciliation on the seed-shaped tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftwarden.config import TABLES, TablePair
from driftwarden.operators import issues, report, root_cause, row_recon, schema_diff, value_diff
from driftwarden.operators.cdc import cdc_gap, cdc_summary
from driftwarden.plans.reconcile import Reconciliation, sampling_columns
from driftwarden.sources.catalog import column_catalog
from driftwarden.sources.cdc_log import _event_columns
from tests import seeds


@pytest.fixture(scope="module")
def run(spark):
    events = _event_columns(seeds.raw_events(spark))
    summary = spark.createDataFrame([seeds.VENDOR_SUMMARY], seeds.SUMMARY_DDL)
    return Reconciliation(spark, seeds.pairs(spark), events, gap_summary=summary).persisted()


def test_row_recon(spark, rows):
    got = rows(row_recon.row_recon(seeds.pairs(spark)), "table_name", "source_count", "target_count", "delta", "delta_pct", "row_status")
    assert got == sorted([
        ("vendor", 20, 20, 0, 0.0, "MATCH"), ("inventory", 20, 20, 0, 0.0, "MATCH"), ("purchase_order", 15, 15, 0, 0.0, "MATCH"),
        ("inventory_transaction", 25, 19, 6, 24.0, "MISMATCH"), ("supplier_contract", 12, 12, 0, 0.0, "MATCH")], key=repr)


def test_row_recon_by_content_sees_value_drift(spark, rows):
    got = dict(rows(row_recon.row_recon(seeds.pairs(spark), "row"), "table_name", "row_status"))
    assert got == {"vendor": "MISMATCH", "inventory": "MISMATCH", "purchase_order": "MATCH", "inventory_transaction": "MISMATCH",
                   "supplier_contract": "MISMATCH"}


def test_schema_diff(run):
    got = {r.table_name: r for r in run.schema.collect()}
    assert {t: r.schema_severity for t, r in got.items()} == {
        "vendor": "CRITICAL", "inventory": "WARNING", "inventory_transaction": "CRITICAL", "supplier_contract": "WARNING",
        "purchase_order": "HEALTHY"}
    vendor = got["vendor"]
    assert (vendor.source_column_count, vendor.target_column_count) == (11, 10)
    assert [c.column_name for c in vendor.missing_columns] == ["vendor_tier"]
    assert [c.column_name for c in vendor.type_mismatches] == ["active_flag"]
    assert [c.column_name for c in got["inventory_transaction"].extra_columns] == ["is_deleted"]


def test_issues_and_score(run, rows):
    assert run.score.first().asDict() == {"issues_found": 8, "critical_count": 5, "warning_count": 3, "health_score": 0}
    got = rows(run.issues, "table_name", "issue_type", "severity", "detail")
    assert ("inventory_transaction", "ROW_COUNT_MISMATCH", "CRITICAL", "source=25 target=19 delta=6 (24.0%)") in got
    assert ("vendor", "CDC_GAP", "CRITICAL", "847 events missed (20.02% gap rate)") in got
    assert ("vendor", "TYPE_MISMATCH", "CRITICAL", "Column 'active_flag': source=character varying target=boolean") in got
    assert ("inventory", "TYPE_MISMATCH", "WARNING", "Column 'unit_cost': source=numeric(10,4) target=double precision") in got
    counts = {r.table_name: r.issues_found for r in issues.issue_counts(run.issues).collect()}
    assert counts == {"vendor": 3, "inventory": 1, "inventory_transaction": 3, "supplier_contract": 1, "ALL": 8}


def test_findings(run, rows):
    got = rows(run.findings, "table_name", "root_cause", "confidence", "priority", "affected_rows")
    assert got == sorted([
        ("vendor", "CDC_SCHEMA_DRIFT", 0.94, "P1", 20), ("vendor", "TYPE_COERCION", 0.91, "P2", 20),
        ("vendor", "CDC_TRIGGER_GAP", 0.96, "P1", 847), ("inventory", "TYPE_COERCION", 0.88, "P2", 20),
        ("inventory_transaction", "CDC_SCHEMA_DRIFT", 0.94, "P1", 25), ("inventory_transaction", "SOFT_DELETE_MISMATCH", 0.95, "P1", 6),
        ("supplier_contract", "TYPE_COERCION", 0.91, "P2", 12), ("purchase_order", "HEALTHY", 0.99, "P3", 0)], key=repr)
    assert root_cause.health_score_findings(run.findings).first().asDict() == {
        "health_score": 5, "critical_count": 4, "warning_count": 3}


def test_report_summary_prefers_findings(run):
    summary = report.report_summary(run.findings, run.score).first()
    assert (summary.health_score, summary.critical_count, summary.warning_count, summary.root_causes_found, summary.band) == (
        5, 4, 3, 7, "CRITICAL")
    none = run.findings.limit(0)
    fallback = report.report_summary(none, run.score).first()
    assert (fallback.health_score, fallback.critical_count, fallback.root_causes_found) == (0, 5, 8)


def test_recommended_fixes_are_numbered_in_finding_order(run):
    got = [(r.fix_no, r.table_name, r.root_cause) for r in root_cause.recommended_fixes(run.findings, "r1").orderBy("fix_no").collect()]
    assert got[0] == (1, "vendor", "CDC_SCHEMA_DRIFT") and [n for n, *_ in got] == list(range(1, 8))


def test_score_of_four_p1_two_p2_and_two_penalties(spark):
    """100 - 4*15 - 2*5 - 10 - 10 = 10."""
    data = [("a", "P1", 24.0, 0.0), ("a", "P1", 24.0, 0.0), ("b", "P1", 0.0, 20.0), ("b", "P1", 0.0, 20.0), ("c", "P2", 0.0, 0.0),
            ("d", "P2", 1.0, 2.0), ("e", "P3", 0.0, 0.0)]
    findings = spark.createDataFrame(data, "table_name STRING, priority STRING, delta_pct DOUBLE, gap_rate DOUBLE").withColumn(
        "root_cause", F.when(F.col("priority") == "P3", "HEALTHY").otherwise("X"))
    assert root_cause.health_score_findings(findings).first().health_score == 10


def test_identical_tables_are_healthy(spark):
    pairs = [TablePair(n, TABLES[n].key, seeds.source(spark, n), seeds.source(spark, n)) for n in TABLES]
    events = _event_columns(seeds.raw_events(spark)).filter("captured")
    clean = Reconciliation(spark, pairs, events).persisted()
    assert clean.score.first().asDict() == {"issues_found": 0, "critical_count": 0, "warning_count": 0, "health_score": 100}
    assert {r.root_cause for r in clean.findings.collect()} == {"HEALTHY"}
    assert issues.needs_root_cause(clean.score).count() == 0
    assert {r.rule_key for r in root_cause.root_causes_inferred(clean.evidence).collect()} == {"HEALTHY"}


def test_surplus_target_is_a_warning_without_derived_mismatch(spark):
    p = seeds.pair(spark, "purchase_order")
    short = TablePair(p.name, p.key, p.source.filter("po_number <> 'PO-0001'"), p.target)
    run = Reconciliation(spark, [short], _event_columns(seeds.raw_events(spark)))
    issue = run.issues.first()
    assert (issue.issue_type, issue.severity) == ("ROW_COUNT_MISMATCH", "WARNING")
    assert run.findings.first().root_cause == "HEALTHY"
    assert root_cause.root_causes_inferred(run.evidence).first().rule_key == "SOFT_DELETE"


def test_changed_key_alone_is_null_empty(spark):
    p = seeds.pair(spark, "purchase_order")
    renamed = p.target.withColumn("po_number", F.when(F.col("po_number") == "PO-0001", "PO-9999").otherwise(F.col("po_number")))
    run = Reconciliation(spark, [TablePair(p.name, p.key, p.source, renamed)], _event_columns(seeds.raw_events(spark)))
    assert (run.recon.first().delta, run.recon.first().row_status) == (0, "MISMATCH")
    finding = run.findings.first()
    assert (finding.root_cause, finding.affected_rows) == ("NULL_EMPTY_MISMATCH", 15)


def test_content_checksum_reaches_the_null_empty_rule(spark):
    p = seeds.pair(spark, "purchase_order")
    changed = p.target.withColumn("approved_by", F.lit(""))
    run = Reconciliation(spark, [TablePair(p.name, p.key, p.source, changed)], _event_columns(seeds.raw_events(spark)), checksum_scope="row")
    assert run.findings.first().root_cause == "NULL_EMPTY_MISMATCH"


@pytest.mark.parametrize(("evidence", "expected"), [
    ({"diff_type": "FLOAT_ROUNDING"}, "FLOAT_ROUNDING"), ({"diff_type": "TZ_DRIFT", "delta": 3}, "TZ_DRIFT"),
    ({"diff_type": "VALUE_MISMATCH"}, "UNKNOWN"), ({"delta": 3, "row_status": "MISMATCH"}, "SOFT_DELETE"),
    ({"schema_severity": "WARNING"}, "MISSING_COLUMN"), ({"row_status": "MISMATCH"}, "SOFT_DELETE"),
    ({"gap_rate": 0.5, "missed": 1, "diff_type": "TZ_DRIFT"}, "CDC_TRIGGER_SKIP"), ({"missed": 1}, "UNKNOWN"), ({}, "HEALTHY")])
def test_inferred_rule_order(spark, evidence, expected):
    base = {"gap_rate": 0.0, "delta": 0, "missed": 0, "schema_severity": "HEALTHY", "row_status": "MATCH", "diff_type": None, **evidence}
    df = spark.createDataFrame([tuple(base.values())], "gap_rate DOUBLE, delta BIGINT, missed BIGINT, schema_severity STRING, "
                               "row_status STRING, diff_type STRING").selectExpr(
        "*", "CAST(array() AS ARRAY<STRUCT<column_name: STRING>>) AS missing_columns",
        "CAST(array() AS ARRAY<STRUCT<column_name: STRING>>) AS type_mismatches")
    assert df.select(root_cause.infer_rule_key(True)).first()[0] == expected


def test_unlisted_rule_is_unknown(spark):
    problems = spark.createDataFrame([("t", "NOT_A_RULE", 0, 9, 0, 0)],
                                     "table_name STRING, rule_key STRING, explicit_rows BIGINT, source_count BIGINT, delta BIGINT, missed BIGINT")
    got = root_cause.classify(problems).first()
    assert (got.root_cause, got.confidence, got.priority, got.affected_rows) == ("UNKNOWN", 0.5, "P2", 0)


def test_coverage_completion(run, rows):
    partial = run.findings.filter("table_name = 'vendor'")
    got = rows(root_cause.complete_coverage(partial, run.evidence), "table_name", "root_cause")
    assert ("purchase_order", "HEALTHY") in got and ("inventory", "CDC_SCHEMA_DRIFT") in got
    assert {t for t, _ in got} == set(TABLES)


def test_cdc_from_events(spark):
    gaps = cdc_gap(_event_columns(seeds.raw_events(spark)), list(TABLES))
    got = {r.table_name: (r.total_events, r.captured, r.missed, r.gap_rate) for r in gaps.collect()}
    assert got == {"vendor": (28, 10, 18, 64.29), "inventory": (2, 2, 0, 0.0), "purchase_order": (1, 1, 0, 0.0),
                   "inventory_transaction": (3, 3, 0, 0.0), "supplier_contract": (1, 1, 0, 0.0)}


def test_cdc_summary_totals(spark):
    gaps = spark.createDataFrame([seeds.VENDOR_SUMMARY, ("inventory", 18450, 18450, 0, 0.0), ("purchase_order", 8920, 8920, 0, 0.0),
                                  ("inventory_transaction", 12340, 12340, 0, 0.0), ("supplier_contract", 3892, 3892, 0, 0.0)], seeds.SUMMARY_DDL)
    got = cdc_summary(gaps).first()
    assert (got.total_events, got.captured, got.missed, got.gap_rate, got.tables_affected) == (47832, 46985, 847, 1.77, ["vendor"])


def test_sampled_affected_rows(run, rows):
    problems = root_cause.derived_mismatches(run.sampled_evidence()).withColumnRenamed("mismatch_type", "rule_key").withColumn(
        "explicit_rows", F.lit(0).cast("bigint"))
    got = rows(root_cause.classify(problems), "table_name", "rule_key", "affected_rows")
    assert ("inventory", "FLOAT_ROUNDING", 20) in got and ("vendor", "MISSING_COLUMN", 847) in got
    assert ("inventory_transaction", "MISSING_COLUMN", 25) in got and ("inventory_transaction", "SOFT_DELETE", 6) in got


def test_clock_drift_is_found_when_all_columns_are_compared(spark):
    p = seeds.pair(spark, "purchase_order")
    shifted = TablePair(p.name, p.key, p.source, p.target.withColumn("created_ts", F.col("created_ts") + F.expr("INTERVAL 5 HOURS")))
    run = Reconciliation(spark, [shifted], _event_columns(seeds.raw_events(spark)))
    assert root_cause.root_causes_inferred(run.sampled_evidence()).first().root_cause == "HEALTHY"
    found = root_cause.root_causes_inferred(run.sampled_evidence(all_columns=True)).first()
    assert (found.root_cause, found.affected_rows) == ("TZ_MISMATCH", 15)


def test_sampling_columns(spark):
    assert sampling_columns(seeds.pair(spark, "inventory"), all_columns=True)[:2] == ["unit_cost", "last_counted_ts"]
    assert sampling_columns(seeds.pair(spark, "vendor")) == ["active_flag", "vendor_tier"]
    assert sampling_columns(seeds.pair(spark, "purchase_order")) == []


def test_nullability_from_declared_flags(spark, rows):
    p = seeds.pair(spark, "supplier_contract")
    changes = schema_diff.column_changes(column_catalog(spark, [p]))
    assert "auto_renew" in {r.column_name for r in schema_diff.nullability_changes(changes).collect()}


def test_result_severity(run, rows):
    got = rows(report.result_severity(run.evidence, run.findings))
    assert ("inventory_transaction", "row_recon", "critical") in got and ("inventory", "schema_diff", "warning") in got
    assert ("purchase_order", "root_cause:HEALTHY", "healthy") in got and ("vendor", "cdc_gap", "critical") in got


def test_missing_keys(spark):
    got = value_diff.missing_keys(seeds.pair(spark, "inventory_transaction"))
    assert sorted(r.txn_id for r in got.collect()) == list(seeds.DELETED_TXNS)
