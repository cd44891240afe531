"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from driftwarden.config import TablePair
from driftwarden.operators import value_diff
from driftwarden.plans.registry import QUERIES, recon_run
from driftwarden.sources import drift_views as dv
from driftwarden.sources.staging import stage_bucketed

# results of these were already computed while the query was built, or come from a stream
WRITTEN = {"stage_extract", "transform_metrics", "etl_summary", "etl_totals", "cdc_gap_stream", "capture_match_stream"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITTEN))
def test_no_cross_joins_no_python_and_no_windows_over_rows(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not [op for op in FORBIDDEN if op in plan]
    if re.search(r"\bWindow \[", plan):  # these rank reasons, findings, runs and verdicts, or look inside written ranges
        assert name in {"cdc_gap_patterns", "top_gap_reasons", "score_trend", "recommended_fixes", "missing_event_ids", "ts_offset_segments",
                        "stale_rows", "stale_counts"}


def test_joins_do_not_broadcast_tables(spark, sf_dir):
    """With size-based broadcasting off, only the explicitly bounded sides are broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("missing_keys", "extra_keys", "load_upsert", "orphan_keys"):
            plan = plan_of(QUERIES[name](spark, sf_dir))
            assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan, name
        # children are counted per key before they meet their parents
        plan = plan_of(QUERIES["orphan_keys"](spark, sf_dir))
        assert plan.index("SortMergeJoin") < plan.index("HashAggregate")
        assert "SortMergeJoin" not in plan_of(QUERIES["key_checksum_exact"](spark, sf_dir))
        # rows are counted per key by hash aggregates and paired by joins; nothing is sorted to be aggregated
        for name in ("classify_diff", "diff_type_summary", "count_affected", "row_status_counts", "ts_offset_profile"):
            assert "SortAggregate" not in plan_of(QUERIES[name](spark, sf_dir)), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["missing_event_ids", "ts_offset_segments", "stale_rows"])
def test_no_window_over_a_whole_table(spark, sf_dir, name):
    windows = re.findall(r"\bWindow \[.*?\], \[([^\]]*)\]", plan_of(QUERIES[name](spark, sf_dir)))
    assert windows and all("range__" in w for w in windows)


@pytest.mark.parametrize(("name", "pairs"), [("diff_type_summary", 5), ("classify_diff", 5), ("row_status_counts", 6)])
def test_a_pair_without_odd_keys_is_two_scans_and_one_join(spark, sf_dir, name, pairs):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert plan.count("FileScan parquet") == 2 * pairs and len(re.findall(r"(SortMerge|ShuffledHash|BroadcastHash)Join", plan)) == pairs


def test_bucketed_tables_are_aligned_without_shuffling_their_rows(spark):
    """Only the row counts per key are shuffled."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("bucketed_source", "bucketed_target"):
            stage_bucketed(spark.range(100).selectExpr("id AS k", "id * 2 AS v"), name, "k", 4)
        p = TablePair("t", "k", spark.table("bucketed_source"), spark.table("bucketed_target"))
        aligned = value_diff.align(p, ["v"])
        assert aligned.count() == 100
        exchanges = [x for x in plan_of(aligned).split("Exchange hashpartitioning")[1:]]
        assert all("source_rows__" in x.split("\n(")[0] or "k#" in x.split("\n(")[0] for x in exchanges)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("bucketed_source", "bucketed_target"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_row_recon_reads_keys_only(spark, sf_dir):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES["row_recon"](spark, sf_dir)))
    columns = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert columns == {"s_suppkey", "p_partkey", "o_orderkey", "o_orderstatus", "c_custkey"}


def test_lookback_filter_reaches_the_scan(spark, sf_dir):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,2024-01-24", plan_of(QUERIES["cdc_gap"](spark, sf_dir)))


def test_evidence_scans_every_table_once(spark, sf_dir):
    """Issues, score and findings add no scan to those of the evidence: both sides of five tables, and the events."""
    run = recon_run(spark, sf_dir)
    for df in (run.evidence, run.issues, run.score, run.findings):
        assert plan_of(df).count("FileScan parquet") == 2 * len(dv.KEYS) + 1


def test_entry_and_contract(spark):
    df = contract.entry(spark)
    assert df.count() == 5 and df.columns == [
        "table_name", "status", "issues_found", "critical_count", "warning_count", "health_score"]
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())
    assert not [n for n in QUERIES if "pipeline" in n or re.match(r"op\d", n)]
