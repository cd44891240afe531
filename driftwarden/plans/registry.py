"""Every query by name, over the drift views of a test-data directory."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden import config as cfg
from driftwarden.functions import conversion as cv
from driftwarden.functions import labels
from driftwarden.operators import (
    cdc, checks, declared, error_templates as templates, issues, load, lookup_table, loss_patterns as patterns, ordered_runs, partition_upsert, renames, report, root_cause, row_pairing, row_recon, schema_diff, stale_rows as staleness, task_runs, transforms, value_diff,
)
from driftwarden.plans import migrate
from driftwarden.plans.reconcile import Reconciliation
from driftwarden.session import scratch_path
from driftwarden.sources import cdc_log, drift_views as dv, run_store, staging
from driftwarden.sources.catalog import column_catalog, column_profile, observed_catalog
from driftwarden.sources.local import small_frame
from driftwarden.sources.task_logs import scan_task_logs, write_task_logs
from driftwarden.streaming import capture_match as matching, gap_stream

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.datetime(2024, 1, 31)
MIGRATION = "nightly_migration"
RUN_ID = "20240131"
BUCKETS = 64

QUERIES: dict[str, Query] = {}


def query(arg: Query | str) -> Query | Callable[[Query], Query]:
    """Register a query under its function name, or under the given one."""
    def register(fn: Query, name: str) -> Query:
        QUERIES[name] = fn
        return fn

    if isinstance(arg, str):
        return lambda fn: register(fn, arg)
    return register(arg, arg.__name__)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def recon_run(spark: SparkSession, sf: str) -> Reconciliation:
    return Reconciliation(spark, dv.all_pairs(spark, sf), dv.cdc_events(spark, sf), AS_OF)


def checked_pairs(spark: SparkSession, sf: str, *names: str) -> dict[str, cfg.TablePair]:
    """The listed pairs (all, if none is) by name, with their odd keys looked for side by side."""
    return {p.name: p for p in value_diff.checked([dv.pair(spark, sf, n) for n in names or dv.KEYS])}


def observed_changes(spark: SparkSession, sf: str, *changes: str) -> DataFrame:
    """Column changes; only columns with one of ``changes`` (all, if none is given) are counted, the others come from the schemas."""
    pairs = dv.all_pairs(spark, sf)
    return schema_diff.column_changes(observed_catalog(column_catalog(spark, pairs), column_profile(pairs, changes)))


# ---- sources, sinks and loads

@query
def stage_extract(spark: SparkSession, sf: str) -> DataFrame:
    work = scratch_path(spark, "staged")
    counts = [(name, staging.stage_extract(dv.source_view(spark, sf, name), f"{work}/{name}")) for name in dv.KEYS]
    return small_frame(spark, counts, "table_name STRING, rows_extracted BIGINT")


@query
def stage_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    source = dv.source_view(spark, sf, "purchase_order")
    path = scratch_path(spark, "staged")
    staging.stage_extract(source, path)
    return staging.read_stage(spark, path, source.schema)


@query
def load_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    batch = dv.pair(spark, sf, "inventory").target
    path = scratch_path(spark, "target")
    load.write_overwrite(batch, path)
    return staging.read_stage(spark, path, batch.schema)


def _with_deleted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All transactions in target shape, soft-deleted ones included and times unshifted."""
    return transforms.status_to_is_deleted(dv.source_view(spark, sf, "inventory_transaction"))


@query
def load_upsert(spark: SparkSession, sf: str) -> DataFrame:
    batch = dv.pair(spark, sf, "inventory_transaction").target
    return load.load_upsert(_with_deleted_rows(spark, sf), batch, "txn_id")


@query
def load_upsert_written(spark: SparkSession, sf: str) -> DataFrame:
    current = dv.pair(spark, sf, "inventory_transaction").target
    path = scratch_path(spark, "target")
    done = load.write_upsert(current, _with_deleted_rows(spark, sf), "txn_id", path)
    written = staging.read_stage(spark, path, current.schema).agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if("is_deleted").alias("deleted_rows"))
    return written.select("*", *[F.lit(n).cast("bigint").alias(k) for k, n in done.items()])


def _upserted_by_partition(spark: SparkSession, sf: str) -> tuple[partition_upsert.PartitionedTable, partition_upsert.UpsertCounts]:
    """A table of transactions after two small batches, the second of which repeats the first."""
    full, n = _with_deleted_rows(spark, sf), F.col("txn_id")
    table = partition_upsert.new_table(spark, "txn_id", 64)
    partition_upsert.create(full.where(n % 2000 != 3), table)
    changed = F.when(n % 2000 == 4, F.col("txn_qty") + 1).otherwise(F.col("txn_qty")).cast("decimal(15,2)")
    batch = full.where((n % 2000).isin(3, 4)).withColumn("txn_qty", changed)
    counts = partition_upsert.upsert(batch, table)
    partition_upsert.upsert(batch, table)
    return table, counts


@query
def load_upsert_by_partition(spark: SparkSession, sf: str) -> DataFrame:
    return partition_upsert.read(spark, _upserted_by_partition(spark, sf)[0])


@query
def load_upsert_by_partition_counts(spark: SparkSession, sf: str) -> DataFrame:
    table, counts = _upserted_by_partition(spark, sf)
    return partition_upsert.read(spark, table).agg(F.count(F.lit(1)).alias("target_total")).select(
        "*", *[F.lit(getattr(counts, c)).cast("bigint").alias(c) for c in ("rows_staged", "rows_inserted", "rows_updated")])


@query
def load_upsert_metrics(spark: SparkSession, sf: str) -> DataFrame:
    target, full = dv.pair(spark, sf, "inventory_transaction").target, _with_deleted_rows(spark, sf)
    return union_all([
        load.upsert_metrics(current, batch, "txn_id").withColumn("load", F.lit(name))
        for name, current, batch in (("backfill", target, full), ("refresh", full, target))])


@query
def upsert_conflict_keys(spark: SparkSession, sf: str) -> DataFrame:
    return load.upsert_conflict_keys(dv.base_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def cdc_events_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "events")
    cdc_log.write_cdc_events(dv.cdc_events(spark, sf), path)
    return cdc_log.read_cdc_events(spark, path).drop("updated_by", "before")


@query
def cdc_corrupt_events(spark: SparkSession, sf: str) -> DataFrame:
    """A log of which every hundredth line is cut in half: what can be read and what is damaged."""
    path = scratch_path(spark, "events")
    events = dv.cdc_events(spark, sf)
    line = F.to_json(F.struct(F.col("table_name"), F.col("event_id").cast("string").alias("event_id"), "operation"))
    cut = F.when(F.col("event_id") % 100 == 0, F.expr("left(line, length(line) - 2)")).otherwise(F.col("line"))
    events.withColumn("line", line).select(cut.alias("value")).write.text(path)
    whole = cdc_log.read_cdc_events(spark, path, skip_corrupt=True).groupBy("table_name").agg(F.count(F.lit(1)).alias("whole_events"))
    named = F.regexp_extract("line", '"table_name":"([^"]*)"', 1).alias("table_name")
    corrupt = cdc_log.read_corrupt_lines(spark, path).groupBy(named).agg(F.count(F.lit(1)).alias("corrupt_lines"))
    return whole.join(corrupt, "table_name", "full_outer").fillna(0)


@query
def cdc_summary_override(spark: SparkSession, sf: str) -> DataFrame:
    events = dv.cdc_events(spark, sf)
    figures = F.struct("total_events", "captured", "missed", "gap_rate")
    document = F.to_json(F.struct(F.create_map(F.col("table_name"), figures).alias("gap_analysis")))
    path = scratch_path(spark, "gap-summary")
    cdc.cdc_gap(events, ["vendor"]).select(document.alias("value")).write.text(path)
    return cdc.cdc_gap(cdc.filter_events(events, AS_OF), list(dv.KEYS), cdc_log.read_cdc_summary(spark, path))


@query
def task_log_scan(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "task-logs")
    write_task_logs(dv.task_logs(spark, sf), base)  # a file per log
    logs = scan_task_logs(spark, base, suffix=".txt")
    folder_value = {c: F.element_at(F.split(c, "="), -1) for c in ("dag_id", "task_id", "run_id")}
    return task_runs.task_metrics(logs.withColumns(folder_value)).drop("file_name")


@query
def report_json(spark: SparkSession, sf: str) -> DataFrame:
    run = recon_run(spark, sf).persisted()
    path = scratch_path(spark, "report")
    run_store.write_report_json(run.evidence, run.issues, path, run.findings, run.run_record(RUN_ID, MIGRATION, AS_OF))
    written = spark.read.schema("""run_id STRING, health_score INT, table_name STRING, source_count BIGINT, missed BIGINT,
        schema_severity STRING, findings ARRAY<STRUCT<root_cause: STRING>>,
        issues ARRAY<STRUCT<issue_no: INT, issue_type: STRING, severity: STRING, detail: STRING>>""").json(path)
    return written.select(
        "run_id", "health_score", F.array_join(F.transform("findings", lambda f: f["root_cause"]), "; ").alias("causes"), "table_name", "source_count", "missed", "schema_severity", F.size("issues").cast("bigint").alias("issue_count"),
        F.coalesce(F.array_join(F.transform("issues", lambda i: i["detail"]), "; "), F.lit("")).alias("details"))


#: Runs of the history: when, and whether the soft-deleted transactions had been backfilled by then.
RUNS = ((dt.datetime(2024, 1, 10), False), (dt.datetime(2024, 1, 20), False), (AS_OF, True))


def _written_history(spark: SparkSession, sf: str) -> DataFrame:
    """The records of full reconciliations at several times, each of the tables and of the log as they were, appended one by one."""
    path = scratch_path(spark, "runs")
    for as_of, backfilled in RUNS:
        pairs = [replace(p, target=_with_deleted_rows(spark, sf)) if backfilled and p.name == "inventory_transaction" else p
                 for p in dv.all_pairs(spark, sf)]
        run = Reconciliation(spark, pairs, dv.cdc_events(spark, sf).where(F.col("event_ts") < F.lit(as_of)), as_of)
        run_store.append_run(run.run_record(as_of.strftime("%Y%m%d"), MIGRATION, as_of), path)
    return run_store.run_history(spark, path)


@query
def run_history(spark: SparkSession, sf: str) -> DataFrame:
    return _written_history(spark, sf)


@query
def cdc_gap_history(spark: SparkSession, sf: str) -> DataFrame:
    """Scores from the capture gaps alone, as daily runs would have seen them."""
    return issues.runs_from_gaps(cdc.cdc_gap_by_run_day(dv.cdc_events(spark, sf)), MIGRATION)


@query
def run_record(spark: SparkSession, sf: str) -> DataFrame:
    """The run as its history keeps it, written and read again."""
    path = scratch_path(spark, "runs")
    run_store.append_run(recon_run(spark, sf).run_record(RUN_ID, MIGRATION, AS_OF), path)
    return run_store.run_history(spark, path)


@query
def score_trend(spark: SparkSession, sf: str) -> DataFrame:
    return report.score_trend(_written_history(spark, sf))


# ---- projections, filters and scalar functions

@query
def project_to_target(spark: SparkSession, sf: str) -> DataFrame:
    p = dv.pair(spark, sf, "inventory_transaction")
    staged = p.source.withColumn("is_deleted", cv.is_soft_deleted(F.col("status_code")))
    return load.project_to_target(staged, p.target.columns)


@query
def filter_soft_deleted(spark: SparkSession, sf: str) -> DataFrame:
    return transforms.filter_soft_deleted(dv.source_view(spark, sf, "inventory_transaction"))


@query
def cdc_window_filter(spark: SparkSession, sf: str) -> DataFrame:
    iso = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    text = F.when(F.col("gap_reason").isNotNull(), "not recorded").otherwise(iso)
    events = dv.cdc_events(spark, sf).withColumn("event_ts", cv.parse_iso_ts(text))
    return cdc.filter_events(events, AS_OF).select("event_id", "table_name", "event_ts")


@query
def count_non_null(spark: SparkSession, sf: str) -> DataFrame:
    p = dv.pair(spark, sf, "supplier_contract")
    return union_all([
        checks.count_non_null(df, ["contract_id", "terms_notes", "auto_renew"]).withColumn("side", F.lit(side))
        for side, df in (("source", p.source), ("target", p.target))])


@query
def char_to_boolean(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("s_suppkey") % 5
    flag = F.when(F.col("s_nationkey") % 7 == 0, None).when(n == 0, "N").when(n == 1, "y").when(n == 2, "Y").when(
        n == 3, "n").otherwise("X")
    return dv.base_table(spark, sf, "supplier").select(
        "s_suppkey", flag.alias("flag"), cv.char_to_boolean(flag).alias("as_boolean"))


@query
def decimal_to_float(spark: SparkSession, sf: str) -> DataFrame:
    return dv.source_view(spark, sf, "inventory").select(
        "item_id", "unit_cost", cv.decimal_to_float(F.col("unit_cost")).alias("as_float"))


@query
def shift_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("o_orderdate")
    return dv.base_table(spark, sf, "orders").select(
        "o_orderkey", cv.shift_timestamp(ts).alias("plus_5h"), cv.shift_timestamp(ts, -3).alias("minus_3h"))


@query
def empty_to_null(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_custkey") % 4
    note = F.when(n == 0, "").when(n == 1, "   ").when(n == 2, "\t").otherwise(
        F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")))
    return dv.base_table(spark, sf, "customer").select("c_custkey", cv.empty_to_null(note).alias("note"))


@query
def status_to_is_deleted(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "DEL").when(F.col("o_orderstatus") == "O", "ACT")
    return transforms.status_to_is_deleted(
        dv.base_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", status.alias("status_code")))


@query
def value_diff_text(spark: SparkSession, sf: str) -> DataFrame:
    def as_text(name: str, *columns: str) -> DataFrame:
        p = dv.pair(spark, sf, name)
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), cv.canonical_text(F.col(c)).alias("text"))
                          for c in columns])
        return p.target.select(cv.canonical_text(F.col(p.key)).alias("pk"), F.inline(cells))

    return union_all([
        as_text("inventory", "unit_cost", "last_counted_ts"), as_text("vendor", "active_flag", "credit_limit"),
        as_text("inventory_transaction", "txn_qty", "txn_ts", "is_deleted")])


@query
def classify_diff(spark: SparkSession, sf: str) -> DataFrame:
    return union_all([value_diff.value_diffs(p) for p in checked_pairs(spark, sf).values()])


# ---- transforms

def _transform_query(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return dv.pair(spark, sf, name).target

    QUERIES[f"transform_{name}"] = run


for _name in dv.KEYS:
    _transform_query(_name)


@query
def transform_metrics(spark: SparkSession, sf: str) -> DataFrame:
    work = scratch_path(spark, "transformed")
    return migrate.transform_metrics_frame(spark, [
        migrate.transform_table(name, dv.source_view(spark, sf, name), f"{work}/{name}") for name in dv.KEYS])


@query
def etl_summary(spark: SparkSession, sf: str) -> DataFrame:
    pairs = {p.name: p for p in dv.all_pairs(spark, sf)}
    specs = {
        name: cfg.TableSpec(name, p.key, p.target.columns, foreign_keys=cfg.TABLES[name].foreign_keys)
        for name, p in pairs.items()}
    current = {"inventory_transaction": _with_deleted_rows(spark, sf), "vendor": pairs["vendor"].target}
    runs = migrate.run_migration(
        spark, lambda name: dv.source_view(spark, sf, name), scratch_path(spark, "migration"), current, specs)
    return migrate.migration_summary(spark, runs)


@query
def etl_totals(spark: SparkSession, sf: str) -> DataFrame:
    return migrate.migration_totals(etl_summary(spark, sf))


# ---- schema comparison

@query("column_catalog")
def column_catalog_profile(spark: SparkSession, sf: str) -> DataFrame:
    pairs = dv.all_pairs(spark, sf)
    return observed_catalog(column_catalog(spark, pairs), column_profile(pairs))


@query
def schema_missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    return schema_diff.missing_columns(observed_changes(spark, sf, "MISSING")).select(
        "table_name", "column_name", F.col("source_data_type").alias("data_type"),
        F.col("source_row_count").alias("row_count"), F.col("source_non_null_count").alias("non_null_count"))


@query
def schema_extra_columns(spark: SparkSession, sf: str) -> DataFrame:
    return schema_diff.extra_columns(observed_changes(spark, sf, "EXTRA")).select(
        "table_name", "column_name", F.col("target_data_type").alias("data_type"),
        F.col("target_row_count").alias("row_count"), F.col("target_non_null_count").alias("non_null_count"))


@query
def schema_type_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return schema_diff.type_mismatches(observed_changes(spark, sf, "TYPE_MISMATCH")).select(
        "table_name", "column_name", F.col("source_data_type").alias("source_type"),
        F.col("target_data_type").alias("target_type"), "source_non_null_count", "target_non_null_count")


@query
def mismatch_type_of(spark: SparkSession, sf: str) -> DataFrame:
    return schema_diff.type_mismatches(observed_changes(spark, sf, "TYPE_MISMATCH")).select(
        "table_name", "column_name", "mismatch_type", F.col("source_row_count").alias("affected_rows"))


@query
def schema_common_columns(spark: SparkSession, sf: str) -> DataFrame:
    return schema_diff.common_columns(observed_changes(spark, sf, "SAME", "TYPE_MISMATCH")).select(
        "table_name", "column_name", "source_non_null_count", "target_non_null_count")


@query
def renamed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """One-sided columns of vendors whose target has renamed three (one with changed values), dropped one and added two."""
    source = dv.source_view(spark, sf, "vendor")
    changed = F.when(F.col("vendor_id") % 4 == 1, F.upper("vendor_name")).otherwise(F.col("vendor_name"))
    target = source.select(
        "vendor_id", changed.alias("supplier"), F.col("credit_limit").alias("credit"), F.col("active_flag").alias("is_active"),
        "nation_key", F.when(F.col("vendor_id") % 2 == 0, "Y").otherwise("N").alias("checked"), (F.col("vendor_id") % 7).alias("load_batch"))
    return union_all([renames.renamed_columns(cfg.TablePair("vendor", "vendor_id", source, target)),
                      renames.renamed_columns(dv.pair(spark, sf, "inventory_transaction"))])


@query
def schema_nullability_changes(spark: SparkSession, sf: str) -> DataFrame:
    return schema_diff.nullability_changes(observed_changes(spark, sf, "SAME", "TYPE_MISMATCH")).select(
        "table_name", "column_name", "source_nullable", "target_nullable")


@query
def columns_to_sample(spark: SparkSession, sf: str) -> DataFrame:
    return schema_diff.columns_to_sample(observed_changes(spark, sf, "TYPE_MISMATCH", "MISSING")).select(
        "table_name", "column_name", "step", "source_non_null_count")


@query("schema_diff")
def schema_diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    def names(lists: str) -> Column:
        return F.array_join(F.transform(lists, lambda c: c["column_name"]), ",").alias(lists)

    return schema_diff.schema_diff(observed_changes(spark, sf, "MISSING")).select(
        "table_name", "source_column_count", "target_column_count", names("missing_columns"),
        names("type_mismatches"), names("extra_columns"), "missing_values", "schema_severity")


@query
def schema_departures(spark: SparkSession, sf: str) -> DataFrame:
    """Migrated contracts against a declaration that they depart from in every way."""
    ddl = "contract_id BIGINT NOT NULL, contract_value DECIMAL(15,2), terms_notes STRING NOT NULL, auto_renew STRING, start_date DATE"
    return declared.schema_departures(dv.pair(spark, sf, "supplier_contract").target, ddl)


# ---- value comparison

@query
def sample_diff_missing_column(spark: SparkSession, sf: str) -> DataFrame:
    return value_diff.sample_diff(dv.pair(spark, sf, "vendor"), "vendor_tier")


@query
def sample_diff_extra_column(spark: SparkSession, sf: str) -> DataFrame:
    return value_diff.sample_diff(dv.pair(spark, sf, "inventory_transaction"), "is_deleted")


SAMPLED = (("vendor", "active_flag"), ("inventory", "unit_cost"), ("inventory", "last_counted_ts"),
           ("inventory_transaction", "txn_ts"), ("supplier_contract", "terms_notes"), ("purchase_order", "total_amount"))


@query
def sample_diff_values(spark: SparkSession, sf: str) -> DataFrame:
    pairs = checked_pairs(spark, sf)
    return union_all([value_diff.sample_diff(pairs[table], column) for table, column in SAMPLED])


@query
def sample_diff_totals(spark: SparkSession, sf: str) -> DataFrame:
    one_sided = (("vendor", "vendor_tier"), ("inventory_transaction", "is_deleted"))
    columns: dict[str, list[str]] = {}
    for table, column in SAMPLED + one_sided:
        columns.setdefault(table, []).append(column)
    pairs = checked_pairs(spark, sf, *columns)
    totals = [value_diff.sampled_totals(pairs[table], listed) for table, listed in columns.items()]
    return union_all(totals)


@query
def sample_diff_window(spark: SparkSession, sf: str) -> DataFrame:
    return union_all([
        value_diff.sample_diff(dv.pair(spark, sf, table), column, limit=10, window_rows=50) for table, column in SAMPLED])


@query
def count_affected(spark: SparkSession, sf: str) -> DataFrame:
    return union_all([value_diff.count_affected(p) for p in checked_pairs(spark, sf).values()])


@query
def diff_type_summary(spark: SparkSession, sf: str) -> DataFrame:
    return union_all([value_diff.diff_type_summary(p) for p in checked_pairs(spark, sf).values()])


@query
def diff_type_summary_narrowed(spark: SparkSession, sf: str) -> DataFrame:
    narrowed = value_diff.checked([row_recon.narrow_to_changed(p) for p in dv.all_pairs(spark, sf)])
    return union_all([value_diff.diff_type_summary(p) for p in narrowed])


@query
def row_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    pairs = value_diff.checked([*dv.all_pairs(spark, sf), dv.swapped(dv.pair(spark, sf, "inventory_transaction"))])
    return union_all([value_diff.row_status_counts(p).withColumn("direction", F.lit("swapped" if i == len(dv.KEYS) else "forward"))
                      for i, p in enumerate(pairs)])


@query
def row_status_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Line items by order: orders with several items cannot be paired, and one target side has lost rows."""
    items = dv.base_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    source, target = items.where("l_linenumber <= 2"), items.where("l_linenumber = 1 AND l_orderkey % 5 <> 0")
    return value_diff.row_status_rows(cfg.TablePair("lineitem", "l_orderkey", source, target), ["l_quantity"])


def edited_orders(spark: SparkSession, sf: str) -> cfg.TablePair:
    """Orders of which the target has lost, changed, gained and repeated a few."""
    source = dv.source_view(spark, sf, "purchase_order")
    n = F.col("po_number")
    kept = source.where(n % 997 != 0).withColumn("total_amount", F.when(n % 1009 == 1, F.col("total_amount") + 1).otherwise(
        F.col("total_amount")).cast("decimal(15,2)"))
    gained = source.where(n % 1013 == 5).withColumn("po_number", -n)
    return cfg.TablePair("purchase_order", "po_number", source, kept.unionByName(gained).unionByName(source.where(n % 1019 == 7)))


@query
def differing_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys with differing rows, read off lookup tables, in two tables that mostly agree."""
    deleted = dv.pair(spark, sf, "inventory_transaction")
    found = [(edited_orders(spark, sf), None), (deleted, ["item_id", "txn_type", "txn_qty"])]
    return union_all([lookup_table.differing_keys(p, columns).withColumnRenamed(p.key, "key").withColumn("table_name", F.lit(p.name))
                      for p, columns in found])


@query
def value_diffs_localised(spark: SparkSession, sf: str) -> DataFrame:
    """Values that differ in a table that mostly agrees; only rows under differing keys are compared."""
    return value_diff.value_diffs(lookup_table.narrow_to_differing(edited_orders(spark, sf)))


@query
def paired_line_items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items paired within their orders, of which the target has lost some and changed others."""
    items = dv.base_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    changed = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 5 == 0), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    target = items.where("NOT (l_linenumber = 2 AND l_orderkey % 7 = 0)").withColumn("l_quantity", changed)
    lines = row_pairing.paired_rows(cfg.TablePair("lineitem", "l_orderkey", items, target))
    return lines.select(
        "l_orderkey", "row_status", "row_count", "source_values.l_linenumber", "source_values.l_partkey",
        F.col("source_values.l_quantity").alias("source_quantity"), F.col("target_values.l_quantity").alias("target_quantity"),
        F.array_join("changed_columns", ",").alias("changed_columns"))


@query
def loss_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """What lost rows have in common: transactions lost by their status, and orders lost by two conditions and, a few, by chance."""
    orders = dv.base_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    kept = orders.where("NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AND o_orderkey % 97 <> 0")
    pairs = [dv.pair(spark, sf, "inventory_transaction"), cfg.TablePair("orders", "o_orderkey", orders, kept)]
    return union_all([patterns.loss_patterns(p).withColumn("table_name", F.lit(p.name)) for p in pairs])


@query
def missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    return value_diff.missing_keys(dv.pair(spark, sf, "inventory_transaction"))


@query
def extra_keys(spark: SparkSession, sf: str) -> DataFrame:
    return value_diff.extra_keys(dv.swapped(dv.pair(spark, sf, "inventory_transaction")))


@query
def common_keys(spark: SparkSession, sf: str) -> DataFrame:
    return value_diff.common_keys(dv.pair(spark, sf, "inventory_transaction"))


@query
def first_n_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return value_diff.first_n_by_key(dv.source_view(spark, sf, "inventory_transaction"), "txn_id", 10)


@query
def ts_offset_profile(spark: SparkSession, sf: str) -> DataFrame:
    columns = {"inventory": "last_counted_ts", "inventory_transaction": "txn_ts", "purchase_order": "order_date"}
    return union_all([value_diff.ts_offset_profile(p, [columns[name]]) for name, p in checked_pairs(spark, sf, *columns).items()])


# ---- counts and fingerprints

@query("row_recon")
def row_recon_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return row_recon.row_recon(dv.all_pairs(spark, sf))


@query
def row_recon_by_content(spark: SparkSession, sf: str) -> DataFrame:
    return row_recon.row_recon(dv.all_pairs(spark, sf), checksum_scope="row")


@query
def row_recon_surplus(spark: SparkSession, sf: str) -> DataFrame:
    return row_recon.row_recon([dv.swapped(dv.pair(spark, sf, "inventory_transaction"))])


@query
def key_checksum_exact(spark: SparkSession, sf: str) -> DataFrame:
    return row_recon.key_checksum_exact(dv.all_pairs(spark, sf))


@query
def key_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return row_recon.key_fingerprint(dv.all_pairs(spark, sf)).withColumn("fingerprint", F.col("fingerprint").cast("string"))


@query
def row_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return row_recon.row_fingerprint(dv.all_pairs(spark, sf)).withColumn("fingerprint", F.col("fingerprint").cast("string"))


@query
def bucket_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return union_all([
        row_recon.bucket_fingerprint(p, BUCKETS, columns).withColumn("table_name", F.lit(p.name))
        for p, columns in ((dv.pair(spark, sf, "inventory_transaction"), []),
                           (dv.pair(spark, sf, "supplier_contract"), ["terms_notes"]),
                           (dv.pair(spark, sf, "purchase_order"), ["total_amount"]))])


# ---- change capture

@query
def cdc_gap(spark: SparkSession, sf: str) -> DataFrame:
    return recon_run(spark, sf).gaps


@query
def cdc_gap_whole_log(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.cdc_gap(dv.cdc_events(spark, sf), list(dv.KEYS))


@query
def cdc_gap_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.cdc_gap_patterns(dv.cdc_events(spark, sf))


@query
def cdc_patterns_override(spark: SparkSession, sf: str) -> DataFrame:
    """A summary document that gives the patterns of one table, one event more for each reason."""
    events = dv.cdc_events(spark, sf)
    pattern = F.struct("reason", F.concat(F.lit("given: "), F.col("reason")).alias("description"), (F.col("event_count") + 1).alias("count"))
    given = cdc.cdc_gap_patterns(events).where("table_name = 'vendor'").groupBy("table_name").agg(F.collect_list(pattern).alias("gap_patterns"))
    document = F.to_json(F.struct(F.create_map(F.col("table_name"), F.struct("gap_patterns")).alias("gap_analysis")))
    path = scratch_path(spark, "gap-summary")
    given.select(document.alias("value")).write.text(path)
    patterns = cdc.cdc_gap_patterns(events, cdc_log.read_cdc_summary(spark, path))
    return report.report_cdc_patterns(patterns)


@query
def top_gap_reasons(spark: SparkSession, sf: str) -> DataFrame:
    patterns = cdc.cdc_gap_patterns(dv.cdc_events(spark, sf)).drop("pattern_no")
    return cdc.ranked_patterns(patterns, k=2)


@query
def cdc_pattern_detail(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.cdc_pattern_detail(dv.cdc_events(spark, sf)).withColumn(
        "affected_columns", F.array_join("affected_columns", ","))


@query
def cdc_summary(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.cdc_summary(cdc_gap_whole_log(spark, sf)).withColumn(
        "tables_affected", F.array_join("tables_affected", ","))


@query
def cdc_gap_windowed(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.cdc_gap_windowed(dv.cdc_events(spark, sf))


@query
def cdc_gap_windowed_undated(spark: SparkSession, sf: str) -> DataFrame:
    """A log in which every 17th event has no readable time."""
    time = F.when(F.col("event_id") % 17 != 0, F.col("event_ts"))
    return cdc.cdc_gap_windowed(dv.cdc_events(spark, sf).withColumn("event_ts", time))


@query
def cdc_gap_stream(spark: SparkSession, sf: str) -> DataFrame:
    staged, out, state = (scratch_path(spark, p) for p in ("stream-in", "stream-out", "stream-state"))
    events = dv.cdc_events(spark, sf).select("table_name", "event_ts", "captured")
    events.write.parquet(staged)
    gaps = gap_stream.cdc_gap_stream(gap_stream.stream_events(spark, staged, events.schema))
    gap_stream.write_gap_updates(gaps, out, state).awaitTermination()
    return gap_stream.read_gap_windows(spark, out)


def _changes_and_captures(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All changes, and the captured ones with the time they took: up to an hour and a half, of which one hour is allowed."""
    events = dv.cdc_events(spark, sf)
    took = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 90).cast("int"))
    return (events.select("table_name", "event_id", "event_ts"),
            events.where("captured").select("table_name", "event_id", (F.col("event_ts") + took).alias("captured_ts")))


@query
def capture_match(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_counts(matching.match_batch(*_changes_and_captures(spark, sf)))


@query
def capture_match_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same from two streams."""
    sides = []
    for df in _changes_and_captures(spark, sf):
        path = scratch_path(spark, "stream-in")
        df.write.parquet(path)
        sides.append(gap_stream.stream_events(spark, path, df.schema))
    out, state = (scratch_path(spark, p) for p in ("stream-out", "stream-state"))
    matching.write_matches(matching.match_stream(*sides), out, state).awaitTermination()
    return matching.match_counts(matching.read_matches(spark, out))


@query
def missing_event_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of event numbers that the log lacks altogether, three in fifty and some single ones of each table's log."""
    events = dv.cdc_events(spark, sf).where("event_id % 50 NOT IN (7, 8, 9) AND event_id % 333 <> 0")
    whole = ordered_runs.missing_intervals(events, "event_id", first=0).withColumn("table_name", F.lit("ALL"))
    numbered = events.withColumn("number", F.expr("event_id div 5")).where("number % 40 <> 3")
    return whole.unionByName(ordered_runs.missing_intervals(numbered, "number", ["table_name"]))


@query
def ts_offset_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets along time where a clock rule changed twice, and a few stale rows stand among the others."""
    source = dv.source_view(spark, sf, "purchase_order")
    hours = F.when(F.col("order_date") < "1996-03-31", 5).when(F.col("order_date") < "1999-10-27", 4).otherwise(5)
    moved = F.when(F.col("po_number") % 1999 == 3, F.col("order_date")).otherwise(
        F.col("order_date") + F.make_dt_interval(F.lit(0), hours))
    pair = cfg.TablePair("purchase_order", "po_number", source, source.withColumn("order_date", moved))
    return union_all([ordered_runs.ts_offset_segments(pair, "order_date", least).withColumn("least_rows", F.lit(least)) for least in (1, 100)])


def _stale(spark: SparkSession, sf: str) -> DataFrame:
    """Inventory against a log that misses every third event, and vendors, as of a made-up time of writing, against theirs."""
    events = dv.cdc_events(spark, sf)
    missing = events.where("table_name = 'inventory'").withColumn("captured", F.col("event_id") % 3 != 0)
    written = F.lit("2024-01-02").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("vendor_id") * 5 % 700).cast("int"))
    vendors = dv.pair(spark, sf, "vendor").target.withColumn("updated_ts", written)
    return union_all([
        staleness.stale_rows(rows, log, key, time).withColumn("table_name", F.lit(name)) for name, rows, log, key, time in (
            ("inventory", dv.pair(spark, sf, "inventory").target, missing, "item_id", "last_counted_ts"),
            ("vendor", vendors, events.where("table_name = 'vendor'"), "vendor_id", "updated_ts"))])


@query
def stale_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _stale(spark, sf)


@query
def stale_counts(spark: SparkSession, sf: str) -> DataFrame:
    return staleness.stale_counts(_stale(spark, sf), "table_name")


@query
def cdc_pattern_columns(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.cdc_pattern_columns(dv.cdc_events(spark, sf))


# ---- evidence, issues and score

@query
def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return recon_run(spark, sf).evidence.select(
        "table_name", "source_column_count", "target_column_count",
        *[F.size(c).cast("bigint").alias(c) for c in ("missing_columns", "type_mismatches", "extra_columns")],
        "schema_severity", "source_count", "target_count", "delta", "delta_pct", "checksum_match", "row_status",
        "total_events", "captured", "missed", "gap_rate")


@query
def recon_issues(spark: SparkSession, sf: str) -> DataFrame:
    return recon_run(spark, sf).issues.select("table_name", "issue_type", "severity", "detail")


@query
def issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return issues.issue_counts(recon_run(spark, sf).issues)


@query
def table_status(spark: SparkSession, sf: str) -> DataFrame:
    return recon_run(spark, sf).health.select("table_name", "status", F.col("issues_found").cast("bigint").alias("issues_found"))


@query
def health_score_issues(spark: SparkSession, sf: str) -> DataFrame:
    return recon_run(spark, sf).score


@query
def score_band(spark: SparkSession, sf: str) -> DataFrame:
    scores = issues.health_score_by_table(recon_run(spark, sf).health)
    bands = {f"{scheme}_band": labels.score_band(F.col("health_score"), scheme) for scheme in labels.SCORE_BANDS}
    return scores.withColumns(bands)


@query
def rca_gate(spark: SparkSession, sf: str) -> DataFrame:
    return issues.needs_root_cause(recon_run(spark, sf).score)


# ---- root causes

@query
def derived_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return root_cause.derived_mismatches(recon_run(spark, sf).evidence).select(
        "table_name", "mismatch_type", "explicit_rows")


@query
def derived_mismatches_surplus(spark: SparkSession, sf: str) -> DataFrame:
    """A target with surplus rows only: no mismatch is derived from a negative delta."""
    pairs = [dv.swapped(p) for p in dv.all_pairs(spark, sf)]
    run = Reconciliation(spark, pairs, dv.cdc_events(spark, sf), AS_OF)
    return root_cause.derived_mismatches(run.evidence).select("table_name", "mismatch_type", "explicit_rows")


@query
def root_causes(spark: SparkSession, sf: str) -> DataFrame:
    return recon_run(spark, sf).findings.select(
        "table_name", "root_cause", "confidence", "priority", "affected_rows", "recommended_fix")


@query
def root_causes_inferred(spark: SparkSession, sf: str) -> DataFrame:
    return root_cause.root_causes_inferred(recon_run(spark, sf).evidence).select(
        "table_name", "rule_key", "root_cause", "confidence", "priority", "affected_rows")


@query
def root_causes_from_values(spark: SparkSession, sf: str) -> DataFrame:
    evidence = recon_run(spark, sf).sampled_evidence(all_columns=True)
    return root_cause.root_causes_inferred(evidence).select("table_name", "rule_key", "root_cause", "affected_rows")


@query
def affected_rows(spark: SparkSession, sf: str) -> DataFrame:
    problems = root_cause.derived_mismatches(recon_run(spark, sf).sampled_evidence())
    unstated = problems.withColumnRenamed("mismatch_type", "rule_key").withColumn("explicit_rows", F.lit(0).cast("bigint"))
    return root_cause.classify(unstated).select("table_name", "rule_key", "root_cause", "affected_rows")


@query
def coverage_completion(spark: SparkSession, sf: str) -> DataFrame:
    run = recon_run(spark, sf).persisted()
    partial = run.findings.filter(F.col("priority") == "P1")
    return root_cause.complete_coverage(partial, run.evidence).select(
        "table_name", "rule_key", "root_cause", "affected_rows")


@query
def finding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return root_cause.finding_counts(recon_run(spark, sf).findings)


@query
def tables_investigated(spark: SparkSession, sf: str) -> DataFrame:
    return root_cause.tables_investigated(recon_run(spark, sf).findings)


@query
def health_score_findings(spark: SparkSession, sf: str) -> DataFrame:
    return root_cause.health_score_findings(recon_run(spark, sf).findings)


@query
def recommended_fixes(spark: SparkSession, sf: str) -> DataFrame:
    return root_cause.recommended_fixes(recon_run(spark, sf).findings, RUN_ID)


# ---- report tables

@query
def report_schema(spark: SparkSession, sf: str) -> DataFrame:
    return report.report_schema(observed_changes(spark, sf, "MISSING", "EXTRA", "TYPE_MISMATCH"))


@query
def report_recon(spark: SparkSession, sf: str) -> DataFrame:
    return report.report_recon(recon_run(spark, sf).recon)


@query
def report_cdc(spark: SparkSession, sf: str) -> DataFrame:
    return report.report_cdc(recon_run(spark, sf).gaps)


@query
def report_cdc_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return report.report_cdc_patterns(recon_run(spark, sf).patterns)


@query
def report_findings(spark: SparkSession, sf: str) -> DataFrame:
    return report.report_findings(recon_run(spark, sf).findings)


@query
def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    run = recon_run(spark, sf).persisted()
    return report.report_summary(run.findings, run.score)


@query
def table_status_from_findings(spark: SparkSession, sf: str) -> DataFrame:
    return report.table_status_from_findings(recon_run(spark, sf).findings)


@query
def result_severity(spark: SparkSession, sf: str) -> DataFrame:
    run = recon_run(spark, sf).persisted()
    columns = {}
    for table, column in SAMPLED:
        columns.setdefault(table, []).append(column)
    pairs = checked_pairs(spark, sf, *columns)
    samples = union_all([value_diff.sampled_totals(pairs[table], listed) for table, listed in columns.items()])
    status = task_runs.task_status(dv.task_logs(spark, sf), MIGRATION, cfg.RUN_TASKS)
    return report.result_severity(run.evidence, run.findings, samples, status)


# ---- task logs

@query
def parse_task_log(spark: SparkSession, sf: str) -> DataFrame:
    return task_runs.task_metrics(dv.task_logs(spark, sf))


@query
def latest_log(spark: SparkSession, sf: str) -> DataFrame:
    logs = dv.task_logs(spark, sf)
    return union_all([
        task_runs.latest_log(logs, run).select("task_id", "run_id", "file_name", F.lit(run or "any").alias("wanted_run"))
        for run in (None, "20240110", "29990101")])


@query
def task_log_status(spark: SparkSession, sf: str) -> DataFrame:
    return task_runs.task_status(dv.task_logs(spark, sf), MIGRATION, cfg.RUN_TASKS)


@query
def task_log_totals(spark: SparkSession, sf: str) -> DataFrame:
    return task_runs.run_totals(task_runs.task_metrics(dv.task_logs(spark, sf)))


def _error_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The error lines of the task logs, and two kinds of lines with a name of letters in the middle or at the start."""
    host = F.translate(F.col("primary_key").cast("string"), "0123456789", "abcdefghij")
    line = F.concat(F.lit("ERROR host "), host, F.lit(" lost "), F.col("table_name"), F.lit(" in part "), F.col("event_id").cast("string"))
    named = F.concat(host, F.lit(" ERROR "), F.col("operation"), F.lit(" refused"))
    events = dv.cdc_events(spark, sf).where("gap_reason IS NOT NULL OR event_id % 9 = 0")
    more = events.select(F.lit("capture").alias("dag_id"), F.col("table_name").alias("task_id"), F.explode(F.array(line, named)).alias("line"))
    return templates.error_lines(dv.task_logs(spark, sf)).unionByName(more)


@query
def error_templates(spark: SparkSession, sf: str) -> DataFrame:
    return templates.error_templates(templates.line_shapes(_error_lines(spark, sf)))


# ---- constraint checks

@query
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return checks.duplicate_keys(dv.base_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def null_violations(spark: SparkSession, sf: str) -> DataFrame:
    contracts = dv.pair(spark, sf, "supplier_contract").target
    return union_all([
        checks.null_violations(df, columns).withColumn("table_name", F.lit(name))
        for name, df, columns in (
            ("supplier_contract", contracts, ["contract_id", "contract_value", "terms_notes", "auto_renew"]),
            ("cdc_events", dv.cdc_events(spark, sf), ["event_ts", "captured", "gap_reason"]))])


@query
def orphan_keys(spark: SparkSession, sf: str) -> DataFrame:
    target = dv.pair(spark, sf, "inventory_transaction").target
    return checks.orphan_keys(dv.base_table(spark, sf, "lineitem"), "l_orderkey", target, "txn_id")


@query("table_health")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Per-table health: status, issues, drift figures and the score the table gives on its own."""
    run = recon_run(spark, sf)
    return run.health.select(
        "table_name", "status", "issues_found", "critical_count", "warning_count",
        issues.score_from(F.col("deduction")).alias("health_score"))
