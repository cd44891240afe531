"""Source and target versions of the five migrated tables over the TPC-H-like test tables.

The source side renames and derives columns of a base table; the target side is that source
after the migration transforms, so it shows the drift they cause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwarden.config import TablePair
from driftwarden.operators.transforms import TRANSFORMS

# Declared, so that opening a table needs no schema-inference job.
BASE_DDL = {
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
            o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
            l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,
            l_shipdate TIMESTAMP_NTZ""",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

KEYS = {
    "vendor": "vendor_id",
    "inventory": "item_id",
    "inventory_transaction": "txn_id",
    "supplier_contract": "contract_id",
    "purchase_order": "po_number",
}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(BASE_DDL[name]).parquet(f"{sf_dir}/{name}.parquet")


# view -> (base table, select list)
SOURCE_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "vendor": ("supplier", (
        "s_suppkey AS vendor_id", "s_name AS vendor_name",
        "CASE s_suppkey % 4 WHEN 0 THEN 'PLATINUM' WHEN 1 THEN 'GOLD' WHEN 2 THEN 'SILVER' ELSE 'BRONZE' END AS vendor_tier",
        "if(s_suppkey % 5 = 0, 'N', 'Y') AS active_flag", "s_nationkey AS nation_key",
        "CAST(s_acctbal AS DECIMAL(15,2)) AS credit_limit")),
    "inventory": ("part", (
        "p_partkey AS item_id", "p_brand AS location_id", "p_size AS reorder_point",
        "CAST(CAST(p_retailprice AS DECIMAL(10,4)) + 0.1234 AS DECIMAL(10,4)) AS unit_cost",
        "TIMESTAMP_NTZ '2024-01-10 08:00:00' + make_dt_interval(0, 0, CAST(p_partkey AS INT)) AS last_counted_ts")),
    "inventory_transaction": ("orders", (
        "o_orderkey AS txn_id", "o_custkey AS item_id", "o_orderpriority AS txn_type",
        "CAST(o_totalprice AS DECIMAL(15,2)) AS txn_qty", "o_orderdate AS txn_ts",
        "if(o_orderstatus = 'P', 'DEL', 'ACT') AS status_code")),
    "supplier_contract": ("customer", (
        "c_custkey AS contract_id", "c_nationkey AS vendor_id", "CAST(c_acctbal AS DECIMAL(15,2)) AS contract_value",
        "if(c_custkey % 3 = 0, '', c_mktsegment) AS terms_notes", "if(c_custkey % 2 = 0, 'Y', 'N') AS auto_renew")),
    "purchase_order": ("orders", (
        "o_orderkey AS po_number", "o_custkey AS vendor_id", "o_orderdate AS order_date",
        "CAST(o_totalprice AS DECIMAL(15,2)) AS total_amount", "o_orderstatus AS po_status")),
}


def source_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The legacy version of one table."""
    base, columns = SOURCE_VIEWS[name]
    return base_table(spark, sf_dir, base).selectExpr(*columns)


def pair(spark: SparkSession, sf_dir: str, name: str) -> TablePair:
    source = source_view(spark, sf_dir, name)
    return TablePair(name, KEYS[name], source, TRANSFORMS[name](source))


def all_pairs(spark: SparkSession, sf_dir: str) -> list[TablePair]:
    return [pair(spark, sf_dir, name) for name in KEYS]


def swapped(p: TablePair) -> TablePair:
    """The pair with its sides exchanged: a target that has more rows than its source."""
    return TablePair(p.name, p.key, p.target, p.source)


def cdc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: only vendor misses events, and some misses have no reason."""
    lost = "(event_type = 'error' AND user_id % 5 = 0)"
    return base_table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """CASE user_id % 5 WHEN 0 THEN 'vendor' WHEN 1 THEN 'inventory' WHEN 2 THEN 'inventory_transaction'
             WHEN 3 THEN 'supplier_contract' ELSE 'purchase_order' END AS table_name""",
        "if(event_type = 'signup', 'INSERT', 'UPDATE') AS operation", "ts AS event_ts", "user_id AS primary_key",
        f"NOT {lost} AS captured",
        f"CASE WHEN {lost} AND value < 10 THEN 'CDC_TRIGGER_SKIP' WHEN {lost} AND value < 30 THEN 'TRIGGER_DISABLED_WINDOW' END"
        " AS gap_reason",
        "props AS after")


def task_logs(spark: SparkSession, sf_dir: str, dag_id: str = "nightly_migration") -> DataFrame:
    """One task log per event: its text holds a state, a duration and counts in varying spellings."""
    lines = (
        "'[info] task started'", "concat('Duration: ', CAST(value AS DECIMAL(12,2)), ' s')",
        "if(event_type = 'purchase', concat('rows_upserted => ', user_id), NULL)",
        "if(event_type <> 'signup', concat('Total rows extracted: ', event_id), NULL)",
        "if(user_id % 2 = 0, concat('Partitions used 8\\nshuffle write bytes = ', event_id * 7), NULL)",
        "if(user_id % 4 = 0, 'failed tasks 3', NULL)",
        """if(event_type = 'error', concat('ERROR first attempt failed\\n[info] retry\\nERROR attempt ', event_id, ' gave up'),
             NULL)""",
        "concat('State set to ', CASE event_type WHEN 'view' THEN 'SKIPPED' WHEN 'error' THEN 'FAILED' ELSE 'SUCCESS' END, '\\n')")
    return base_table(spark, sf_dir, "events").selectExpr(
        f"'{dag_id}' AS dag_id",
        """CASE user_id % 4 WHEN 0 THEN 'extract_from_source' WHEN 1 THEN 'transform_data' WHEN 2 THEN 'load_to_target'
             ELSE 'run_reconciliation' END AS task_id""",
        "date_format(ts, 'yyyyMMdd') AS run_id", "concat(lpad(CAST(event_id AS STRING), 12, '0'), '.log') AS file_name",
        "ts AS modified_at", f"concat_ws('\\n', {', '.join(lines)}) AS log_text")
