"""The same results in SQL that DuckDB runs on the base tables, one statement per query.

Written independently of the Spark operators: key checksums are the digest of the ordered key
list, severities and root causes are spelled out as SQL. All statements share one list of
common table expressions.
"""

from __future__ import annotations

import re

from driftwarden import config as cfg

TABLES = ("vendor", "inventory", "inventory_transaction", "supplier_contract", "purchase_order")
KEYS = {"vendor": "vendor_id", "inventory": "item_id", "inventory_transaction": "txn_id",
        "supplier_contract": "contract_id", "purchase_order": "po_number"}

# (column, source type, target type); None where a side lacks the column
COLUMNS: dict[str, list[tuple[str, str | None, str | None]]] = {
    "vendor": [
        ("vendor_id", "bigint", "bigint"), ("vendor_name", "character varying", "character varying"),
        ("vendor_tier", "character varying", None), ("active_flag", "character varying", "boolean"),
        ("nation_key", "integer", "integer"), ("credit_limit", "numeric(15,2)", "numeric(15,2)")],
    "inventory": [
        ("item_id", "bigint", "bigint"), ("location_id", "character varying", "character varying"),
        ("reorder_point", "integer", "integer"), ("unit_cost", "numeric(10,4)", "double precision"),
        ("last_counted_ts", "timestamp without time zone", "timestamp without time zone")],
    "inventory_transaction": [
        ("txn_id", "bigint", "bigint"), ("item_id", "bigint", "bigint"),
        ("txn_type", "character varying", "character varying"), ("txn_qty", "numeric(15,2)", "numeric(15,2)"),
        ("txn_ts", "timestamp without time zone", "timestamp without time zone"),
        ("status_code", "character varying", None), ("is_deleted", None, "boolean")],
    "supplier_contract": [
        ("contract_id", "bigint", "bigint"), ("vendor_id", "integer", "integer"),
        ("contract_value", "numeric(15,2)", "numeric(15,2)"),
        ("terms_notes", "character varying", "character varying"), ("auto_renew", "character varying", "boolean")],
    "purchase_order": [
        ("po_number", "bigint", "bigint"), ("vendor_id", "bigint", "bigint"),
        ("order_date", "timestamp without time zone", "timestamp without time zone"),
        ("total_amount", "numeric(15,2)", "numeric(15,2)"), ("po_status", "character varying", "character varying")],
}


def _shared(table: str) -> list[str]:
    return [c for c, s, t in COLUMNS[table] if s and t and c != KEYS[table]]


def _loss(table: str, view: str, lost: str, columns: list[str]) -> str:
    """All single values and pairs of values that lost rows have, without a beam."""
    cells = _union([f"SELECT rid, lost, {i} AS c, CAST({c} AS VARCHAR) AS v FROM r" for i, c in enumerate(columns)])
    name = lambda side: "[" + ", ".join(f"'{c}'" for c in columns) + f"][{side}.c + 1] || ' = ' || {side}.v"
    return f"""SELECT '{table}' AS table_name, * FROM (WITH r AS (SELECT *, row_number() OVER () AS rid, {lost} AS lost FROM {view}),
w AS (SELECT count(*) AS total, count(*) FILTER (lost) AS gone, ceil(count(*) FILTER (lost) * 0.05) AS least FROM r),
cells AS ({cells}), f AS (SELECT c, v FROM cells, w GROUP BY c, v, least HAVING count(*) FILTER (lost) >= least),
i AS (SELECT * FROM cells SEMI JOIN f USING (c, v)),
s AS (SELECT c, v, count(*) AS n, count(*) FILTER (lost) AS l, count(*) FILTER (lost) * total - count(*) * gone AS x FROM i, w GROUP BY c, v, total, gone),
p AS (SELECT a.c AS c1, a.v AS v1, b.c AS c2, b.v AS v2, count(*) AS n, count(*) FILTER (a.lost) AS l,
        count(*) FILTER (a.lost) * total - count(*) * gone AS x FROM i a JOIN i b ON a.rid = b.rid AND a.c < b.c, w GROUP BY a.c, a.v, b.c, b.v, total, gone, least
      HAVING count(*) FILTER (a.lost) >= least),
u AS (SELECT {name('s')} AS conditions, 1 AS size, c AS c1, v AS v1, -1 AS c2, '' AS v2, n, l, x FROM s WHERE x > 0
  UNION ALL SELECT {name('a')} || ' AND ' || {name('b')}, 2, c1, v1, c2, v2, p.n, p.l, p.x FROM p JOIN s a ON a.c = c1 AND a.v = v1 JOIN s b ON b.c = c2 AND b.v = v2
  WHERE p.x > 0 AND (a.x > 0 OR b.x > 0) AND p.x > greatest(a.x, b.x))
SELECT CAST(row_number() OVER (ORDER BY x DESC, size, c1, v1, c2, v2) AS INTEGER) AS rank, conditions, size AS condition_count, n AS row_count, l AS lost_rows,
  round(100 * l / n, 2) AS loss_pct, round(100 * l / gone, 2) AS lost_share_pct, round(l * total / (n * gone), 4) AS lift
FROM u, w QUALIFY rank <= 10)"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


_VIEWS = {
    "src_vendor": """
SELECT s_suppkey AS vendor_id, s_name AS vendor_name,
  CASE s_suppkey % 4 WHEN 0 THEN 'PLATINUM' WHEN 1 THEN 'GOLD' WHEN 2 THEN 'SILVER' ELSE 'BRONZE' END AS vendor_tier,
  CASE WHEN s_suppkey % 5 = 0 THEN 'N' ELSE 'Y' END AS active_flag,
  s_nationkey AS nation_key, CAST(s_acctbal AS DECIMAL(15,2)) AS credit_limit FROM supplier""",
    "tgt_vendor": """
SELECT vendor_id, vendor_name,
  CASE WHEN upper(active_flag) = 'Y' THEN true WHEN upper(active_flag) = 'N' THEN false END AS active_flag,
  nation_key, credit_limit FROM src_vendor""",
    "src_inventory": """
SELECT p_partkey AS item_id, p_brand AS location_id, p_size AS reorder_point,
  CAST(CAST(p_retailprice AS DECIMAL(10,4)) + CAST(0.1234 AS DECIMAL(10,4)) AS DECIMAL(10,4)) AS unit_cost,
  CAST('2024-01-10 08:00:00' AS TIMESTAMP) + p_partkey * INTERVAL '1' MINUTE AS last_counted_ts FROM part""",
    "tgt_inventory": """
SELECT item_id, location_id, reorder_point, CAST(CAST(unit_cost AS FLOAT) AS DOUBLE) AS unit_cost,
  last_counted_ts + INTERVAL '5' HOUR AS last_counted_ts FROM src_inventory""",
    "src_inventory_transaction": """
SELECT o_orderkey AS txn_id, o_custkey AS item_id, o_orderpriority AS txn_type,
  CAST(o_totalprice AS DECIMAL(15,2)) AS txn_qty, o_orderdate AS txn_ts,
  CASE WHEN o_orderstatus = 'P' THEN 'DEL' ELSE 'ACT' END AS status_code FROM orders""",
    "tgt_inventory_transaction": """
SELECT txn_id, item_id, txn_type, txn_qty, txn_ts + INTERVAL '5' HOUR AS txn_ts,
  status_code = 'DEL' AS is_deleted FROM src_inventory_transaction WHERE status_code <> 'DEL'""",
    "src_supplier_contract": """
SELECT c_custkey AS contract_id, c_nationkey AS vendor_id, CAST(c_acctbal AS DECIMAL(15,2)) AS contract_value,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS terms_notes,
  CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS auto_renew FROM customer""",
    "tgt_supplier_contract": """
SELECT contract_id, vendor_id, contract_value,
  CASE WHEN trim(terms_notes) = '' THEN NULL ELSE terms_notes END AS terms_notes,
  CASE WHEN upper(auto_renew) = 'Y' THEN true WHEN upper(auto_renew) = 'N' THEN false END AS auto_renew
FROM src_supplier_contract""",
    "src_purchase_order": """
SELECT o_orderkey AS po_number, o_custkey AS vendor_id, o_orderdate AS order_date,
  CAST(o_totalprice AS DECIMAL(15,2)) AS total_amount, o_orderstatus AS po_status FROM orders""",
    "tgt_purchase_order": "SELECT * FROM src_purchase_order",
    "full_transaction": """
SELECT txn_id, item_id, txn_type, txn_qty, txn_ts, status_code = 'DEL' AS is_deleted FROM src_inventory_transaction""",
    "cdc_events": """
SELECT event_id,
  CASE user_id % 5 WHEN 0 THEN 'vendor' WHEN 1 THEN 'inventory' WHEN 2 THEN 'inventory_transaction'
    WHEN 3 THEN 'supplier_contract' ELSE 'purchase_order' END AS table_name,
  CASE event_type WHEN 'signup' THEN 'INSERT' ELSE 'UPDATE' END AS operation, ts AS event_ts, user_id AS primary_key,
  NOT (event_type = 'error' AND user_id % 5 = 0) AS captured,
  CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN
    CASE WHEN value >= 30 THEN NULL WHEN value >= 10 THEN 'TRIGGER_DISABLED_WINDOW' ELSE 'CDC_TRIGGER_SKIP' END
  END AS gap_reason, props AS after FROM events""",
    "window_events": """
SELECT * FROM cdc_events WHERE event_ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '168' HOUR""",
    "task_logs": r"""
SELECT 'nightly_migration' AS dag_id,
  CASE user_id % 4 WHEN 0 THEN 'extract_from_source' WHEN 1 THEN 'transform_data' WHEN 2 THEN 'load_to_target'
    ELSE 'run_reconciliation' END AS task_id,
  strftime(ts, '%Y%m%d') AS run_id, lpad(CAST(event_id AS VARCHAR), 12, '0') || '.log' AS file_name, ts AS modified_at,
  '[info] task started' || chr(10) || 'Duration: ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) || ' s' || chr(10)
  || CASE WHEN event_type = 'purchase' THEN 'rows_upserted => ' || user_id || chr(10) ELSE '' END
  || CASE WHEN event_type <> 'signup' THEN 'Total rows extracted: ' || event_id || chr(10) ELSE '' END
  || CASE WHEN user_id % 2 = 0 THEN 'Partitions used 8' || chr(10) || 'shuffle write bytes = ' || (event_id * 7) || chr(10) ELSE '' END
  || CASE WHEN user_id % 4 = 0 THEN 'failed tasks 3' || chr(10) ELSE '' END
  || CASE WHEN event_type = 'error' THEN 'ERROR first attempt failed' || chr(10) || '[info] retry' || chr(10)
       || 'ERROR attempt ' || event_id || ' gave up' || chr(10) ELSE '' END
  || CASE event_type WHEN 'view' THEN 'State set to SKIPPED' WHEN 'error' THEN 'State set to FAILED'
       ELSE 'State set to SUCCESS' END || chr(10) AS log_text
FROM events""",
    "parsed_logs": r"""
SELECT dag_id, task_id, run_id, file_name,
  CASE WHEN contains(log_text, 'State set to SKIPPED') THEN 'SKIPPED'
    WHEN contains(log_text, 'State set to FAILED') OR contains(log_text, 'ERROR') THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  coalesce(CAST(trunc(TRY_CAST(nullif(regexp_extract(log_text, '(?i)duration:\s*([\d.]+)', 1), '') AS DOUBLE)) AS BIGINT), 0)
    AS duration_seconds,
  coalesce(TRY_CAST(nullif(regexp_extract(log_text, 'rows_upserted.*?(\d+)', 1), '') AS BIGINT),
    TRY_CAST(nullif(regexp_extract(log_text, 'Total rows extracted:\s*(\d+)', 1), '') AS BIGINT), 0) AS records_processed,
  CAST(0 AS BIGINT) AS records_failed,
  CASE WHEN contains(log_text, 'State set to FAILED') OR contains(log_text, 'ERROR')
    THEN list_extract(regexp_extract_all(log_text, '(?m)ERROR.*?$'), -1) END AS error_message,
  parts AS partitions,
  CASE WHEN parts IS NOT NULL THEN
    coalesce(TRY_CAST(nullif(regexp_extract(log_text, '(?i)shuffle.*?bytes.*?(\d+)', 1), '') AS BIGINT), 0) END AS shuffled_bytes,
  CASE WHEN parts IS NOT NULL THEN
    coalesce(TRY_CAST(nullif(regexp_extract(log_text, '(?i)failed tasks.*?(\d+)', 1), '') AS BIGINT), 0) END AS failed_tasks
FROM (SELECT *, TRY_CAST(nullif(regexp_extract(log_text, '(?i)partitions.*?(\d+)', 1), '') AS BIGINT) AS parts FROM task_logs)""",
}


def _pct(part: str, base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN round_even(CAST({part} AS DOUBLE) / {base} * 100, 2) ELSE CAST(0 AS DOUBLE) END"


def _table_names() -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TABLES))
    return f"SELECT * FROM (VALUES {rows}) v(table_ordinal, table_name)"


def _columns() -> str:
    """Column pairs: types of both sides and observed counts."""
    def counts(side: str, table: str, column: str, dtype: str | None) -> str:
        if dtype is None:
            return "CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)"
        return f"(SELECT count(*) FROM {side}_{table}), (SELECT count({column}) FROM {side}_{table})"

    parts = []
    for table, columns in COLUMNS.items():
        for column, source, target in columns:
            s = _quote(source) if source else "CAST(NULL AS VARCHAR)"
            t = _quote(target) if target else "CAST(NULL AS VARCHAR)"
            raw_s, raw_t = (x and x.split("(")[0] for x in (source, target))
            change = "MISSING" if not target else "EXTRA" if not source else "SAME" if raw_s == raw_t else "TYPE_MISMATCH"
            parts.append(
                f"SELECT '{table}' AS table_name, '{column}' AS column_name, {s} AS source_type, {t} AS target_type, "
                f"'{change}' AS change, {counts('src', table, column, source)}, {counts('tgt', table, column, target)}")
    header = "table_name, column_name, source_type, target_type, change, source_rows, source_non_null, target_rows, target_non_null"
    return f"SELECT * FROM ({_union(parts)}) v({header})"


def _recon(prefix_source: str = "src", prefix_target: str = "tgt", tables: tuple[str, ...] = TABLES,
           text: dict[str, str] | None = None) -> str:
    parts = []
    for table in tables:
        key = KEYS[table]
        value = (text or {}).get(table, f"CAST({key} AS VARCHAR)")
        digest = "(SELECT coalesce(md5(string_agg({v}, ',' ORDER BY {k})), '') FROM {side}_{t})"
        s, t = (digest.format(v=value, k=key, side=side, t=table) for side in (prefix_source, prefix_target))
        parts.append(
            f"SELECT '{table}' AS table_name, (SELECT count(*) FROM {prefix_source}_{table}) AS source_count, "
            f"(SELECT count(*) FROM {prefix_target}_{table}) AS target_count, {s} = {t} AS checksum_match")
    return f"""
SELECT table_name, source_count, target_count, source_count - target_count AS delta,
  {_pct('(source_count - target_count)', 'source_count')} AS delta_pct, checksum_match,
  CASE WHEN source_count = target_count AND checksum_match THEN 'MATCH' ELSE 'MISMATCH' END AS row_status
FROM ({_union(parts)})"""


def _gaps(events: str) -> str:
    return f"""
SELECT table_name, total_events, captured, missed, {_pct('missed', 'total_events')} AS gap_rate FROM (
  SELECT n.table_name, count(e.event_id) AS total_events, count(*) FILTER (e.captured) AS captured,
    count(*) FILTER (NOT e.captured) AS missed
  FROM table_names n LEFT JOIN {events} e USING (table_name) GROUP BY n.table_name)"""


def _diffs(source: str = "src", target: str = "tgt", tables: tuple[str, ...] = TABLES) -> str:
    """Every shared value pair: key, both texts, presence of the target row."""
    parts = []
    for table in tables:
        for column in _shared(table):
            parts.append(
                f"SELECT '{table}' AS table_name, CAST(s.{KEYS[table]} AS VARCHAR) AS pk, '{column}' AS column_name, "
                f"CAST(s.{column} AS VARCHAR) AS source_value, CAST(t.{column} AS VARCHAR) AS target_value, "
                f"t.{KEYS[table]} IS NULL AS no_target "
                f"FROM {source}_{table} s LEFT JOIN {target}_{table} t ON s.{KEYS[table]} = t.{KEYS[table]}")
    return _union(parts)


_LABEL = """
CASE WHEN source_value IS NOT NULL AND target_value IS NULL
    THEN CASE WHEN source_value = '' THEN 'NULL_EMPTY' ELSE 'MISSING_VALUE' END
  WHEN source_value IN ('Y', 'N') AND target_value IN ('true', 'false', 't', 'f') THEN 'TYPE_COERCION_BOOL'
  WHEN abs(TRY_CAST(source_value AS DOUBLE) - TRY_CAST(target_value AS DOUBLE)) < 0.01 THEN 'FLOAT_ROUNDING'
  WHEN contains(column_name, 'ts') OR contains(lower(column_name), 'timestamp') THEN 'TZ_DRIFT'
  ELSE 'VALUE_MISMATCH' END"""


def _issues() -> str:
    return """
SELECT table_name, 'MISSING_COLUMN' AS issue_type, 'CRITICAL' AS severity, 1 AS step,
  'Column ''' || column_name || ''' (' || source_type || ') missing in target' AS detail
FROM column_pairs WHERE change = 'MISSING'
UNION ALL SELECT table_name, 'TYPE_MISMATCH', CASE WHEN column_name = 'active_flag' THEN 'CRITICAL' ELSE 'WARNING' END, 2,
  'Column ''' || column_name || ''': source=' || source_type || ' target=' || target_type
FROM column_pairs WHERE change = 'TYPE_MISMATCH'
UNION ALL SELECT table_name, 'EXTRA_COLUMN', 'WARNING', 3, 'Column ''' || column_name || ''' (' || target_type || ') only in target'
FROM column_pairs WHERE change = 'EXTRA'
UNION ALL SELECT table_name, 'ROW_COUNT_MISMATCH', CASE WHEN delta_pct > 5 THEN 'CRITICAL' ELSE 'WARNING' END, 4,
  'source=' || source_count || ' target=' || target_count || ' delta=' || delta || ' (' || delta_pct || '%)'
FROM recon WHERE row_status = 'MISMATCH'
UNION ALL SELECT table_name, 'CDC_GAP', 'CRITICAL', 5, missed || ' events missed (' || gap_rate || '% gap rate)'
FROM gaps WHERE missed > 0"""


_MISMATCH_TYPE = """CASE WHEN source_type LIKE 'character%' AND target_type = 'boolean' THEN 'TYPE_COERCION_BOOL'
  WHEN contains(source_type, 'numeric') AND (contains(target_type, 'float') OR contains(target_type, 'double')) THEN 'FLOAT_ROUNDING'
  WHEN contains(source_type, 'timestamp') AND contains(target_type, 'timestamp') AND source_type <> target_type THEN 'TZ_DRIFT'
  ELSE 'TYPE_COERCION_BOOL' END"""


def _rules() -> str:
    rows = ", ".join(
        f"({_quote(r.mismatch_type)}, {_quote(r.root_cause)}, CAST({r.confidence} AS DOUBLE), {_quote(r.priority)}, "
        f"{_quote(r.recommended_fix)})" for r in (*cfg.ROOT_CAUSE_RULES, cfg.UNKNOWN_RULE))
    return f"SELECT * FROM (VALUES {rows}) v(rule_key, root_cause, confidence, priority, recommended_fix)"


_EVIDENCE = """
SELECT n.table_ordinal, n.table_name, s.source_column_count, s.target_column_count, s.missing_columns, s.type_mismatches,
  s.extra_columns, s.schema_severity, s.flag_mismatches, r.source_count, r.target_count, r.delta, r.delta_pct,
  r.checksum_match, r.row_status, g.total_events, g.captured, g.missed, g.gap_rate
FROM table_names n JOIN schema_summary s USING (table_name) JOIN recon r USING (table_name) JOIN gaps g USING (table_name)"""

_SCHEMA_SUMMARY = """
SELECT *, CASE WHEN missing_columns > 0 OR critical_mismatches > 0 THEN 'CRITICAL'
  WHEN type_mismatches > 0 OR extra_columns > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS schema_severity
FROM (SELECT table_name, count(source_type) AS source_column_count, count(target_type) AS target_column_count,
    count(*) FILTER (change = 'MISSING') AS missing_columns, count(*) FILTER (change = 'TYPE_MISMATCH') AS type_mismatches,
    count(*) FILTER (change = 'EXTRA') AS extra_columns,
    count(*) FILTER (change = 'TYPE_MISMATCH' AND column_name IN ('active_flag', 'vendor_tier')) AS critical_mismatches,
    count(*) FILTER (change = 'TYPE_MISMATCH' AND column_name = 'active_flag') AS flag_mismatches,
    coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (change = 'MISSING'), '') AS missing_names,
    coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (change = 'TYPE_MISMATCH'), '') AS mismatch_names,
    coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (change = 'EXTRA'), '') AS extra_names,
    CAST(coalesce(sum(source_non_null) FILTER (change = 'MISSING'), 0) AS BIGINT) AS missing_values
  FROM column_pairs GROUP BY table_name)"""

_PROBLEMS = f"""
SELECT table_ordinal, table_name, 1 AS step, '' AS column_name, 'MISSING_COLUMN' AS rule_key, source_count AS explicit_rows
FROM evidence WHERE missing_columns > 0
UNION ALL SELECT table_ordinal, e.table_name, 2, column_name, {_MISMATCH_TYPE}, source_count
FROM evidence e JOIN column_pairs c USING (table_name) WHERE change = 'TYPE_MISMATCH'
UNION ALL SELECT table_ordinal, table_name, 3, '', 'CDC_TRIGGER_SKIP', missed FROM evidence WHERE missed > 0
UNION ALL SELECT table_ordinal, table_name, 4, '', 'SOFT_DELETE', delta FROM evidence WHERE delta > 0
UNION ALL SELECT table_ordinal, table_name, 5, '', 'NULL_EMPTY', source_count FROM evidence
WHERE row_status = 'MISMATCH' AND delta = 0 AND missing_columns = 0 AND type_mismatches = 0 AND missed = 0"""

_ALL_PROBLEMS = """
SELECT * FROM problems UNION ALL
SELECT table_ordinal, table_name, 6, '', 'HEALTHY', 0 FROM evidence WHERE table_name NOT IN (SELECT table_name FROM problems)"""


def _affected(explicit: str, sample: str) -> str:
    return f"""CAST(CASE WHEN root_cause = 'HEALTHY' THEN 0 WHEN {explicit} > 0 THEN {explicit}
  WHEN root_cause IN ('CDC_SCHEMA_DRIFT', 'CDC_TRIGGER_GAP') THEN CASE WHEN missed > 0 THEN missed ELSE source_count END
  WHEN root_cause IN ('TYPE_COERCION', 'TZ_MISMATCH', 'NULL_EMPTY_MISMATCH') THEN coalesce(nullif({sample}, 0), source_count)
  WHEN root_cause = 'SOFT_DELETE_MISMATCH' THEN abs(delta) ELSE 0 END AS BIGINT)"""


_FINDINGS = f"""
SELECT p.table_ordinal, p.table_name, p.step, p.column_name, p.rule_key, r.root_cause, r.confidence, r.priority,
  r.recommended_fix, {_affected('explicit_rows', 'NULL')} AS affected_rows
FROM all_problems p JOIN rules r USING (rule_key) JOIN evidence e USING (table_name)"""

_INFERRED = f"""
SELECT k.table_name, k.rule_key, r.root_cause, r.confidence, r.priority, {_affected('0', 'NULL')} AS affected_rows
FROM (SELECT *, CASE WHEN missing_columns > 0 THEN 'MISSING_COLUMN' WHEN flag_mismatches > 0 THEN 'TYPE_COERCION_BOOL'
    WHEN gap_rate > 0 THEN 'CDC_TRIGGER_SKIP' WHEN delta > 0 THEN 'SOFT_DELETE'
    WHEN schema_severity IN ('CRITICAL', 'WARNING') THEN 'MISSING_COLUMN' WHEN row_status = 'MISMATCH' THEN 'SOFT_DELETE'
    WHEN type_mismatches = 0 AND gap_rate = 0 AND delta = 0 AND missed = 0 THEN 'HEALTHY' ELSE 'UNKNOWN' END AS rule_key
  FROM evidence) k JOIN rules r USING (rule_key)"""

_TABLE_HEALTH = """
SELECT e.table_name, e.table_ordinal, count(i.issue_type) AS issues_found,
  count(*) FILTER (i.severity = 'CRITICAL') AS critical_count, count(*) FILTER (i.severity = 'WARNING') AS warning_count,
  CASE WHEN count(*) FILTER (i.severity = 'CRITICAL') > 0 THEN 'CRITICAL'
    WHEN count(i.issue_type) > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS status,
  15 * count(*) FILTER (i.severity = 'CRITICAL') + 5 * count(*) FILTER (i.severity = 'WARNING')
    + CASE WHEN abs(any_value(e.delta_pct)) > 1 THEN 10 ELSE 0 END + CASE WHEN any_value(e.gap_rate) > 2 THEN 10 ELSE 0 END
    AS deduction
FROM evidence e LEFT JOIN issues i USING (table_name) GROUP BY e.table_name, e.table_ordinal"""

_SCORE = """
SELECT CAST(sum(issues_found) AS BIGINT) AS issues_found, CAST(sum(critical_count) AS BIGINT) AS critical_count,
  CAST(sum(warning_count) AS BIGINT) AS warning_count, CAST(greatest(0, 100 - sum(deduction)) AS INTEGER) AS health_score
FROM table_health"""

_FINDING_SCORE = """
SELECT CAST(greatest(0, 100 - 15 * p1 - 5 * p2 - penalty) AS INTEGER) AS health_score, p1 AS critical_count,
  p2 AS warning_count, found AS root_causes_found
FROM (SELECT count(*) FILTER (priority = 'P1' AND root_cause <> 'HEALTHY') AS p1,
    count(*) FILTER (priority = 'P2' AND root_cause <> 'HEALTHY') AS p2,
    count(*) FILTER (root_cause <> 'HEALTHY') AS found,
    (SELECT sum(CASE WHEN abs(delta_pct) > 1 THEN 10 ELSE 0 END + CASE WHEN gap_rate > 2 THEN 10 ELSE 0 END) FROM evidence)
      AS penalty
  FROM findings)"""

_PATTERNS = """
SELECT table_name, coalesce(gap_reason, 'UNKNOWN') AS reason, count(*) AS event_count
FROM {events} WHERE NOT captured GROUP BY 1, 2"""

_HISTORY = """
SELECT strftime(as_of, '%Y%m%d') AS run_id, 'nightly_migration' AS migration, 'recon_complete' AS status,
  as_of AS started_at,
  CAST(greatest(0, 100 - 15 * count(*) FILTER (missed > 0) - 10 * count(*) FILTER (100.0 * missed / total > 2)) AS INTEGER)
    AS health_score,
  count(*) FILTER (missed > 0) AS issues_found
FROM (SELECT r.as_of, e.table_name, count(*) AS total, count(*) FILTER (NOT e.captured) AS missed
  FROM (SELECT DISTINCT date_trunc('day', event_ts) + INTERVAL '1' DAY AS as_of FROM cdc_events) r
  JOIN cdc_events e ON e.event_ts < r.as_of AND e.event_ts >= r.as_of - INTERVAL '7' DAY
  GROUP BY r.as_of, e.table_name)
GROUP BY as_of"""


def _fingerprints(text: dict[str, str]) -> str:
    return _union([
        f"SELECT '{table}' AS table_name, '{side}' AS side, count(*) AS row_count, "
        f"CAST(coalesce(sum(CAST(('0x' || substr(md5({text[table]}), 1, 15)) AS BIGINT)), 0) AS VARCHAR) AS fingerprint "
        f"FROM {prefix}_{table}"
        for table in TABLES for side, prefix in (("source", "src"), ("target", "tgt"))])


def _row_text(columns: list[str]) -> str:
    cells = ", ".join(f"coalesce('v' || CAST({c} AS VARCHAR), 'n')" for c in columns)
    return f"concat_ws(chr(31), {cells})"


def _buckets(table: str, column: str | None) -> str:
    key = KEYS[table]
    content = f"CAST({key} AS VARCHAR)" + (f" || chr(31) || {_row_text([column])}" if column else "")

    def side(prefix: str) -> str:
        return (f"SELECT CAST(('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 15)) AS BIGINT) % 64 AS bucket, "
                f"count(*) AS n, string_agg({content}, ',' ORDER BY {key}) AS content FROM {prefix}_{table} GROUP BY 1")

    return f"""SELECT bucket, coalesce(s.n, 0) AS source_count, coalesce(t.n, 0) AS target_count, '{table}' AS table_name
FROM ({side('src')}) s FULL JOIN ({side('tgt')}) t USING (bucket) WHERE s.content IS DISTINCT FROM t.content"""


def _row_status(source: str, target: str, table: str, direction: str) -> str:
    key = KEYS[table]
    changed = " OR ".join(
        f"CAST(s.{c} AS VARCHAR) IS DISTINCT FROM CAST(t.{c} AS VARCHAR)" for c in _shared(table))
    return f"""SELECT '{table}' AS table_name, row_status, count(*) AS row_count, '{direction}' AS direction FROM (
  SELECT CASE WHEN t.{key} IS NULL THEN 'SOURCE_ONLY' WHEN s.{key} IS NULL THEN 'TARGET_ONLY'
    WHEN {changed} THEN 'CHANGED' ELSE 'MATCH' END AS row_status
  FROM {source}_{table} s FULL JOIN {target}_{table} t ON s.{key} = t.{key}) GROUP BY row_status"""


_SAMPLED = (("vendor", "active_flag"), ("inventory", "unit_cost"), ("inventory", "last_counted_ts"),
            ("inventory_transaction", "txn_ts"), ("supplier_contract", "terms_notes"), ("purchase_order", "total_amount"))


def _samples(window: int | None) -> str:
    def side(prefix: str, table: str) -> str:
        cut = f" ORDER BY {KEYS[table]} LIMIT {window}" if window else ""
        return f"(SELECT * FROM {prefix}_{table}{cut})"

    parts = []
    for table, column in _SAMPLED:
        key = KEYS[table]
        parts.append(f"""SELECT * FROM (SELECT table_name, pk, column_name, source_value, target_value, {_LABEL} AS diff_type
FROM (SELECT '{table}' AS table_name, CAST(s.{key} AS VARCHAR) AS pk, '{column}' AS column_name,
    CAST(s.{column} AS VARCHAR) AS source_value, CAST(t.{column} AS VARCHAR) AS target_value
  FROM {side('src', table)} s LEFT JOIN {side('tgt', table)} t ON s.{key} = t.{key})
WHERE source_value IS DISTINCT FROM target_value ORDER BY pk LIMIT 10)""")
    return _union(parts)


def _offsets(table: str, column: str) -> str:
    key = KEYS[table]
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, offset_seconds, n AS row_count,
  round_even(CAST(n AS DOUBLE) / sum(n) OVER (), 4) AS share
FROM (SELECT date_diff('second', s.{column}, t.{column}) AS offset_seconds, count(*) AS n
  FROM src_{table} s JOIN tgt_{table} t ON s.{key} = t.{key} GROUP BY 1)"""


def _first_drift(all_columns: bool) -> str:
    """Extent and prevailing kind of the first drifted column per table, in sampling order."""
    parts = []
    for table in TABLES:
        mismatched = sorted(c for c, s, t in COLUMNS[table] if s and t and s.split("(")[0] != t.split("(")[0])
        missing = sorted(c for c, s, t in COLUMNS[table] if not t)
        rest = sorted(set(_shared(table)) - set(mismatched)) if all_columns else []
        for step, column in enumerate(mismatched + missing + rest):
            if column in missing:
                parts.append(f"SELECT '{table}' AS table_name, {step} AS step, 'MISSING_COLUMN' AS diff_type, "
                             f"count({column}) AS n FROM src_{table}")
            else:
                parts.append(f"SELECT '{table}' AS table_name, {step} AS step, diff_type, count(*) AS n FROM diffs WHERE table_name = "
                             f"'{table}' AND column_name = '{column}' AND (no_target OR source_value IS DISTINCT FROM target_value) "
                             "GROUP BY diff_type")
    return f"""SELECT table_name, arg_min(n, step) AS sample_affected, arg_min(diff_type, step) AS diff_type FROM (
  SELECT table_name, step, sum(n) AS n, arg_max(diff_type, n) AS diff_type FROM ({_union(parts)}) GROUP BY table_name, step)
WHERE n > 0 GROUP BY table_name"""


def _latest(run: str | None) -> str:
    label = run or "any"
    if run is None:
        order = "modified_at DESC"
    else:
        order = (f"(run_id = '{run}') DESC, CASE WHEN run_id = '{run}' THEN file_name END DESC NULLS LAST, "
                 "modified_at DESC")
    return (f"SELECT task_id, run_id, file_name, '{label}' AS wanted_run FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY dag_id, task_id ORDER BY {order}, run_id DESC, file_name DESC) AS rn FROM task_logs) WHERE rn = 1")


def _null_counts(table: str, source: str, columns: list[str]) -> str:
    return _union([f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, '{table}' AS table_name FROM {source}"
                   for c in columns])


def _band(scheme: str) -> str:
    bands = {
        "report": "CASE WHEN s < 20 THEN 'CRITICAL' WHEN s < 60 THEN 'AT RISK' ELSE 'HEALTHY' END",
        "dashboard": "CASE WHEN s <= 19 THEN 'CRITICAL' WHEN s <= 39 THEN 'SEVERE' WHEN s <= 69 THEN 'DEGRADED' ELSE 'HEALTHY' END",
        "modal": "CASE WHEN s >= 70 THEN 'HEALTHY' WHEN s >= 40 THEN 'WARNING' ELSE 'CRITICAL' END",
    }
    return bands[scheme]


_GAP_WINDOWS = f"""
SELECT *, {_pct('missed', 'total_events')} AS gap_rate FROM (
  SELECT table_name, date_trunc('hour', event_ts) AS window_start, date_trunc('hour', event_ts) + INTERVAL '1' HOUR AS window_end,
    count(*) AS total_events, count(*) FILTER (captured) AS captured, count(*) FILTER (NOT captured) AS missed
  FROM cdc_events GROUP BY 1, 2, 3)"""


def _ctes() -> dict[str, str]:
    full_text = {t: _row_text([KEYS[t], *_shared(t)]) for t in TABLES}
    return {
        **_VIEWS,
        "table_names": _table_names(),
        "column_pairs": _columns(),
        "recon": _recon(),
        "content_recon": _recon(text=full_text),
        "gaps": _gaps("window_events"),
        "diffs": f"SELECT *, {_LABEL} AS diff_type FROM ({_diffs()})",
        "issues": _issues(),
        "schema_summary": _SCHEMA_SUMMARY,
        "rules": _rules(),
        "evidence": _EVIDENCE,
        "problems": _PROBLEMS,
        "all_problems": _ALL_PROBLEMS,
        "findings": _FINDINGS,
        "inferred": _INFERRED,
        "table_health": _TABLE_HEALTH,
        "score": _SCORE,
        "finding_score": _FINDING_SCORE,
        "gap_history": _HISTORY,
        "sampled": _first_drift(False),
        "sampled_all": _first_drift(True),
    }


def _run_at(ctes: dict[str, str], day: str, backfilled: bool) -> str:
    """The record of a run on that day, over its own versions of the log and of the transactions."""
    mine = ctes | {"window_events": f"""SELECT * FROM cdc_events WHERE event_ts < TIMESTAMP '{day} 00:00:00'
  AND event_ts >= TIMESTAMP '{day} 00:00:00' - INTERVAL '168' HOUR"""}
    if backfilled:
        mine["tgt_inventory_transaction"] = ctes["full_transaction"]
    body = f"""SELECT '{day.replace("-", "")}' AS run_id, 'nightly_migration' AS migration, 'recon_complete' AS status,
  TIMESTAMP '{day} 00:00:00' AS started_at, health_score, issues_found FROM score"""
    return f"SELECT * FROM (WITH {_prelude(body, mine)} {body})"


def _prelude(body: str, ctes: dict[str, str]) -> str:
    return ",\n".join(f"{name} AS ({ctes[name]})" for name in _used(body, ctes))


def _statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    src_counts = {t: f"(SELECT count(*) FROM src_{t})" for t in TABLES}
    tgt_counts = {t: f"(SELECT count(*) FROM tgt_{t})" for t in TABLES}
    table_counts = _union([f"SELECT '{t}' AS table_name, {src_counts[t]} AS rows_extracted" for t in TABLES])

    # sources, sinks and loads
    sql["stage_extract"] = table_counts
    sql["stage_roundtrip"] = "SELECT * FROM src_purchase_order"
    sql["load_overwrite"] = "SELECT * FROM tgt_inventory"
    sql["load_upsert"] = """SELECT * FROM tgt_inventory_transaction
UNION ALL SELECT * FROM full_transaction WHERE txn_id NOT IN (SELECT txn_id FROM tgt_inventory_transaction)"""
    sql["load_upsert_written"] = """SELECT count(*) AS rows_read, count(*) FILTER (is_deleted) AS deleted_rows,
  count(*) AS rows_staged, count(*) AS rows_upserted, count(*) AS target_total FROM full_transaction"""
    sql["load_upsert_metrics"] = """SELECT 'backfill' AS load, f AS rows_staged, f - t AS rows_inserted, t AS rows_updated,
  f AS target_total FROM (SELECT (SELECT count(*) FROM full_transaction) AS f, (SELECT count(*) FROM tgt_inventory_transaction) AS t)
UNION ALL SELECT 'refresh', (SELECT count(*) FROM tgt_inventory_transaction), 0,
  (SELECT count(*) FROM tgt_inventory_transaction), (SELECT count(*) FROM full_transaction)"""
    duplicates = """SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
    sql["upsert_conflict_keys"] = duplicates
    sql["load_upsert_by_partition"] = """SELECT * REPLACE (CAST(CASE WHEN txn_id % 2000 = 4 THEN txn_qty + 1 ELSE txn_qty END AS DECIMAL(15,2)) AS txn_qty)
FROM full_transaction"""
    sql["load_upsert_by_partition_counts"] = """SELECT count(*) AS target_total, count(*) FILTER (txn_id % 2000 IN (3, 4)) AS rows_staged,
  count(*) FILTER (txn_id % 2000 = 3) AS rows_inserted, count(*) FILTER (txn_id % 2000 = 4) AS rows_updated FROM full_transaction"""
    sql["cdc_events_scan"] = """SELECT CAST(event_id AS VARCHAR) AS event_id, table_name, operation, event_ts,
  CAST(primary_key AS VARCHAR) AS primary_key, after, captured, gap_reason FROM cdc_events"""
    sql["cdc_summary_override"] = f"""SELECT * FROM gaps WHERE table_name <> 'vendor'
UNION ALL SELECT * FROM ({_gaps('cdc_events')}) WHERE table_name = 'vendor'"""
    sql["task_log_scan"] = "SELECT * EXCLUDE (file_name) FROM parsed_logs"
    sql["cdc_corrupt_events"] = """SELECT table_name, count(*) FILTER (event_id % 100 <> 0) AS whole_events,
  count(*) FILTER (event_id % 100 = 0) AS corrupt_lines FROM cdc_events GROUP BY table_name"""
    sql["run_record"] = """SELECT '20240131' AS run_id, 'nightly_migration' AS migration, 'recon_complete' AS status,
  TIMESTAMP '2024-01-31 00:00:00' AS started_at, health_score, issues_found FROM score"""
    sql["report_json"] = """SELECT '20240131' AS run_id, (SELECT health_score FROM score) AS health_score,
  (SELECT string_agg(f.root_cause, '; ' ORDER BY f.root_cause) FROM findings f WHERE f.table_name = e.table_name) AS causes, e.table_name, e.source_count, e.missed, e.schema_severity, count(i.issue_type) AS issue_count,
  coalesce(string_agg(i.detail, '; ' ORDER BY i.step), '') AS details
FROM evidence e LEFT JOIN issues i USING (table_name) GROUP BY ALL"""
    sql["run_history"] = "SELECT * FROM history"
    sql["cdc_gap_history"] = "SELECT * FROM gap_history"
    sql["score_trend"] = """SELECT migration, run_id, started_at, health_score,
  health_score - lag(health_score) OVER (ORDER BY started_at) AS score_change FROM history"""

    # projections, filters and scalar functions
    sql["project_to_target"] = "SELECT * FROM full_transaction"
    sql["filter_soft_deleted"] = "SELECT * FROM src_inventory_transaction WHERE status_code <> 'DEL'"
    sql["cdc_window_filter"] = """SELECT event_id, table_name, CASE WHEN gap_reason IS NULL THEN event_ts END AS event_ts
FROM cdc_events WHERE gap_reason IS NOT NULL OR event_ts >= TIMESTAMP '2024-01-24 00:00:00'"""
    sql["count_non_null"] = _union([
        f"SELECT count(contract_id) AS contract_id, count(terms_notes) AS terms_notes, count(auto_renew) AS auto_renew, "
        f"'{side}' AS side FROM {prefix}_supplier_contract" for side, prefix in (("source", "src"), ("target", "tgt"))])
    sql["char_to_boolean"] = """SELECT s_suppkey, flag,
  CASE upper(flag) WHEN 'Y' THEN true WHEN 'N' THEN false END AS as_boolean
FROM (SELECT s_suppkey, CASE WHEN s_nationkey % 7 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 'N' WHEN s_suppkey % 5 = 1 THEN 'y'
  WHEN s_suppkey % 5 = 2 THEN 'Y' WHEN s_suppkey % 5 = 3 THEN 'n' ELSE 'X' END AS flag FROM supplier)"""
    sql["decimal_to_float"] = """SELECT item_id, unit_cost, CAST(CAST(unit_cost AS FLOAT) AS DOUBLE) AS as_float
FROM src_inventory"""
    sql["shift_timestamp"] = """SELECT o_orderkey, o_orderdate + INTERVAL '5' HOUR AS plus_5h,
  o_orderdate - INTERVAL '3' HOUR AS minus_3h FROM orders"""
    sql["empty_to_null"] = """SELECT c_custkey, CASE WHEN trim(note) = '' THEN NULL ELSE note END AS note
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN chr(9)
  ELSE '  ' || c_mktsegment || ' ' END AS note FROM customer)"""
    sql["status_to_is_deleted"] = """SELECT o_orderkey, o_orderstatus, coalesce(status_code = 'DEL', false) AS is_deleted
FROM (SELECT *, CASE o_orderstatus WHEN 'P' THEN 'DEL' WHEN 'O' THEN 'ACT' END AS status_code FROM orders)"""
    sql["value_diff_text"] = _union([
        f"SELECT CAST({KEYS[t]} AS VARCHAR) AS pk, '{c}' AS column_name, CAST({c} AS VARCHAR) AS text FROM tgt_{t}"
        for t, columns in (("inventory", ("unit_cost", "last_counted_ts")), ("vendor", ("active_flag", "credit_limit")),
                           ("inventory_transaction", ("txn_qty", "txn_ts", "is_deleted"))) for c in columns])
    sql["classify_diff"] = """SELECT table_name, pk, column_name, source_value, target_value, diff_type FROM diffs
WHERE source_value IS DISTINCT FROM target_value"""

    # transforms
    for table in TABLES:
        sql[f"transform_{table}"] = f"SELECT * FROM tgt_{table}"
    widths = {t: (sum(1 for c in COLUMNS[t] if c[1]), sum(1 for c in COLUMNS[t] if c[2])) for t in TABLES}
    sql["transform_metrics"] = _union([
        f"SELECT '{t}' AS table_name, s AS input_rows, t AS output_rows, s - t AS rows_filtered, "
        f"CAST({widths[t][0]} AS INTEGER) AS columns_in, CAST({widths[t][1]} AS INTEGER) AS columns_out "
        f"FROM (SELECT {src_counts[t]} AS s, {tgt_counts[t]} AS t)" for t in TABLES])
    totals = {**tgt_counts, "inventory_transaction": src_counts["inventory_transaction"]}
    methods = {t: "upsert" if t in ("vendor", "inventory_transaction") else "overwrite" for t in TABLES}
    sql["etl_summary"] = _union([
        f"SELECT '{t}' AS table_name, 'SUCCESS' AS status, {src_counts[t]} AS rows_extracted, {tgt_counts[t]} AS rows_transformed, "
        f"{tgt_counts[t]} AS rows_loaded, {totals[t]} AS target_total, '{methods[t]}' AS method, CAST(NULL AS VARCHAR) AS error"
        for t in TABLES])
    sql["etl_totals"] = (
        f"SELECT {' + '.join(src_counts.values())} AS rows_extracted, {' + '.join(tgt_counts.values())} AS rows_loaded, "
        "CAST(0 AS BIGINT) AS failed_tables, CAST(0 AS BIGINT) AS replaced_tables")

    # schema comparison
    sql["schema_departures"] = """SELECT * FROM (VALUES ('start_date', 'MISSING', 'date', NULL, CAST(NULL AS BIGINT)), ('auto_renew', 'OTHER_TYPE', 'string', 'boolean', NULL),
  ('vendor_id', 'UNDECLARED', NULL, 'int', NULL)) v(column_name, problem, declared_type, actual_type, row_count)
UNION ALL SELECT * FROM (SELECT 'terms_notes', 'NULLS', 'string', 'string', count(*) AS n FROM tgt_supplier_contract WHERE terms_notes IS NULL) WHERE n > 0"""
    ordinals = []
    for table in TABLES:
        for index, side, prefix in ((1, "source", "src"), (2, "target", "tgt")):
            present = [c for c in COLUMNS[table] if c[index]]
            for i, c in enumerate(present, start=1):
                ordinals.append(
                    f"SELECT '{table}' AS table_name, '{side}' AS side, CAST({i} AS INTEGER) AS ordinal, '{c[0]}' AS column_name, "
                    f"'{c[index]}' AS data_type, '{c[index].split('(')[0]}' AS raw_type, "
                    f"(SELECT count(*) FROM {prefix}_{table}) AS row_count, (SELECT count({c[0]}) FROM {prefix}_{table}) AS non_null_count")
    sql["column_catalog"] = f"SELECT *, non_null_count < row_count AS nullable FROM ({_union(ordinals)})"
    sql["schema_missing_columns"] = """SELECT table_name, column_name, source_type AS data_type, source_rows AS row_count,
  source_non_null AS non_null_count FROM column_pairs WHERE change = 'MISSING'"""
    sql["schema_extra_columns"] = """SELECT table_name, column_name, target_type AS data_type, target_rows AS row_count,
  target_non_null AS non_null_count FROM column_pairs WHERE change = 'EXTRA'"""
    sql["schema_type_mismatches"] = """SELECT table_name, column_name, source_type, target_type,
  source_non_null AS source_non_null_count, target_non_null AS target_non_null_count
FROM column_pairs WHERE change = 'TYPE_MISMATCH'"""
    sql["mismatch_type_of"] = f"""SELECT table_name, column_name, {_MISMATCH_TYPE} AS mismatch_type, source_rows AS affected_rows
FROM column_pairs WHERE change = 'TYPE_MISMATCH'"""
    sql["schema_common_columns"] = """SELECT table_name, column_name, source_non_null AS source_non_null_count,
  target_non_null AS target_non_null_count FROM column_pairs WHERE change IN ('SAME', 'TYPE_MISMATCH')"""
    sql["schema_nullability_changes"] = """SELECT * FROM (SELECT table_name, column_name,
  source_non_null < source_rows AS source_nullable, target_non_null < target_rows AS target_nullable
FROM column_pairs WHERE change IN ('SAME', 'TYPE_MISMATCH')) WHERE source_nullable <> target_nullable"""
    sql["columns_to_sample"] = """SELECT table_name, column_name,
  CAST(CASE change WHEN 'TYPE_MISMATCH' THEN 1 ELSE 2 END AS INTEGER) AS step, source_non_null AS source_non_null_count
FROM column_pairs WHERE change IN ('TYPE_MISMATCH', 'MISSING')"""
    sql["schema_diff"] = """SELECT table_name, source_column_count, target_column_count, missing_names AS missing_columns,
  mismatch_names AS type_mismatches, extra_names AS extra_columns, missing_values, schema_severity FROM schema_summary"""

    # value comparison
    sql["sample_diff_missing_column"] = """SELECT 'vendor' AS table_name, CAST(vendor_id AS VARCHAR) AS pk,
  'vendor_tier' AS column_name, vendor_tier AS source_value, CAST(NULL AS VARCHAR) AS target_value,
  'MISSING_COLUMN' AS diff_type FROM src_vendor ORDER BY vendor_id LIMIT 10"""
    sql["sample_diff_extra_column"] = """SELECT 'inventory_transaction' AS table_name, CAST(txn_id AS VARCHAR) AS pk,
  'is_deleted' AS column_name, CAST(NULL AS VARCHAR) AS source_value, CAST(is_deleted AS VARCHAR) AS target_value,
  'EXTRA_COLUMN' AS diff_type FROM tgt_inventory_transaction ORDER BY txn_id LIMIT 10"""
    sql["sample_diff_values"] = _samples(None)
    sampled = " OR ".join(f"(table_name = '{t}' AND column_name = '{c}')" for t, c in _SAMPLED)
    sql["sample_diff_totals"] = f"""SELECT table_name, column_name, CAST(sum(n) AS BIGINT) AS affected_rows, arg_max(diff_type, n) AS diff_type
FROM (SELECT table_name, column_name, diff_type, count(*) AS n FROM diffs
  WHERE ({sampled}) AND (no_target OR source_value IS DISTINCT FROM target_value) GROUP BY ALL) GROUP BY table_name, column_name
UNION ALL SELECT 'vendor', 'vendor_tier', count(vendor_tier), 'MISSING_COLUMN' FROM src_vendor
UNION ALL SELECT 'inventory_transaction', 'is_deleted', count(is_deleted), 'EXTRA_COLUMN' FROM tgt_inventory_transaction"""
    sql["sample_diff_window"] = _samples(50)
    sql["count_affected"] = """SELECT table_name, column_name,
  count(*) FILTER (no_target OR source_value IS DISTINCT FROM target_value) AS affected_rows
FROM diffs GROUP BY table_name, column_name"""
    sql["diff_type_summary"] = """SELECT table_name, column_name, diff_type, count(*) AS row_count FROM diffs
WHERE source_value IS DISTINCT FROM target_value GROUP BY ALL"""
    sql["diff_type_summary_narrowed"] = sql["diff_type_summary"]
    sql["row_status_counts"] = _union(
        [_row_status("src", "tgt", t, "forward") for t in TABLES]
        + [_row_status("tgt", "src", "inventory_transaction", "swapped")])
    sql["row_status_duplicates"] = """WITH s AS (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS q FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
t AS (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 5 <> 0 GROUP BY 1)
SELECT CASE WHEN s.n > 1 OR t.n > 1 THEN 'DUPLICATE_KEY' WHEN t.n IS NULL THEN 'SOURCE_ONLY' WHEN s.n IS NULL THEN 'TARGET_ONLY'
  WHEN s.q IS DISTINCT FROM t.q THEN 'CHANGED' ELSE 'MATCH' END AS row_status, count(*) AS key_count,
  CAST(sum(coalesce(s.n, 0)) AS BIGINT) AS source_rows, CAST(sum(coalesce(t.n, 0)) AS BIGINT) AS target_rows
FROM s FULL JOIN t USING (l_orderkey) GROUP BY 1"""
    lost = "SELECT * FROM src_inventory_transaction WHERE txn_id NOT IN (SELECT txn_id FROM tgt_inventory_transaction)"
    sql["paired_line_items"] = """SELECT l_orderkey, CASE WHEN lost THEN 'SOURCE_ONLY' WHEN changed THEN 'CHANGED' ELSE 'MATCH' END AS row_status,
  count(*) AS row_count, l_linenumber, l_partkey, l_quantity AS source_quantity, CASE WHEN lost THEN NULL WHEN changed THEN l_quantity + 1 ELSE l_quantity END AS target_quantity,
  CASE WHEN changed AND NOT lost THEN 'l_quantity' END AS changed_columns
FROM (SELECT *, l_linenumber = 2 AND l_orderkey % 7 = 0 AS lost, l_linenumber = 1 AND l_orderkey % 5 = 0 AS changed,
        row_number() OVER () AS n, count(*) OVER (PARTITION BY l_orderkey) AS items FROM lineitem) WHERE items > 1
GROUP BY l_orderkey, lost, changed, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CASE WHEN lost OR changed THEN n END"""
    renamed = {"vendor_name": "supplier", "credit_limit": "credit", "active_flag": "is_active"}
    changed = """(SELECT *, vendor_name AS supplier, credit_limit AS credit, active_flag AS is_active FROM (
  SELECT * REPLACE (CASE WHEN vendor_id % 4 = 1 THEN upper(vendor_name) ELSE vendor_name END AS vendor_name) FROM src_vendor))"""
    sql["renamed_columns"] = _union([
        *[f"""SELECT 'vendor' AS table_name, 'RENAMED' AS change, '{a}' AS source_column, '{b}' AS target_column,
  round((SELECT count(*) FROM (SELECT {a} FROM src_vendor INTERSECT SELECT {b} FROM {changed})) / CAST((SELECT count(*) FROM (
    SELECT {a} FROM src_vendor UNION SELECT {b} FROM {changed})) AS DOUBLE), 4) AS value_overlap,
  (SELECT round(avg(CASE WHEN s.{a} IS NOT DISTINCT FROM t.{b} THEN 1.0 ELSE 0.0 END), 4) FROM src_vendor s JOIN {changed} t USING (vendor_id)) AS key_agreement"""
          for a, b in renamed.items()],
        *[f"SELECT '{t}', '{kind}', {a}, {b}, NULL, NULL" for t, kind, a, b in (
            ("vendor", "MISSING", "'vendor_tier'", "NULL"), ("vendor", "EXTRA", "NULL", "'checked'"), ("vendor", "EXTRA", "NULL", "'load_batch'"),
            ("inventory_transaction", "MISSING", "'status_code'", "NULL"), ("inventory_transaction", "EXTRA", "NULL", "'is_deleted'"))]])
    sql["loss_patterns"] = _union([
        _loss("inventory_transaction", "src_inventory_transaction", "status_code = 'DEL'", ["item_id", "txn_type", "txn_qty", "txn_ts", "status_code"]),
        _loss("orders", "orders", "(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR o_orderkey % 97 = 0",
              ["o_custkey", "o_orderstatus", "o_orderpriority"])])
    sql["missing_keys"] = lost
    both = """SELECT * FROM (WITH s AS (SELECT * FROM src_purchase_order), t AS (
  SELECT po_number, vendor_id, order_date, CAST(CASE WHEN po_number % 1009 = 1 THEN total_amount + 1 ELSE total_amount END AS DECIMAL(15,2)) AS total_amount,
    po_status FROM s WHERE po_number % 997 <> 0
  UNION ALL SELECT -po_number, vendor_id, order_date, total_amount, po_status FROM s WHERE po_number % 1013 = 5
  UNION ALL SELECT * FROM s WHERE po_number % 1019 = 7)"""
    sql["differing_keys"] = both + """, a AS (SELECT * FROM s EXCEPT ALL SELECT * FROM t), b AS (SELECT * FROM t EXCEPT ALL SELECT * FROM s),
k AS (SELECT po_number AS key, sum(x) AS x, sum(y) AS y FROM (
  SELECT po_number, 1 AS x, 0 AS y FROM a UNION ALL SELECT po_number, 0, 1 FROM b) GROUP BY 1),
n AS (SELECT key, x, y, (SELECT count(*) FROM s WHERE po_number = key) AS source_rows, (SELECT count(*) FROM t WHERE po_number = key) AS target_rows FROM k)
SELECT 'purchase_order' AS table_name, key, CASE WHEN target_rows = 0 THEN 'SOURCE_ONLY' WHEN source_rows = 0 THEN 'TARGET_ONLY' ELSE 'CHANGED' END AS row_status,
  source_rows, target_rows, CAST(x AS BIGINT) AS source_surplus, CAST(y AS BIGINT) AS target_surplus FROM n
UNION ALL SELECT 'inventory_transaction', txn_id, 'SOURCE_ONLY', 1, 0, 1, 0 FROM src_inventory_transaction WHERE status_code = 'DEL')"""
    sql["value_diffs_localised"] = both + """, r AS (SELECT po_number, count(*) AS n FROM t GROUP BY 1)
SELECT 'purchase_order' AS table_name, CAST(po_number AS VARCHAR) AS pk, 'po_number' AS column_name, '1' AS source_value, CAST(n AS VARCHAR) AS target_value,
  'DUPLICATE_KEY' AS diff_type FROM r WHERE n > 1 AND po_number > 0
UNION ALL SELECT 'purchase_order', CAST(po_number AS VARCHAR), 'total_amount', CAST(s.total_amount AS VARCHAR), CAST(t.total_amount AS VARCHAR), 'VALUE_MISMATCH'
FROM s JOIN t USING (po_number) JOIN r USING (po_number) WHERE r.n = 1 AND s.total_amount <> t.total_amount
UNION ALL SELECT 'purchase_order', CAST(po_number AS VARCHAR), u.c, u.v, NULL, 'MISSING_VALUE' FROM s, unnest([
  {'c': 'vendor_id', 'v': CAST(vendor_id AS VARCHAR)}, {'c': 'order_date', 'v': strftime(order_date, '%Y-%m-%d %H:%M:%S')},
  {'c': 'total_amount', 'v': CAST(total_amount AS VARCHAR)}, {'c': 'po_status', 'v': po_status}]) x(u) WHERE po_number % 997 = 0)"""
    sql["extra_keys"] = lost
    sql["common_keys"] = """SELECT txn_id FROM src_inventory_transaction
INTERSECT SELECT txn_id FROM tgt_inventory_transaction"""
    sql["first_n_by_key"] = "SELECT * FROM src_inventory_transaction ORDER BY txn_id LIMIT 10"
    sql["ts_offset_profile"] = _union([
        _offsets("inventory", "last_counted_ts"), _offsets("inventory_transaction", "txn_ts"),
        _offsets("purchase_order", "order_date")])

    # counts and fingerprints
    sql["row_recon"] = "SELECT * FROM recon"
    sql["row_recon_by_content"] = "SELECT * FROM content_recon"
    sql["row_recon_surplus"] = _recon("tgt", "src", ("inventory_transaction",))
    sql["key_checksum_exact"] = _union([
        f"SELECT r.table_name, (SELECT count(*) FROM src_{t} s FULL JOIN tgt_{t} t ON s.{KEYS[t]} = t.{KEYS[t]} "
        f"WHERE s.{KEYS[t]} IS NULL OR t.{KEYS[t]} IS NULL) AS differing_keys, r.checksum_match "
        f"FROM recon r WHERE r.table_name = '{t}'" for t in TABLES])
    sql["key_fingerprint"] = _fingerprints({t: f"CAST({KEYS[t]} AS VARCHAR)" for t in TABLES})
    sql["row_fingerprint"] = _fingerprints({t: _row_text([KEYS[t], *_shared(t)]) for t in TABLES})
    sql["bucket_fingerprint"] = _union([
        _buckets("inventory_transaction", None), _buckets("supplier_contract", "terms_notes"),
        _buckets("purchase_order", "total_amount")])

    # change capture
    sql["cdc_gap"] = "SELECT * FROM gaps"
    sql["cdc_gap_whole_log"] = _gaps("cdc_events")
    ranked = ("SELECT *, CAST(row_number() OVER (PARTITION BY table_name ORDER BY event_count DESC, reason) AS INTEGER) AS pattern_no "
              f"FROM ({_PATTERNS.format(events='cdc_events')})")
    sql["cdc_gap_patterns"] = ranked
    sql["cdc_patterns_override"] = """SELECT reason, CAST(count(*) + CAST(table_name = 'vendor' AS INTEGER) AS VARCHAR) AS event_count,
  CASE WHEN table_name = 'vendor' THEN 'given: ' || reason ELSE '' END AS description
FROM (SELECT table_name, coalesce(gap_reason, 'UNKNOWN') AS reason FROM cdc_events WHERE NOT captured) GROUP BY table_name, reason"""
    sql["top_gap_reasons"] = f"SELECT * FROM ({ranked}) WHERE pattern_no <= 2"
    sql["cdc_pattern_detail"] = """SELECT e.table_name, e.reason, count(*) AS event_count, min(event_ts) AS first_occurrence,
  max(event_ts) AS last_occurrence, any_value(k.names) AS affected_columns
FROM (SELECT *, coalesce(gap_reason, 'UNKNOWN') AS reason FROM cdc_events WHERE NOT captured) e
JOIN (SELECT table_name, reason, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (
    SELECT table_name, coalesce(gap_reason, 'UNKNOWN') AS reason, unnest(json_keys(after)) AS name
    FROM cdc_events WHERE NOT captured) GROUP BY ALL) k USING (table_name, reason)
GROUP BY e.table_name, e.reason"""
    sql["cdc_summary"] = f"""SELECT *, {_pct('missed', 'total_events')} AS gap_rate FROM (
  SELECT CAST(sum(total_events) AS BIGINT) AS total_events, CAST(sum(captured) AS BIGINT) AS captured,
    CAST(sum(missed) AS BIGINT) AS missed, coalesce(string_agg(table_name, ',' ORDER BY table_name) FILTER (missed > 0), '') AS tables_affected
  FROM ({_gaps('cdc_events')}))"""
    sql["cdc_gap_windowed"] = _GAP_WINDOWS
    sql["cdc_gap_stream"] = _GAP_WINDOWS
    holes = lambda t, n, rows, more="": (f"SELECT {t} AS table_name, p + 1 AS first_missing, n - 1 AS last_missing, n - p - 1 AS missing_count "  # noqa: E731
                                         f"FROM (SELECT *, lag(n) OVER (PARTITION BY t ORDER BY n) AS p FROM (SELECT DISTINCT {t} AS t, {t} AS table_name, {n} AS n FROM {rows}{more})) WHERE n - p > 1")
    logged = "(SELECT * FROM cdc_events WHERE event_id % 50 NOT IN (7, 8, 9) AND event_id % 333 <> 0)"
    sql["missing_event_ids"] = _union([
        holes("'ALL'", "event_id", logged, " UNION ALL SELECT 'ALL', 'ALL', -1"),
        holes("table_name", "event_id // 5", f"(SELECT * FROM {logged} WHERE event_id // 5 % 40 <> 3)")])
    moved = """(SELECT order_date AS ts, CASE WHEN po_number % 1999 = 3 THEN 0 WHEN order_date < TIMESTAMP '1996-03-31' THEN 18000
  WHEN order_date < TIMESTAMP '1999-10-27' THEN 14400 ELSE 18000 END AS o FROM src_purchase_order)"""
    runs = f"""(SELECT s, any_value(o) AS o, min(ts) AS a, max(ts) AS b, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN o IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (ORDER BY ts, o ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, lag(o) OVER (ORDER BY ts, o) AS p FROM {moved})) GROUP BY s)"""
    line = "SELECT 'purchase_order' AS table_name, 'order_date' AS column_name, CAST(s AS BIGINT) AS segment, CAST(o AS BIGINT) AS offset_seconds, a AS first_ts, b AS last_ts, CAST(n AS BIGINT) AS row_count"
    sql["ts_offset_segments"] = f"""{line}, 1 AS least_rows FROM {runs}
UNION ALL {line}, 100 FROM (SELECT g AS s, any_value(o) AS o, min(a) AS a, max(b) AS b, sum(n) AS n FROM (
  SELECT *, sum(CASE WHEN o IS DISTINCT FROM q THEN 1 ELSE 0 END) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, lag(o) OVER (ORDER BY s) AS q FROM {runs} WHERE n >= 100)) GROUP BY g)"""
    sql["capture_match"] = sql["capture_match_stream"] = """SELECT table_name, count(*) FILTER (took <= 60) AS matched,
  count(*) FILTER (took IS NULL OR took > 60) AS missed, max(CASE WHEN took <= 60 THEN 60 * took END) AS longest_lag
FROM (SELECT table_name, event_ts, CASE WHEN captured THEN event_id % 90 END AS took,
        least(max(event_ts) OVER (), max(CASE WHEN captured THEN event_ts + (event_id % 90) * INTERVAL '1' MINUTE END) OVER ()) - INTERVAL '10' MINUTE AS reached
      FROM cdc_events)
WHERE took <= 60 OR event_ts + INTERVAL '1' HOUR < reached GROUP BY table_name"""
    sql["cdc_gap_windowed_undated"] = _GAP_WINDOWS.replace(
        "FROM cdc_events", "FROM (SELECT table_name, captured, CASE WHEN event_id % 17 <> 0 THEN event_ts END AS event_ts FROM cdc_events)")

    sql["cdc_pattern_columns"] = """SELECT table_name, coalesce(gap_reason, 'UNKNOWN') AS reason, name AS column_name, count(*) AS event_count,
  min(event_ts) AS first_occurrence, max(event_ts) AS last_occurrence
FROM (SELECT *, unnest(json_keys(after)) AS name FROM cdc_events WHERE NOT captured) GROUP BY ALL"""
    sql["stale_rows"] = f"SELECT * FROM ({_STALE})"
    sql["stale_counts"] = f"""SELECT table_name, verdict, row_count, later_events, longest_seconds,
  {_pct('row_count', 'total')} AS share_pct
FROM (SELECT *, CAST(sum(row_count) OVER (PARTITION BY table_name) AS BIGINT) AS total FROM (
  SELECT table_name, verdict, count(*) AS row_count, CAST(sum(later_events) AS BIGINT) AS later_events, max(behind_seconds) AS longest_seconds
  FROM ({_STALE}) GROUP BY table_name, verdict))"""

    # evidence, issues and score
    sql["evidence"] = "SELECT * EXCLUDE (table_ordinal, flag_mismatches) FROM evidence"
    sql["recon_issues"] = "SELECT table_name, issue_type, severity, detail FROM issues"
    sql["issue_counts"] = """SELECT coalesce(table_name, 'ALL') AS table_name, count(*) AS issues_found,
  count(*) FILTER (severity = 'CRITICAL') AS critical_count, count(*) FILTER (severity = 'WARNING') AS warning_count
FROM issues GROUP BY ROLLUP (table_name)"""
    sql["table_status"] = "SELECT table_name, status, issues_found FROM table_health"
    sql["health_score_issues"] = "SELECT * FROM score"
    sql["score_band"] = f"""SELECT table_name, s AS health_score, {_band('report')} AS report_band,
  {_band('dashboard')} AS dashboard_band, {_band('modal')} AS modal_band
FROM (SELECT table_name, CAST(greatest(0, 100 - deduction) AS INTEGER) AS s FROM table_health)"""
    sql["rca_gate"] = "SELECT * FROM score WHERE issues_found > 0"
    sql["table_health"] = """SELECT table_name, status, CAST(issues_found AS INTEGER) AS issues_found,
  CAST(critical_count AS INTEGER) AS critical_count, CAST(warning_count AS INTEGER) AS warning_count,
  CAST(greatest(0, 100 - deduction) AS INTEGER) AS health_score FROM table_health"""

    # root causes
    sql["derived_mismatches"] = "SELECT table_name, rule_key AS mismatch_type, explicit_rows FROM all_problems"
    sql["derived_mismatches_surplus"] = """
SELECT 'vendor' AS table_name, 'TYPE_COERCION_BOOL' AS mismatch_type, (SELECT count(*) FROM tgt_vendor) AS explicit_rows
UNION ALL SELECT 'vendor', 'CDC_TRIGGER_SKIP', missed FROM gaps WHERE table_name = 'vendor'
UNION ALL SELECT 'inventory', 'TYPE_COERCION_BOOL', (SELECT count(*) FROM tgt_inventory)
UNION ALL SELECT 'inventory_transaction', 'MISSING_COLUMN', (SELECT count(*) FROM tgt_inventory_transaction)
UNION ALL SELECT 'supplier_contract', 'TYPE_COERCION_BOOL', (SELECT count(*) FROM tgt_supplier_contract)
UNION ALL SELECT 'purchase_order', 'HEALTHY', 0"""
    sql["root_causes"] = "SELECT table_name, root_cause, confidence, priority, affected_rows, recommended_fix FROM findings"
    sql["root_causes_inferred"] = "SELECT * FROM inferred"
    sql["root_causes_from_values"] = f"""SELECT k.table_name, k.rule_key, r.root_cause, {_affected('0', 'sample_affected')} AS affected_rows
FROM (SELECT e.*, s.sample_affected, CASE WHEN missing_columns > 0 THEN 'MISSING_COLUMN' WHEN flag_mismatches > 0 THEN 'TYPE_COERCION_BOOL'
    WHEN gap_rate > 0 THEN 'CDC_TRIGGER_SKIP'
    WHEN diff_type IN ('FLOAT_ROUNDING', 'TZ_DRIFT', 'NULL_EMPTY', 'TYPE_COERCION_BOOL') THEN diff_type
    WHEN delta > 0 THEN 'SOFT_DELETE' WHEN schema_severity IN ('CRITICAL', 'WARNING') THEN 'MISSING_COLUMN'
    WHEN row_status = 'MISMATCH' THEN 'SOFT_DELETE'
    WHEN type_mismatches = 0 AND gap_rate = 0 AND delta = 0 AND missed = 0 AND diff_type IS NULL THEN 'HEALTHY' ELSE 'UNKNOWN' END AS rule_key
  FROM evidence e LEFT JOIN sampled_all s USING (table_name)) k JOIN rules r USING (rule_key)"""
    sql["affected_rows"] = f"""SELECT p.table_name, p.rule_key, r.root_cause, {_affected('0', 's.sample_affected')} AS affected_rows
FROM all_problems p JOIN rules r USING (rule_key) JOIN evidence e USING (table_name) LEFT JOIN sampled s USING (table_name)"""
    sql["coverage_completion"] = """SELECT table_name, rule_key, root_cause, affected_rows FROM findings WHERE priority = 'P1'
UNION ALL SELECT table_name, rule_key, root_cause, affected_rows FROM inferred
WHERE table_name NOT IN (SELECT table_name FROM findings WHERE priority = 'P1')"""
    sql["finding_counts"] = """SELECT count(*) FILTER (priority = 'P1') AS p1_count, count(*) FILTER (priority = 'P2') AS p2_count,
  count(*) FILTER (root_cause <> 'HEALTHY') AS root_causes_found, count(*) AS finding_count FROM findings"""
    sql["tables_investigated"] = "SELECT DISTINCT table_name FROM findings"
    sql["health_score_findings"] = "SELECT health_score, critical_count, warning_count FROM finding_score"
    sql["recommended_fixes"] = """SELECT row_number() OVER (ORDER BY table_ordinal, step, column_name) AS fix_no, priority,
  table_name, root_cause, recommended_fix FROM findings WHERE root_cause <> 'HEALTHY'"""

    # report tables
    sql["report_schema"] = """SELECT table_name, change AS issue, column_name, coalesce(source_type, '—') AS source_type,
  coalesce(target_type, '—') AS target_type,
  CASE change WHEN 'MISSING' THEN 'CRITICAL' WHEN 'EXTRA' THEN 'INFO' ELSE 'WARNING' END AS severity,
  coalesce(source_rows, target_rows) AS row_count FROM column_pairs WHERE change <> 'SAME'"""
    sql["report_recon"] = "SELECT * REPLACE (delta_pct || '%' AS delta_pct) FROM recon"
    sql["report_cdc"] = """SELECT * REPLACE (gap_rate || '%' AS gap_rate),
  CASE WHEN missed > 100 THEN 'HIGH' WHEN missed > 0 THEN 'LOW' ELSE 'NONE' END AS risk FROM gaps"""
    sql["report_cdc_patterns"] = f"""SELECT reason, CAST(event_count AS VARCHAR) AS event_count, '' AS description
FROM ({_PATTERNS.format(events='window_events')})"""
    sql["report_findings"] = """SELECT table_name, root_cause, priority,
  CAST(CAST(round_even(confidence * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS confidence, affected_rows, recommended_fix FROM findings"""
    advice = " ".join(f"WHEN '{band}' THEN {_quote(text)}" for band, text in cfg.BAND_ADVICE.items())
    sql["report_summary"] = f"""SELECT *, CASE band {advice} END AS recommendation FROM (
  SELECT health_score, critical_count, warning_count, root_causes_found,
    (SELECT count(DISTINCT table_name) FROM findings) AS tables_count, '0s' AS duration, {_band('report')} AS band
  FROM (SELECT *, health_score AS s FROM finding_score))"""
    sql["table_status_from_findings"] = """SELECT table_name, CASE max(rank) WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'HEALTHY' END AS status
FROM (SELECT table_name, CASE WHEN root_cause = 'HEALTHY' THEN 0 WHEN priority = 'P1' THEN 2 ELSE 1 END AS rank FROM findings)
GROUP BY table_name"""
    sql["result_severity"] = """SELECT table_name, 'schema_diff' AS result, CASE WHEN missing_columns = 0 AND type_mismatches = 0 THEN 'healthy'
  WHEN schema_severity = 'CRITICAL' THEN 'critical' ELSE 'warning' END AS severity FROM evidence
UNION ALL SELECT table_name, 'row_recon', CASE WHEN row_status = 'MATCH' THEN 'healthy' WHEN delta_pct > 5 THEN 'critical' ELSE 'warning' END
FROM evidence
UNION ALL SELECT table_name, 'cdc_gap', CASE WHEN missed = 0 THEN 'healthy' ELSE 'critical' END FROM evidence
UNION ALL SELECT table_name, 'root_cause:' || root_cause, CASE WHEN root_cause = 'HEALTHY' THEN 'healthy' WHEN priority = 'P1' THEN 'critical'
  WHEN priority = 'P2' THEN 'warning' ELSE 'info' END FROM findings
UNION ALL SELECT t, 'sample_diff:' || c, 'warning' FROM (VALUES ('vendor', 'active_flag'), ('inventory', 'unit_cost'), ('inventory', 'last_counted_ts'),
  ('inventory_transaction', 'txn_ts'), ('supplier_contract', 'terms_notes')) v(t, c)
UNION ALL SELECT NULL, 'task_log:' || t, 'info' FROM (VALUES """ + ", ".join(f"('{t}')" for t in cfg.RUN_TASKS) + ") v(t)"

    # task logs
    sql["parse_task_log"] = "SELECT * FROM parsed_logs"
    sql["latest_log"] = _union([_latest(run) for run in (None, "20240110", "29990101")])
    tasks = ", ".join(f"('{t}')" for t in cfg.RUN_TASKS)
    sql["task_log_status"] = f"""SELECT n.task_id, p.run_id, coalesce(p.status, 'NOT_FOUND') AS status,
  coalesce(p.duration_seconds, 0) AS duration_seconds, coalesce(p.records_processed, 0) AS records_processed,
  coalesce(p.records_failed, 0) AS records_failed,
  CASE WHEN p.status IS NULL THEN 'No logs found for task: ' || n.task_id ELSE p.error_message END AS error_message,
  p.partitions, p.shuffled_bytes, p.failed_tasks
FROM (VALUES {tasks}) n(task_id) LEFT JOIN ({_latest(None)}) l ON l.task_id = n.task_id
LEFT JOIN parsed_logs p ON p.task_id = l.task_id AND p.run_id = l.run_id AND p.file_name = l.file_name"""
    sql["task_log_totals"] = """SELECT dag_id, run_id, CAST(sum(duration_seconds) AS BIGINT) AS duration_seconds,
  CAST(sum(records_processed) AS BIGINT) AS records_processed, count(*) FILTER (status = 'FAILED') AS failed_task_count
FROM parsed_logs GROUP BY dag_id, run_id"""

    sql["error_templates"] = f"SELECT * FROM ({_TEMPLATES})"

    # constraint checks
    sql["duplicate_keys"] = duplicates
    sql["null_violations"] = _union([
        _null_counts("supplier_contract", "tgt_supplier_contract", ["contract_id", "contract_value", "terms_notes", "auto_renew"]),
        _null_counts("cdc_events", "cdc_events", ["event_ts", "captured", "gap_reason"])])
    sql["orphan_keys"] = """SELECT l_orderkey, count(*) AS child_rows FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT txn_id FROM tgt_inventory_transaction) GROUP BY l_orderkey"""
    return sql


#: Every row with the last event up to its time and the number of later ones, by comparing each row with all events of its key.
_STALE = """WITH held AS (
  SELECT 'inventory' AS table_name, item_id AS key, last_counted_ts AS row_ts FROM tgt_inventory
  UNION ALL SELECT 'vendor', vendor_id, TIMESTAMP '2024-01-02' + (vendor_id * 5 % 700) * INTERVAL '1' HOUR FROM tgt_vendor),
logged AS (SELECT table_name, primary_key AS key, event_ts, CAST(event_id AS VARCHAR) AS event_id,
  CASE WHEN table_name = 'inventory' THEN event_id % 3 <> 0 ELSE captured END AS captured FROM cdc_events),
counted AS (SELECT h.table_name, h.key, h.row_ts, max(e.event_ts) FILTER (e.event_ts <= row_ts) AS event_ts,
    count(*) FILTER (e.event_ts > row_ts) AS later_events, count(*) FILTER (e.event_ts > row_ts AND e.captured) AS later_captured,
    max(e.event_ts) FILTER (e.event_ts > row_ts) AS newest
  FROM held h LEFT JOIN logged e ON e.table_name = h.table_name AND e.key = h.key GROUP BY h.table_name, h.key, h.row_ts)
SELECT table_name, key, row_ts, event_ts,
  (SELECT max(event_id) FROM logged e WHERE e.table_name = c.table_name AND e.key = c.key AND e.event_ts = c.event_ts) AS event_id,
  later_events, later_captured, date_sub('second', row_ts, newest) AS behind_seconds,
  CASE WHEN later_events > 0 AND later_captured = 0 THEN 'NEVER_CAPTURED' WHEN later_events > 0 THEN 'LAGGING'
    WHEN event_ts IS NULL THEN 'NO_EVENTS' ELSE 'CURRENT' END AS verdict
FROM counted c"""

#: Words with digits, then crowded second and third places of the tree, then crowded places under a leaf.
_TEMPLATES = r"""WITH more AS (SELECT *, translate(CAST(primary_key AS VARCHAR), '0123456789', 'abcdefghij') AS host
  FROM cdc_events WHERE gap_reason IS NOT NULL OR event_id % 9 = 0),
all_lines AS (SELECT dag_id, task_id, unnest(regexp_extract_all(log_text, '(?m)ERROR.*?$')) AS line FROM task_logs
  UNION ALL SELECT 'capture', table_name, 'ERROR host ' || host || ' lost ' || table_name || ' in part ' || event_id FROM more
  UNION ALL SELECT 'capture', table_name, host || ' ERROR ' || operation || ' refused' FROM more),
shaped AS (SELECT dag_id, task_id, line, [CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END for w in string_split(line, ' ')] AS words FROM all_lines),
shapes AS (SELECT DISTINCT words, len(words) AS size FROM shaped),
one AS (SELECT words, size, CASE WHEN size IN (SELECT size FROM shapes GROUP BY size HAVING count(DISTINCT words[1]) > 16) THEN '<*>' ELSE words[1] END AS w1 FROM shapes),
two AS (SELECT words, size, w1, CASE WHEN (size, w1) IN (SELECT (size, w1) FROM one GROUP BY size, w1 HAVING count(DISTINCT words[2]) > 16)
  THEN '<*>' ELSE words[2] END AS w2 FROM one),
rest AS (SELECT DISTINCT size, w1, w2, spot, words[spot] AS w FROM two, generate_series(3, 40) g(spot) WHERE spot <= size),
crowded AS (SELECT size, w1, w2, list(spot) AS places FROM (
  SELECT size, w1, w2, spot FROM rest GROUP BY ALL HAVING count(*) > 16) GROUP BY size, w1, w2),
named AS (SELECT t.words, array_to_string([CASE WHEN i = 1 THEN t.w1 WHEN i = 2 THEN t.w2 WHEN list_contains(coalesce(c.places, []), i) THEN '<*>'
    ELSE t.words[i] END for i in range(1, t.size + 1)], ' ') AS template
  FROM two t LEFT JOIN crowded c ON c.size = t.size AND c.w1 = t.w1 AND c.w2 IS NOT DISTINCT FROM t.w2)
SELECT dag_id, task_id, template, count(*) AS line_count, count(DISTINCT words) AS shape_count, min(line) AS example
FROM shaped JOIN named USING (words) GROUP BY dag_id, task_id, template"""


def _used(text: str, ctes: dict[str, str]) -> list[str]:
    """The expressions a text uses, directly or not. The list of expressions is in dependency order."""
    used: set[str] = set()
    waiting = [text]
    while waiting:
        words = set(re.findall(r"\w+", waiting.pop()))
        new = [n for n in ctes if n in words and n not in used]
        used.update(new)
        waiting += [ctes[n] for n in new]
    return [n for n in ctes if n in used]


def sql_by_query() -> dict[str, str]:
    ctes = _ctes()
    ctes["history"] = _union([_run_at(ctes, *run) for run in (("2024-01-10", False), ("2024-01-20", False), ("2024-01-31", True))])
    statements = {}
    for query, body in _statements().items():
        prelude = _prelude(body, ctes)
        statements[query] = f"WITH {prelude}\n{body}" if prelude else body
    return statements
