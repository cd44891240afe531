"""Table definitions, load order and rule tables, all passed to operators as parameters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class TableSpec:
    """What an operator must know about one migrated table."""

    name: str
    key: str
    target_columns: Sequence[str]
    foreign_keys: dict[str, str] = field(default_factory=dict)  # column -> parent table
    nullable_columns: frozenset[str] = frozenset()


@dataclass(frozen=True)
class OddKeys:
    """Keys that cannot be paired, because a side repeats them or they are NULL, with the rows of each side: a written table."""

    rows: DataFrame
    count: int


@dataclass(frozen=True)
class TablePair:
    """The two versions of one table that a reconciliation compares."""

    name: str
    key: str
    source: DataFrame
    target: DataFrame
    odd_keys: OddKeys | None = None  # None: not looked for yet (see ``value_diff.checked``)

    def shared_columns(self) -> list[str]:
        """Non-key columns on both sides, in source order."""
        present = set(self.target.columns)
        return [c for c in self.source.columns if c in present and c != self.key]


Transform = Callable[[DataFrame], DataFrame]


# Table names, keys and the columns the target database expects.
TABLES: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        TableSpec(
            "vendor", "vendor_id",
            ("vendor_id", "vendor_name", "payment_terms", "lead_time_days", "active_flag",
             "country_code", "currency_code", "created_ts", "updated_ts", "updated_by"),
        ),
        TableSpec(
            "inventory", "item_id",
            ("item_id", "location_id", "on_hand_qty", "reorder_point", "reorder_qty", "unit_cost",
             "status_code", "last_counted_ts", "updated_ts", "updated_by"),
        ),
        TableSpec(
            "inventory_transaction", "txn_id",
            ("txn_id", "item_id", "txn_type", "txn_qty", "txn_ts", "location_id", "reference_id",
             "created_by", "is_deleted"),
            foreign_keys={"item_id": "inventory"},
            nullable_columns=frozenset({"reference_id"}),
        ),
        TableSpec(
            "supplier_contract", "contract_id",
            ("contract_id", "vendor_id", "start_date", "end_date", "contract_value", "terms_notes",
             "payment_freq", "auto_renew", "created_ts"),
            foreign_keys={"vendor_id": "vendor"},
            nullable_columns=frozenset({"terms_notes"}),
        ),
        TableSpec(
            "purchase_order", "po_number",
            ("po_number", "vendor_id", "order_date", "expected_date", "total_amount", "po_status",
             "line_count", "approved_by", "created_ts", "updated_ts"),
            foreign_keys={"vendor_id": "vendor"},
        ),
    )
}


def load_levels(tables: dict[str, TableSpec] | None = None) -> list[list[str]]:
    """Tables grouped so that every parent is in an earlier group than its children."""
    tables = TABLES if tables is None else tables
    levels: list[list[str]] = []
    placed: set[str] = set()
    while len(placed) < len(tables):
        level = [
            name for name, spec in tables.items()
            if name not in placed and all(p in placed or p not in tables for p in spec.foreign_keys.values())
        ]
        if not level:
            raise ValueError(f"foreign keys form a cycle among {sorted(set(tables) - placed)}")
        levels.append(level)
        placed.update(level)
    return levels


def require_known_table(name: str, tables: dict[str, TableSpec] | None = None) -> TableSpec:
    tables = TABLES if tables is None else tables
    if name not in tables:
        raise ValueError(f"unknown table {name!r}; known tables: {sorted(tables)}")
    return tables[name]


# Columns whose type change is critical, for the schema severity and for issues.
SCHEMA_CRITICAL_COLUMNS = ("active_flag", "vendor_tier")
ISSUE_CRITICAL_COLUMNS = ("active_flag",)

# Look-back of the capture-gap analysis.
DEFAULT_LOOKBACK_HOURS = 168

# Score deductions.
CRITICAL_POINTS = 15
WARNING_POINTS = 5
ROW_DRIFT_POINTS = 10
CDC_GAP_POINTS = 10
ROW_DRIFT_LIMIT_PCT = 1.0
CDC_GAP_LIMIT_PCT = 2.0
CRITICAL_ROW_DRIFT_PCT = 5.0


@dataclass(frozen=True)
class RootCauseRule:
    mismatch_type: str
    root_cause: str
    confidence: float
    priority: str
    recommended_fix: str


# Root cause, confidence, priority and fix text for each kind of mismatch.
ROOT_CAUSE_RULES: tuple[RootCauseRule, ...] = (
    RootCauseRule("MISSING_COLUMN", "CDC_SCHEMA_DRIFT", 0.94, "P1", "Add missing column to target schema and backfill from source. Update CDC configuration to include the column in change payloads."),
    RootCauseRule("TYPE_COERCION_BOOL", "TYPE_COERCION", 0.91, "P2", "Standardize column type across source and target. Add explicit CHAR→BOOLEAN mapping in the ETL transform layer."),
    RootCauseRule("CDC_TRIGGER_SKIP", "CDC_TRIGGER_GAP", 0.96, "P1", "Modify CDC triggers to capture BATCH_JOB updates. Consider using log-based CDC instead of trigger-based to capture all DML."),
    RootCauseRule("FLOAT_ROUNDING", "TYPE_COERCION", 0.88, "P2", "Change target column from FLOAT to DECIMAL with matching precision. Re-run ETL to restore precision."),
    RootCauseRule("TZ_DRIFT", "TZ_MISMATCH", 0.92, "P2", "Normalize all timestamps to UTC in the transform layer. Store with TIMESTAMPTZ type in target. Apply retroactive correction to affected rows."),
    RootCauseRule("SOFT_DELETE", "SOFT_DELETE_MISMATCH", 0.95, "P1", "Include soft-deleted rows in target with is_deleted flag. Modify ETL to preserve all rows and map status_code DEL to is_deleted=true."),
    RootCauseRule("NULL_EMPTY", "NULL_EMPTY_MISMATCH", 0.89, "P3", "Standardize NULL handling: treat empty strings as NULL consistently in the transform layer. Apply COALESCE/NULLIF in ETL."),
    RootCauseRule("HEALTHY", "HEALTHY", 0.99, "P3", "No action required. Table is healthy."),
)
UNKNOWN_RULE = RootCauseRule("UNKNOWN", "UNKNOWN", 0.50, "P2", "Manual investigation required. Review ETL logs and source/target data.")

# Advice printed with each report band.
BAND_ADVICE = {
    "CRITICAL": "Immediate attention required. Critical data integrity issues detected. Do not proceed with go-live until all P1 issues are resolved.",
    "AT RISK": "Significant issues detected. Address all P1 and P2 findings before proceeding with go-live.",
    "HEALTHY": "Migration appears healthy. Review any warnings before final sign-off.",
}

# The tasks of one migration run, in order.
RUN_TASKS = ("extract_from_source", "transform_data", "load_to_target", "run_reconciliation", "run_rca_agent")
