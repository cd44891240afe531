"""Declared schemas: the five migrated tables (source side), the event log and its summary document."""

from __future__ import annotations

# Source columns and types. The target side follows from the transforms.
SOURCE_DDL: dict[str, str] = {
    "vendor": """
        vendor_id STRING NOT NULL, vendor_name STRING NOT NULL, vendor_tier STRING NOT NULL,
        payment_terms INT NOT NULL, lead_time_days INT NOT NULL, active_flag STRING NOT NULL,
        country_code STRING NOT NULL, currency_code STRING NOT NULL, created_ts TIMESTAMP_NTZ NOT NULL,
        updated_ts TIMESTAMP_NTZ NOT NULL, updated_by STRING NOT NULL""",
    "inventory": """
        item_id STRING NOT NULL, location_id STRING NOT NULL, on_hand_qty DECIMAL(10,2) NOT NULL,
        reorder_point INT NOT NULL, reorder_qty INT NOT NULL, unit_cost DECIMAL(10,4) NOT NULL,
        status_code STRING NOT NULL, last_counted_ts TIMESTAMP_NTZ NOT NULL,
        updated_ts TIMESTAMP_NTZ NOT NULL, updated_by STRING NOT NULL""",
    "purchase_order": """
        po_number STRING NOT NULL, vendor_id STRING NOT NULL, order_date DATE NOT NULL,
        expected_date DATE NOT NULL, total_amount DECIMAL(15,2) NOT NULL, po_status STRING NOT NULL,
        line_count INT NOT NULL, approved_by STRING NOT NULL, created_ts TIMESTAMP_NTZ NOT NULL,
        updated_ts TIMESTAMP_NTZ NOT NULL""",
    "inventory_transaction": """
        txn_id BIGINT NOT NULL, item_id STRING NOT NULL, txn_type STRING NOT NULL,
        txn_qty DECIMAL(10,2) NOT NULL, txn_ts TIMESTAMP_NTZ NOT NULL, location_id STRING NOT NULL,
        reference_id STRING, created_by STRING NOT NULL, status_code STRING NOT NULL""",
    "supplier_contract": """
        contract_id STRING NOT NULL, vendor_id STRING NOT NULL, start_date DATE NOT NULL,
        end_date DATE NOT NULL, contract_value DECIMAL(15,2) NOT NULL, terms_notes STRING,
        payment_freq STRING NOT NULL, auto_renew STRING NOT NULL, created_ts TIMESTAMP_NTZ NOT NULL""",
}

# One change event. The row images differ per event, so their JSON text is kept.
EVENT_DDL = """
    event_id STRING, table_name STRING, operation STRING, timestamp STRING, primary_key STRING,
    updated_by STRING, before STRING, after STRING, captured BOOLEAN, gap_reason STRING"""

# The precomputed gap summary of one table.
GAP_SUMMARY_DDL = """STRUCT<total_events: BIGINT, captured: BIGINT, missed: BIGINT, gap_rate: DOUBLE,
    gap_patterns: ARRAY<STRUCT<reason: STRING, description: STRING, count: BIGINT,
        affected_columns: ARRAY<STRING>, first_occurrence: STRING, last_occurrence: STRING>>>"""
