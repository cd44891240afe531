"""Small source and target tables with known drift, and the event log that goes with them.

Sizes and kinds of drift are chosen so that every expected figure can be derived by hand:
20 vendors (9 updated by the batch job and stale in the target), 20 items with rounded costs and
shifted count times, 15 clean orders, 25 transactions of which 6 are soft-deleted, 12 contracts
of which 5 have empty notes.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.config import TABLES, TablePair
from driftwarden.operators.transforms import TRANSFORMS
from driftwarden.schemas import EVENT_DDL, SOURCE_DDL

START = dt.datetime(2024, 1, 10, 8)
BATCH_VENDORS = (1, 4, 6, 8, 11, 13, 15, 17, 19)
DELETED_TXNS = (1000006, 1000009, 1000012, 1000015, 1000020, 1000025)
EMPTY_NOTES = (2, 4, 7, 9, 12)


def _at(hours: int) -> dt.datetime:
    return START + dt.timedelta(hours=hours)


def source_rows(name: str) -> list[tuple]:
    day = dt.date(2024, 1, 1)
    if name == "vendor":
        return [(f"V{i:03d}", f"Vendor {i}", ("GOLD", "SILVER")[i % 2], 30, 14 + i, "NY"[i % 3 > 0], "US", "USD", _at(-i), _at(i),
                 "BATCH_JOB" if i in BATCH_VENDORS else f"USER_{i:03d}") for i in range(1, 21)]
    if name == "inventory":
        return [(f"ITM-{i:06d}", f"WH-{i % 4}", Decimal(i) / 2, 10 * i, 20 * i, Decimal(12 * i) + Decimal("0.3456"), "AC", _at(i), _at(i),
                 "COUNTER_01") for i in range(1, 21)]
    if name == "purchase_order":
        return [(f"PO-{i:04d}", f"V{i:03d}", day, day + dt.timedelta(days=i), Decimal(100 * i), "OPEN", i, "MGR", _at(i), _at(i + 1))
                for i in range(1, 16)]
    if name == "inventory_transaction":
        return [(key, f"ITM-{1 + key % 20:06d}", "REC", Decimal(key % 7), _at(key % 50), "WH-1", None if key % 5 == 0 else f"REF-{key}",
                 "USER_001", "DEL" if key in DELETED_TXNS else "ACT") for key in range(1000001, 1000026)]
    if name == "supplier_contract":
        return [(f"C{i:03d}", f"V{i:03d}", day, day + dt.timedelta(days=365), Decimal(1000 * i), "" if i in EMPTY_NOTES else f"Note {i}",
                 "MONTHLY", "YN"[i % 2], _at(i)) for i in range(1, 13)]
    raise ValueError(name)


def source(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(source_rows(name), SOURCE_DDL[name])


def pair(spark: SparkSession, name: str) -> TablePair:
    src = source(spark, name)
    target = TRANSFORMS[name](src)
    if name == "vendor":  # the batch job's updates never reached the target
        stale = F.when(F.col("updated_by") == "BATCH_JOB", F.col("updated_ts") - F.expr("INTERVAL 40 DAYS"))
        target = target.withColumn("updated_ts", F.coalesce(stale, "updated_ts"))
    return TablePair(name, TABLES[name].key, src, target)


def pairs(spark: SparkSession) -> list[TablePair]:
    return [pair(spark, name) for name in TABLES]


def event_rows() -> list[tuple]:
    """35 events: 18 lost vendor updates, 10 captured ones, and 7 of the other tables."""
    def event(i: int, table: str, captured: bool | None, reason: str | None) -> tuple:
        after = '{"vendor_tier":"GOLD","updated_ts":"x"}' if not captured else '{"payment_terms":45}'
        stamp = (dt.datetime(2024, 1, 2, 3) + dt.timedelta(hours=i)).strftime("%Y-%m-%dT%H:%M:%SZ")
        return (f"evt_{i:03d}", table, "UPDATE", stamp, f"K{i}", "BATCH_JOB", "{}", after, captured, reason)

    others = ["inventory"] * 2 + ["purchase_order"] + ["inventory_transaction"] * 3 + ["supplier_contract"]
    lost = [event(i, "vendor", False, "CDC_TRIGGER_SKIP") for i in range(1, 19)]
    kept = [event(i, "vendor", True, None) for i in range(19, 29)]
    return lost + kept + [event(i, table, True, None) for i, table in enumerate(others, start=29)]


def raw_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(event_rows(), EVENT_DDL)


# the figures of a longer log that a summary document carries for one table
VENDOR_SUMMARY = ("vendor", 4230, 3383, 847, 20.02)
SUMMARY_DDL = "table_name STRING, total_events BIGINT, captured BIGINT, missed BIGINT, gap_rate DOUBLE"
