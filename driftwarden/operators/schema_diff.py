"""Comparison of column catalogs. Inputs are column metadata, so every frame here is small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.config import SCHEMA_CRITICAL_COLUMNS
from driftwarden.functions.labels import mismatch_type_of


def column_changes(catalog: DataFrame) -> DataFrame:
    """One row per table and column: both types and MISSING, EXTRA, TYPE_MISMATCH or SAME.

    Raw types decide, so a different length or precision is not a mismatch.
    """
    carried = [c for c in ("data_type", "raw_type", "nullable", "row_count", "non_null_count")
               if c in catalog.columns]

    def of_side(side: str) -> list[Column]:
        return [F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}") for c in carried]

    change = (
        F.when(F.col("target_raw_type").isNull(), "MISSING").when(F.col("source_raw_type").isNull(), "EXTRA")
        .when(F.col("source_raw_type") != F.col("target_raw_type"), "TYPE_MISMATCH").otherwise("SAME")
    )
    return (
        catalog.groupBy("table_name", "column_name").agg(*of_side("source"), *of_side("target"))
        .withColumn("change", change)
    )


def missing_columns(changes: DataFrame) -> DataFrame:
    return changes.filter("change = 'MISSING'")


def extra_columns(changes: DataFrame) -> DataFrame:
    return changes.filter("change = 'EXTRA'")


def type_mismatches(changes: DataFrame) -> DataFrame:
    return changes.filter("change = 'TYPE_MISMATCH'").withColumn(
        "mismatch_type", mismatch_type_of(F.col("source_data_type"), F.col("target_data_type")))


def common_columns(changes: DataFrame) -> DataFrame:
    return changes.filter("change IN ('SAME', 'TYPE_MISMATCH')")


def nullability_changes(changes: DataFrame) -> DataFrame:
    return common_columns(changes).filter(F.col("source_nullable") != F.col("target_nullable"))


def columns_to_sample(changes: DataFrame) -> DataFrame:
    """Columns worth a value comparison: type mismatches first, then missing columns, each by name."""
    step = F.when(F.col("change") == "TYPE_MISMATCH", 1).when(F.col("change") == "MISSING", 2)
    return changes.withColumn("step", step).filter("step IS NOT NULL")


def schema_diff(changes: DataFrame, critical_columns: Sequence[str] = SCHEMA_CRITICAL_COLUMNS) -> DataFrame:
    """One row per table: column counts, the three lists sorted by column, and the severity.

    The lists hold column metadata of one table and are as short as its column list. A profiled
    catalog also gives ``missing_values``, the values that the missing columns held.
    """
    def listed(change: str, *fields: str) -> Column:
        entry = F.struct(F.col("column_name"), *[F.col(f) for f in fields])
        return F.sort_array(F.collect_list(F.when(F.col("change") == change, entry)))

    is_mismatch = F.col("change") == "TYPE_MISMATCH"
    critical = F.count_if(is_mismatch & F.col("column_name").isin(*critical_columns))
    profiled = "source_non_null_count" in changes.columns
    lost = F.coalesce(F.sum(F.when(F.col("change") == "MISSING", F.col("source_non_null_count"))), F.lit(0))
    per_table = changes.groupBy("table_name").agg(
        F.count("source_raw_type").alias("source_column_count"),
        F.count("target_raw_type").alias("target_column_count"),
        listed("MISSING", "source_data_type").alias("missing_columns"),
        listed("TYPE_MISMATCH", "source_data_type", "target_data_type").alias("type_mismatches"),
        listed("EXTRA", "target_data_type").alias("extra_columns"),
        critical.alias("critical_mismatches"), *([lost.alias("missing_values")] if profiled else []))
    missing, mismatched, extra = (F.size(c) for c in ("missing_columns", "type_mismatches", "extra_columns"))
    severity = (
        F.when((missing > 0) | (F.col("critical_mismatches") > 0), "CRITICAL")
        .when((mismatched > 0) | (extra > 0), "WARNING").otherwise("HEALTHY")
    )
    return per_table.withColumn("schema_severity", severity).drop("critical_mismatches")
