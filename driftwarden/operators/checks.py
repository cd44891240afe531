"""Constraint checks: the guarantees a target database would enforce, counted instead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.functions.names import quoted

KeyColumns = str | Sequence[str]


def _names(key: KeyColumns) -> list[str]:
    return [quoted(c) for c in ([key] if isinstance(key, str) else key)]


def duplicate_keys(df: DataFrame, key: KeyColumns) -> DataFrame:
    """Keys that occur more than once. Rows combine before the shuffle, so a hot key is one row per task."""
    return df.groupBy(*_names(key)).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def null_violations(df: DataFrame, not_null: Sequence[str]) -> DataFrame:
    """NULLs per required column, all columns in one pass."""
    counts = df.agg(*[F.count_if(F.col(quoted(c)).isNull()).alias(c) for c in not_null])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).alias("null_count")) for c in not_null]
    return counts.select(F.inline(F.array(*cells)))


def orphan_keys(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """Foreign-key values without a parent, with their child rows.

    Children are counted per value first, so the join sees each value once however hot it is.
    NULL references are allowed by a foreign key and are left out.
    """
    references = child.filter(F.col(quoted(fk)).isNotNull()).groupBy(quoted(fk)).agg(F.count(F.lit(1)).alias("child_rows"))
    parents = parent.select(F.col(quoted(key)).alias(fk)).distinct()
    return references.join(parents, fk, "left_anti")


def count_non_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many rows have each column present."""
    return df.agg(*[F.count(quoted(c)).alias(c) for c in columns])
