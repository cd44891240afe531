"""Small driver-side tables (rules, table lists, column catalogs) as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from driftwarden.config import ROOT_CAUSE_RULES, UNKNOWN_RULE, RootCauseRule


def small_frame(spark: SparkSession, rows: Iterable[Sequence], ddl: str) -> DataFrame:
    """A local relation, so Spark knows its size and never shuffles a table to join it."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    rows = list(rows)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def table_list(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return small_frame(spark, enumerate(names), "table_ordinal INT, table_name STRING").select(
        "table_name", "table_ordinal")


def rule_table(spark: SparkSession, rules: Sequence[RootCauseRule] = ROOT_CAUSE_RULES) -> DataFrame:
    rows = [(r.mismatch_type, r.root_cause, r.confidence, r.priority, r.recommended_fix)
            for r in (*rules, UNKNOWN_RULE)]
    return small_frame(
        spark, rows,
        "rule_key STRING, root_cause STRING, confidence DOUBLE, priority STRING, recommended_fix STRING")
