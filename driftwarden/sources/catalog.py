"""Column metadata of tables, taken from their schemas, and the data profile that goes with it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.config import TablePair
from driftwarden.sources.local import small_frame

# SQL names of the types.
_SQL_NAMES: dict[type[T.DataType], str] = {
    T.StringType: "character varying",
    T.BooleanType: "boolean",
    T.ByteType: "smallint",
    T.ShortType: "smallint",
    T.IntegerType: "integer",
    T.LongType: "bigint",
    T.FloatType: "real",
    T.DoubleType: "double precision",
    T.DecimalType: "numeric",
    T.DateType: "date",
    T.TimestampNTZType: "timestamp without time zone",
    T.TimestampType: "timestamp with time zone",
    T.BinaryType: "bytea",
}

CATALOG_DDL = """table_name STRING, side STRING, ordinal INT, column_name STRING, data_type STRING,
    raw_type STRING, nullable BOOLEAN"""


def raw_type(dtype: T.DataType) -> str:
    """SQL name without length or precision."""
    if isinstance(dtype, (T.CharType, T.VarcharType)):
        return "character" if isinstance(dtype, T.CharType) else "character varying"
    return _SQL_NAMES.get(type(dtype), dtype.simpleString())


def format_type(dtype: T.DataType) -> str:
    """SQL name with length, or with precision and scale where the scale is not zero."""
    name = raw_type(dtype)
    if isinstance(dtype, (T.CharType, T.VarcharType)):
        return f"{name}({dtype.length})"
    if isinstance(dtype, T.DecimalType) and dtype.scale:
        return f"{name}({dtype.precision},{dtype.scale})"
    return name


def column_catalog(spark: SparkSession, pairs: Sequence[TablePair]) -> DataFrame:
    """One row per table, side and column. Metadata only: its size is the number of columns."""
    rows = [
        (pair.name, side, i, f.name, format_type(f.dataType), raw_type(f.dataType), f.nullable)
        for pair in pairs
        for side, df in (("source", pair.source), ("target", pair.target))
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return small_frame(spark, rows, CATALOG_DDL)


def change_of(pair: TablePair, column: str) -> str:
    """How a column differs between the two schemas: MISSING, EXTRA, TYPE_MISMATCH or SAME."""
    if column not in pair.target.columns:
        return "MISSING"
    if column not in pair.source.columns:
        return "EXTRA"
    types = {raw_type(df.schema[column].dataType) for df in (pair.source, pair.target)}
    return "SAME" if len(types) == 1 else "TYPE_MISMATCH"


def column_profile(pairs: Sequence[TablePair], changes: Sequence[str] = ()) -> DataFrame:
    """Row count and non-null count of columns, those of a table in one scan.

    With ``changes``, only columns that the schemas show to have one of them are read, and sides without any not at all.
    """
    def profile(name: str, side: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        counts = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns])
        cells = F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("non_null_count")) for c in columns])
        return counts.select(
            F.lit(name).alias("table_name"), F.lit(side).alias("side"), "row_count", F.inline(cells))

    frames = []
    for p in pairs:
        for side, df in (("source", p.source), ("target", p.target)):
            columns = [c for c in df.columns if not changes or change_of(p, c) in changes]
            if columns:
                frames.append(profile(p.name, side, df, columns))
    if not frames:
        return pairs[0].source.sparkSession.createDataFrame(
            [], "table_name STRING, side STRING, row_count BIGINT, column_name STRING, non_null_count BIGINT")
    return reduce(DataFrame.unionByName, frames)


def observed_catalog(catalog: DataFrame, profile: DataFrame) -> DataFrame:
    """The catalog with what the data shows: counts, and whether a NULL really occurs.

    ``nullable`` of the result is the observed flag; files and views often declare every column
    nullable, which would hide a column that has started to receive NULLs. Columns without a
    profile keep the declared flag. Both sides have a row per column, hence the broadcast.
    """
    observed = F.col("non_null_count") < F.col("row_count")
    return catalog.join(F.broadcast(profile), ["table_name", "side", "column_name"], "left").withColumn(
        "nullable", F.coalesce(observed, F.col("nullable")))
