"""Compare a Spark result with the DuckDB result of the equivalent SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

# Spark type -> DuckDB types that hold the same values
SAME_TYPES = {
    "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "int": {"INTEGER"}, "bigint": {"BIGINT"}, "double": {"DOUBLE"},
    "timestamp_ntz": {"TIMESTAMP"}, "date": {"DATE"},
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (decimal.Decimal, dt.datetime, dt.date)):
        return str(value)
    return value


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between the two results; empty if nothing does."""
    expected = con.sql(sql)
    found = []
    want = dict(zip(expected.columns, map(str, expected.types)))
    have = dict(result.dtypes)
    if sorted(want) != sorted(have):
        return [f"columns {sorted(have)} instead of {sorted(want)}"]
    for column, dtype in have.items():
        allowed = SAME_TYPES.get(dtype, {dtype.upper()})
        if want[column] not in allowed:
            found.append(f"type of {column}: {dtype} against {want[column]}")
    spark_rows = _rows(list(have), result.collect())
    duck_rows = _rows(expected.columns, expected.fetchall())
    if spark_rows != duck_rows:
        surplus, absent = list((spark_rows - duck_rows).items()), list((duck_rows - spark_rows).items())
        found.append(f"rows {spark_rows.total()} against {duck_rows.total()}; only Spark {surplus[:3]}, only SQL {absent[:3]}")
    return found
