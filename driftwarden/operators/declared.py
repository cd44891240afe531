"""Declared schemas: how a table departs from its declaration, and reads that refuse to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftwarden.functions.names import quoted
from driftwarden.sources.local import small_frame


class SchemaMismatch(ValueError):
    """A table's columns or types are not the declared ones."""


def declared_schema(declared: str | StructType) -> StructType:
    return declared if isinstance(declared, StructType) else StructType.fromDDL(declared)


def departures(df: DataFrame, declared: str | StructType) -> list[tuple[str, str, str | None, str | None]]:
    """(column, problem, declared type, actual type) of every column that is missing, undeclared or of another type. Reads no row."""
    wanted = {f.name: f.dataType.simpleString() for f in declared_schema(declared).fields}
    held = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ([(c, "MISSING", t, None) for c, t in wanted.items() if c not in held]
            + [(c, "OTHER_TYPE", t, held[c]) for c, t in wanted.items() if c in held and held[c] != t]
            + [(c, "UNDECLARED", None, t) for c, t in held.items() if c not in wanted])


def require_declared(df: DataFrame, declared: str | StructType) -> DataFrame:
    """``df`` with the declared columns in their order; NULLs in columns declared NOT NULL fail the query that reads them.

    Raises ``SchemaMismatch`` at once where columns or types differ. The check of NULLs is part of the scan, so nothing is read twice.
    """
    if problems := departures(df, declared):
        raise SchemaMismatch("; ".join(f"{c}: {p.lower()} (declared {d}, found {a})" for c, p, d, a in problems))
    return df.select(*[
        F.col(quoted(f.name)) if f.nullable else F.coalesce(
            quoted(f.name), F.raise_error(F.lit(f"NULL in {f.name}, declared NOT NULL")).cast(f.dataType)).alias(f.name)
        for f in declared_schema(declared).fields])


def schema_departures(df: DataFrame, declared: str | StructType) -> DataFrame:
    """``(column_name, problem, declared_type, actual_type, row_count)``: ``departures``, and the NULLs per column declared NOT NULL.

    NULLs are counted in one pass over these columns only; ``row_count`` is NULL for the other problems.
    """
    found = small_frame(df.sparkSession, [(*p, None) for p in departures(df, declared)],
                        "column_name STRING, problem STRING, declared_type STRING, actual_type STRING, row_count BIGINT")
    fields = [f for f in declared_schema(declared).fields if not f.nullable and f.name in df.columns]
    if not fields:
        return found
    counts = df.agg(*[F.count_if(F.col(quoted(f.name)).isNull()).alias(f"c{i}") for i, f in enumerate(fields)])
    types = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    lines = F.array(*[F.struct(
        F.lit(f.name).alias("column_name"), F.lit("NULLS").alias("problem"), F.lit(f.dataType.simpleString()).alias("declared_type"),
        F.lit(types[f.name]).alias("actual_type"), F.col(f"c{i}").alias("row_count")) for i, f in enumerate(fields)])
    return found.unionByName(counts.select(F.inline(lines)).where("row_count > 0"))
