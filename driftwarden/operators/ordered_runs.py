"""Neighbouring rows in an order over a whole table: holes in key sequences, and segments of an equal value.

A window over the table would sort it in one task. Instead rows are dealt to ranges of the order (written once, so the ranges
stand), windows look inside a range, and what crosses a border comes from a small table: one row per range and group, with its
first and last value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from driftwarden.config import TablePair
from driftwarden.functions.names import quoted
from driftwarden.operators.value_diff import S, T, align
from driftwarden.session import written

#: Borders up to which their table is broadcast to the rows.
BROADCAST_BORDERS = 100_000


@dataclass(frozen=True)
class Ranged:
    """Rows (group columns, order columns, ``value__``, ``range__``) in written ranges, and their borders.

    A border is a row per range and group that has rows there: ``first__``, ``last__`` (values), ``before__`` (the group's last value in
    an earlier range, in a struct, NULL if there is none).
    """

    rows: DataFrame
    borders: DataFrame
    border_count: int
    group: tuple[str, ...]
    order: tuple[str, ...]

    def inside(self) -> WindowSpec:
        return Window.partitionBy("range__", *self.group).orderBy(*self.order)

    def joined(self, rows: DataFrame, borders: DataFrame) -> DataFrame:
        if self.border_count <= BROADCAST_BORDERS:
            borders = F.broadcast(borders)
        keys = ["range__", *self.group]
        same = [rows[k].eqNullSafe(borders[k]) for k in keys]
        return rows.join(borders, same).drop(*[borders[k] for k in keys])


def ranged(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, carried: Sequence[str] = ()) -> Ranged:
    """``df`` dealt by group and order, with the columns ``carried``. Rows of equal order stand in one range, next to each other."""
    rows = df.select(*map(quoted, [*group, *order, *carried]), value.alias("value__"))
    rows, _ = written(rows.repartitionByRange(*map(quoted, group), *map(quoted, order)).withColumn("range__", F.spark_partition_id()), "ranged-rows")
    place = F.struct(*map(quoted, order))
    borders = rows.groupBy("range__", *map(quoted, group)).agg(
        F.min_by(F.struct("value__"), place).alias("first__"), F.max_by(F.struct("value__"), place).alias("last__"))
    before = F.lag("last__").over(Window.partitionBy(*map(quoted, group)).orderBy("range__"))  # over ranges, not rows
    borders, count = written(borders.withColumn("before__", before), "borders")
    return Ranged(rows, borders, count, tuple(map(quoted, group)), tuple(map(quoted, order)))


def with_previous(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """(group, order, ``value__``, ``previous__``): every row with the value of the row before it in its group, in a struct; NULL for the first."""
    r = ranged(df, group, order, value)
    near = r.rows.withColumn("near__", F.lag(F.struct("value__")).over(r.inside()))
    return r.joined(near, r.borders.drop("first__", "last__")).withColumn("previous__", F.coalesce("near__", "before__")).drop(
        "near__", "before__", "range__")


def missing_intervals(df: DataFrame, key: str, group: Sequence[str] = (), first: int | None = None, last: int | None = None) -> DataFrame:
    """Holes in a sequence of whole numbers: (group, ``first_missing``, ``last_missing``, ``missing_count``).

    Numbers are expected without gaps between the smallest and the largest of a group, and from ``first`` and to ``last`` if these
    are given (for groups that have a number). Repeated numbers and NULLs leave no hole.
    """
    number = F.col(quoted(key)).cast("bigint")
    rows = df.where(F.col(quoted(key)).isNotNull()).select(*map(quoted, group), number.alias("number__")).distinct()
    if first is not None or last is not None:
        # stand-ins just outside the expected range
        ends = [F.lit(n).cast("bigint") for n in ([first - 1] if first is not None else []) + ([last + 1] if last is not None else [])]
        known = rows.select(*map(quoted, group)).distinct() if group else rows.limit(1).select()
        rows = rows.unionByName(known.select("*", F.explode(F.array(*ends)).alias("number__"))).distinct()
    pairs = with_previous(rows, group, ["number__"], F.col("number__"))
    before = F.col("previous__.value__")
    return pairs.where(F.col("number__") - before > 1).select(
        *map(quoted, group), (before + 1).alias("first_missing"), (F.col("number__") - 1).alias("last_missing"),
        (F.col("number__") - before - 1).alias("missing_count"))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, carried: Sequence[str] = ()) -> DataFrame:
    """Rows (group, order, carried, ``value__``) with the number, from 1, of the stretch of equal values they stand in: ``segment``.

    A stretch over many ranges has one number: each range counts how many begin in it, and the sums of the ranges before are
    added to the numbers of its rows. NULL is a value.
    """
    r = ranged(df, group, order, value, carried)
    lagged = F.lag(F.struct("value__")).over(r.inside())
    rows = r.rows.withColumn("begins__", (lagged.isNotNull() & ~lagged.getField("value__").eqNullSafe(F.col("value__"))).cast("bigint"))
    at_border = (F.col("before__").isNull() | ~F.col("before__.value__").eqNullSafe(F.col("first__.value__"))).cast("bigint")
    keys = ["range__", *r.group]
    counted = r.joined(rows.groupBy(*keys).agg(F.sum("begins__").alias("held__")), r.borders.withColumn("border__", at_border))
    upto = Window.partitionBy(*r.group).orderBy("range__")  # over ranges, not rows
    base = counted.withColumn("base__", F.sum(F.col("held__") + F.col("border__")).over(upto) - F.col("held__")).select(*keys, "base__")
    base, _ = written(base, "segments-before")
    local = F.sum("begins__").over(r.inside().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return r.joined(rows.withColumn("local__", local), base).withColumn("segment", F.col("base__") + F.col("local__")).drop(
        "begins__", "local__", "base__", "range__")


def segments(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """Longest stretches of rows with an equal value: (group, ``segment``, ``value``, ``first_<order[0]>``, ``last_<order[0]>``, ``row_count``).

    Rows are counted per stretch by an aggregate that combines in each task, so a stretch may hold any part of the table.
    """
    along = F.col(quoted(order[0]))
    return numbered(df, group, order, value).groupBy(*map(quoted, group), "segment").agg(
        F.first("value__").alias("value"), F.min(along).alias(f"first_{order[0]}"), F.max(along).alias(f"last_{order[0]}"),
        F.count(F.lit(1)).alias("row_count"))


def ts_offset_segments(pair: TablePair, column: str, least_rows: int = 1) -> DataFrame:
    """How the offset of a target timestamp changes along time: one row per segment of equal offset, by the source's time.

    A change of a clock or zone rule shows as two segments with the dates between which it happened. Stretches of fewer than
    ``least_rows`` rows (stale rows among good ones) are left out and their neighbours joined if they agree; ``row_count`` counts the
    rows that have the offset. Rows without a counterpart or a time have no offset and are left out; times that are equal are
    ordered by offset.
    """
    offset = F.timestamp_diff("SECOND", F.col(S).getField(column), F.col(T).getField(column))
    rows = align(pair, [column]).select(F.col(S).getField(column).alias("ts"), offset.alias("offset")).where("offset IS NOT NULL")
    found = segments(rows, [], ["ts", "offset"], F.col("offset"))
    if least_rows > 1:
        long = found.where(F.col("row_count") >= least_rows)
        joined = numbered(long.withColumnRenamed("segment", "place"), [], ["place"], F.col("value"), ["first_ts", "last_ts", "row_count"])
        found = joined.groupBy("segment").agg(
            F.first("value__").alias("value"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
            F.sum("row_count").alias("row_count"))
    return found.select(F.lit(pair.name).alias("table_name"), F.lit(column).alias("column_name"), "segment",
                        F.col("value").alias("offset_seconds"), "first_ts", "last_ts", "row_count")
