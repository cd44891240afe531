"""Key-aligned comparison of two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.config import OddKeys, TablePair
from driftwarden.functions.conversion import canonical_text
from driftwarden.functions.labels import classify_diff, values_differ
from driftwarden.functions.names import quoted
from driftwarden.session import written


def _keyed(pair: TablePair) -> tuple[DataFrame, DataFrame]:
    """Both sides with the key under one type (text if the types differ)."""
    source, target = pair.source, pair.target
    if source.schema[pair.key].dataType != target.schema[pair.key].dataType:
        as_text = canonical_text(F.col(quoted(pair.key)))
        source, target = (df.withColumn(pair.key, as_text) for df in (source, target))
    return source, target


# names of the aligned columns, chosen not to meet a table's own
S, T, S_ROWS, T_ROWS = "source__", "target__", "source_rows__", "target_rows__"
#: Kinds of rows that cannot be paired by key: the key is repeated on a side, or NULL.
DUPLICATE_KEY, NULL_KEY = "DUPLICATE_KEY", "NULL_KEY"


def _value(side: str, column: str) -> Column:
    return F.col(side).getField(column)


def key_counts(pair: TablePair) -> DataFrame:
    """Rows of each side per key, NULL included. Narrow and fixed-width: a hash aggregate that combines hot keys before the shuffle."""
    source, target = _keyed(pair)
    sides = [df.select(F.col(quoted(pair.key)), *[F.lit(n).cast("bigint").alias(c) for c, n in zip((S_ROWS, T_ROWS), ns)])
             for df, ns in ((source, (1, 0)), (target, (0, 1)))]
    return sides[0].unionByName(sides[1]).groupBy(quoted(pair.key)).agg(
        F.sum(S_ROWS).alias(S_ROWS), F.sum(T_ROWS).alias(T_ROWS))


def find_odd_keys(pair: TablePair) -> OddKeys:
    """Keys that a side repeats, and the NULL key, written to the shared folder: one pass over the key columns."""
    odd = key_counts(pair).where(F.col(quoted(pair.key)).isNull() | (F.col(S_ROWS) > 1) | (F.col(T_ROWS) > 1))
    return OddKeys(*written(odd, "odd-keys"))


def checked(pairs: Sequence[TablePair], at_once: int = 4) -> list[TablePair]:
    """The pairs with their odd keys looked for, several pairs side by side. Comparisons of an unchecked pair do it each time."""
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(lambda p: p if p.odd_keys else replace(p, odd_keys=find_odd_keys(p)), pairs))


def align(pair: TablePair, columns: Sequence[str]) -> DataFrame:
    """One row per key: the key, the listed columns of either side as structs (NULL where absent), and both row counts.

    Keys that are repeated on a side, and the NULL key, cannot say which rows belong together. They have one row with
    their counts and neither struct, so nothing is thrown away or multiplied; all other rows are joined on the key.
    A narrow pass looks for such keys first (``checked`` does so ahead, for several comparisons). Where there are none, as
    usual, one outer join of both sides is all that follows.
    """
    source, target = _keyed(pair)
    key, odd = quoted(pair.key), pair.odd_keys or find_odd_keys(pair)

    def packed(df: DataFrame, name: str) -> DataFrame:
        # the key is part of the struct, so that it is not NULL even for an all-NULL row
        fields = [F.col(quoted(c)) for c in dict.fromkeys((pair.key, *columns)) if c in df.columns]
        rows = df.select(F.col(key), F.struct(*fields).alias(name))
        if odd.count:
            rows = rows.where(F.col(key).isNotNull()).join(odd.rows.select(key), pair.key, "left_anti")
        return rows

    paired = packed(source, S).join(packed(target, T), pair.key, "full_outer").select(
        F.col(key), S, T, *[F.col(side).isNotNull().cast("bigint").alias(n) for side, n in ((S, S_ROWS), (T, T_ROWS))])
    if not odd.count:
        return paired
    none = [F.lit(None).cast(paired.schema[side].dataType).alias(side) for side in (S, T)]
    return paired.unionByName(odd.rows.select(F.col(key), *none, S_ROWS, T_ROWS))


def _unpaired(pair: TablePair) -> Column:
    """Why a row of ``align`` has no pair of values, else NULL."""
    neither = F.col(S).isNull() & F.col(T).isNull()
    return F.when(neither & F.col(quoted(pair.key)).isNull(), NULL_KEY).when(neither, DUPLICATE_KEY)


def _differs(pair: TablePair, column: str) -> Column:
    return values_differ(
        _value(S, column), _value(T, column), pair.source.schema[column].dataType, pair.target.schema[column].dataType)


def _label(pair: TablePair, column: str) -> Column:
    """Kind of difference, NULL where the values are equal."""
    kind = classify_diff(
        column, _value(S, column), _value(T, column), pair.source.schema[column].dataType, pair.target.schema[column].dataType)
    return F.when(_differs(pair, column), kind)


def _cells(columns: Sequence[str], value_name: str) -> Column:
    return F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).alias(value_name)) for c in columns]))


def value_diffs(pair: TablePair, columns: Sequence[str] | None = None) -> DataFrame:
    """Every differing value: key text, column, both texts and the kind. The source side drives.

    A repeated or NULL key is one row on the key column, with the rows of both sides as its values.
    """
    columns = list(columns or pair.shared_columns())
    cells = [F.struct(
        F.lit(c).alias("column_name"), _value(S, c).cast("string").alias("source_value"),
        _value(T, c).cast("string").alias("target_value"), _label(pair, c).alias("diff_type")) for c in columns]
    whole = F.struct(F.lit(pair.key).alias("column_name"), F.col(S_ROWS).cast("string").alias("source_value"),
                     F.col(T_ROWS).cast("string").alias("target_value"), _unpaired(pair).alias("diff_type"))
    listed = F.when(_unpaired(pair).isNotNull(), F.array(whole)).otherwise(F.array(*cells))
    return (
        align(pair, columns).filter(F.col(S_ROWS) > 0)
        .select(F.lit(pair.name).alias("table_name"), canonical_text(F.col(quoted(pair.key))).alias("pk"), F.inline(listed))
        .filter(F.col("diff_type").isNotNull())
    )


def _window(pair: TablePair, columns: Sequence[str], window_rows: int) -> TablePair:
    """Both sides cut to their first rows by key."""
    names = [quoted(c) for c in dict.fromkeys((pair.key, *columns))]
    cut = [df.select(*names).orderBy(quoted(pair.key)).limit(window_rows) for df in (pair.source, pair.target)]
    return TablePair(pair.name, pair.key, *cut)


def sample_diff(pair: TablePair, column: str, limit: int = 10, window_rows: int | None = None) -> DataFrame:
    """The first ``limit`` differing rows of a column, by key text.

    A column that only one side has yields the first rows by key with the other value NULL.
    ``window_rows`` first cuts each side to that many rows by key; the default compares all rows.
    """
    source_only = column not in pair.target.columns
    target_only = column not in pair.source.columns
    if source_only and target_only:
        raise ValueError(f"{pair.name} has no column {column!r} on either side")
    if source_only or target_only:
        side = pair.source if source_only else pair.target
        value, absent = canonical_text(F.col(quoted(column))), F.lit(None).cast("string")
        rows = side.orderBy(quoted(pair.key)).limit(limit)
        return rows.select(
            F.lit(pair.name).alias("table_name"), canonical_text(F.col(quoted(pair.key))).alias("pk"),
            F.lit(column).alias("column_name"),
            (value if source_only else absent).alias("source_value"),
            (absent if source_only else value).alias("target_value"),
            F.lit("MISSING_COLUMN" if source_only else "EXTRA_COLUMN").alias("diff_type"))
    if window_rows is not None:
        pair = _window(pair, [column], window_rows)
    return value_diffs(pair, [column]).orderBy("pk").limit(limit)


def count_affected(pair: TablePair, columns: Sequence[str] | None = None, window_rows: int | None = None) -> DataFrame:
    """Per column: shared keys whose values differ, source keys without a target row, and rows without a usable key.

    ``window_rows`` counts within the first rows of each side by key, as ``sample_diff`` compares them.
    """
    columns = list(columns or pair.shared_columns())
    pair = pair if window_rows is None else _window(pair, columns, window_rows)
    unpaired = _unpaired(pair).isNotNull()
    affected = [F.sum(F.when(unpaired, F.col(S_ROWS)).when(F.col(T).isNull() | _differs(pair, c), 1).otherwise(0)).alias(c)
                for c in columns]
    totals = align(pair, columns).filter(F.col(S_ROWS) > 0).agg(*affected)
    zeros = totals.select(*[F.coalesce(F.col(quoted(c)), F.lit(0)).cast("bigint").alias(c) for c in columns])
    return zeros.select(F.lit(pair.name).alias("table_name"), _cells(columns, "affected_rows"))


def _label_counts(pair: TablePair, columns: Sequence[str]) -> DataFrame:
    """Rows per column and kind of difference. Cells combine in each task to one row per column and kind before the shuffle.

    ``MISSING_ROW`` is a lost row whose value was NULL, which is no difference in value. Rows whose key is repeated or
    NULL count under that kind in every column.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(
        _unpaired(pair), _label(pair, c), F.when(F.col(T).isNull(), "MISSING_ROW")).alias("diff_type")) for c in columns])
    rows = align(pair, columns).filter(F.col(S_ROWS) > 0).select(S_ROWS, F.inline(cells)).filter(F.col("diff_type").isNotNull())
    return rows.groupBy("column_name", "diff_type").agg(F.sum(S_ROWS).alias("row_count")).select(
        F.lit(pair.name).alias("table_name"), "column_name", "diff_type", "row_count")


def diff_type_summary(pair: TablePair, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of differing values per column and kind over the whole table."""
    counts = _label_counts(pair, list(columns or pair.shared_columns()))
    return counts.filter(F.col("diff_type") != "MISSING_ROW")


def sampled_totals(pair: TablePair, columns: Sequence[str], window_rows: int | None = None) -> DataFrame:
    """Affected rows and prevailing kind per column, for columns that may exist on one side only.

    A column that one side lacks affects all rows in which the other has a value. All shared columns take one
    alignment, all one-sided ones of a side one scan. ``window_rows`` counts shared columns as in ``count_affected``.
    """
    shared = [c for c in columns if c in pair.source.columns and c in pair.target.columns]
    missing = [c for c in columns if c not in pair.target.columns]
    extra = [c for c in columns if c not in pair.source.columns]
    name = F.lit(pair.name).alias("table_name")
    parts = []
    if shared:
        parts.append(_label_counts(pair if window_rows is None else _window(pair, shared, window_rows), shared))
    for side, one_sided, kind in ((pair.source, missing, "MISSING_COLUMN"), (pair.target, extra, "EXTRA_COLUMN")):
        if one_sided:
            held = side.agg(*[F.count(F.col(quoted(c))).alias(c) for c in one_sided])
            parts.append(held.select(name, _cells(one_sided, "row_count"), F.lit(kind).alias("diff_type")))
    return reduce(DataFrame.unionByName, parts).groupBy("table_name", "column_name").agg(
        F.sum("row_count").alias("affected_rows"),
        F.max_by("diff_type", F.struct("row_count", "diff_type")).alias("diff_type"))


def row_status(pair: TablePair, columns: Sequence[str] | None = None) -> DataFrame:
    """Every key with MATCH, CHANGED, SOURCE_ONLY, TARGET_ONLY, DUPLICATE_KEY or NULL_KEY."""
    return _status(pair, columns).select(quoted(pair.key), "row_status")


def _status(pair: TablePair, columns: Sequence[str] | None) -> DataFrame:
    columns = list(columns or pair.shared_columns())
    changed = reduce(lambda a, b: a | b, [_differs(pair, c) for c in columns], F.lit(False))
    status = (
        F.when(F.col(T).isNull(), "SOURCE_ONLY").when(F.col(S).isNull(), "TARGET_ONLY")
        .when(changed, "CHANGED").otherwise("MATCH")
    )
    return align(pair, columns).withColumn("row_status", F.coalesce(_unpaired(pair), status))


def row_status_counts(pair: TablePair, columns: Sequence[str] | None = None) -> DataFrame:
    return (
        row_status(pair, columns).groupBy("row_status").agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(pair.name).alias("table_name"), "row_status", "row_count")
    )


def row_status_rows(pair: TablePair, columns: Sequence[str] | None = None) -> DataFrame:
    """Keys and rows of either side per status; shows what repeated keys hide."""
    return _status(pair, columns).groupBy("row_status").agg(
        F.count(F.lit(1)).alias("key_count"), F.sum(S_ROWS).alias("source_rows"), F.sum(T_ROWS).alias("target_rows"))


def missing_keys(pair: TablePair) -> DataFrame:
    """Source rows whose key the target lacks: the rows to backfill."""
    source, target = _keyed(pair)
    return source.join(target.select(quoted(pair.key)).distinct(), pair.key, "left_anti")


def extra_keys(pair: TablePair) -> DataFrame:
    """Target rows whose key the source lacks."""
    source, target = _keyed(pair)
    return target.join(source.select(quoted(pair.key)).distinct(), pair.key, "left_anti")


def common_keys(pair: TablePair) -> DataFrame:
    """Distinct keys present on both sides."""
    source, target = _keyed(pair)
    key = quoted(pair.key)
    tagged = source.select(key, F.lit(1).alias("in_source__"), F.lit(0).alias("in_target__")).unionByName(
        target.select(key, F.lit(0).alias("in_source__"), F.lit(1).alias("in_target__")))
    return tagged.groupBy(key).agg(F.max("in_source__").alias("in_source__"), F.max("in_target__").alias("in_target__")).filter(
        (F.col("in_source__") == 1) & (F.col("in_target__") == 1)).select(key)


def first_n_by_key(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(quoted(key)).limit(n)


def ts_offset_profile(pair: TablePair, columns: Sequence[str]) -> DataFrame:
    """How far target timestamps lie from the source, in seconds, and each offset's share.

    One offset for nearly all rows is a clock or zone error; many offsets are stale rows.
    """
    offsets = F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 F.timestamp_diff("SECOND", _value(S, c), _value(T, c)).alias("offset_seconds")) for c in columns])
    counts = (
        align(pair, list(columns)).select(F.inline(offsets)).filter(F.col("offset_seconds").isNotNull())
        .groupBy("column_name", "offset_seconds").agg(F.count(F.lit(1)).alias("row_count"))
    )
    totals = counts.groupBy("column_name").agg(F.sum("row_count").alias("total"))  # one row per listed column
    return counts.join(F.broadcast(totals), "column_name").select(
        F.lit(pair.name).alias("table_name"), "column_name", "offset_seconds", "row_count",
        F.bround(F.col("row_count") / F.col("total"), 4).alias("share"))
