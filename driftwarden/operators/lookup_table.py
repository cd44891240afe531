"""Which rows differ between two versions of a table, read off a table of sums: an invertible Bloom lookup table.

Every row is an item: the hash of its key and the hash of its compared values. A cell keeps three things of the items it
holds: their number, the sum of their hashes, and the sum of a check over both hashes; a row of the source counts +1, a row
of the target -1, so rows that both sides have cancel out. An item lies in one cell of each of three sub-tables. The cells
are an ordinary aggregate: they combine in each task, and no row is shuffled, only cells.

What is left is peeled: a cell whose sums are n times one item with the right check holds just that item, n copies of it.
It is noted and taken out of its two other cells, which may leave these with one item too, and so on. A table with a third
more cells than differing rows peels to the end with overwhelming probability; then the differing rows are known exactly
(as hashes). If it does not, the next size is tried. Beyond the last, rows are counted per pair of hashes instead, which
shuffles two hashes for every row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.config import TablePair
from driftwarden.functions.fingerprint import digest
from driftwarden.functions.names import quoted
from driftwarden.operators.row_recon import comparable
from driftwarden.session import written

#: Cells of the tables tried in turn. Each task passes on at most so many partial rows.
CELLS = (1 << 14, 1 << 20)
SUB_TABLES = 3
#: Differing keys up to which the list is broadcast to the tables whose keys are looked up.
BROADCAST_KEYS = 100_000

# a 64-bit hash in three pieces, so that sums of them stay exact up to 2^41 rows
_SHIFTS, _MASK = (0, 22, 44), (1 << 22) - 1
_SUMS = [f"{part}{i}" for part in "krc" for i in range(len(_SHIFTS))]


@dataclass(frozen=True)
class Differences:
    """``items``: (key_hash, row_hash, surplus), surplus > 0 for rows the source has more often, < 0 for the target; and how they were found."""

    items: DataFrame
    count: int
    method: str


def _hashed(pair: TablePair, columns: Sequence[str]) -> DataFrame:
    """(n, k, r) of every row of both sides: +1 or -1, the hash of its key, the hash of its key and values."""
    def side(df: DataFrame, n: int) -> DataFrame:
        values = [comparable(pair, c) for c in columns]
        return df.select(F.lit(n).cast("bigint").alias("n"), digest([comparable(pair, pair.key)]).alias("k"),
                         digest([comparable(pair, pair.key), *values]).alias("r"))

    return side(pair.source, 1).unionByName(side(pair.target, -1))


def _check(k: Column, r: Column) -> Column:
    return F.xxhash64(k, r, F.lit("check"))


def _places(k: Column, r: Column, cells: int) -> Column:
    """The item's cells, one in each sub-table."""
    size = -(-cells // SUB_TABLES)
    return F.array(*[F.pmod(F.xxhash64(k, r, F.lit(j)), F.lit(size)) + j * size for j in range(SUB_TABLES)])


def _summed(items: DataFrame, cells: int, sign: int = 1) -> DataFrame:
    """Items (n, k, r) as parts of cells: (cell, n, sums)."""
    n, k, r = (F.col(c) for c in "nkr")
    pieces = [(F.shiftrightunsigned(h, s).bitwiseAND(F.lit(_MASK)) * n * sign).alias(f"{part}{i}")
              for part, h in (("k", k), ("r", r), ("c", _check(k, r))) for i, s in enumerate(_SHIFTS)]
    return items.select((n * sign).alias("n"), *pieces, F.explode(_places(k, r, cells)).alias("cell"))


def _cells(parts: DataFrame) -> DataFrame:
    """Parts added up per cell; cells in which everything cancels are left out."""
    totals = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", *_SUMS)])
    return totals.where(" OR ".join(f"{c} <> 0" for c in ("n", *_SUMS)))


def lookup_table(pair: TablePair, columns: Sequence[str], cells: int) -> DataFrame:
    """The non-zero cells of source minus target. Empty if both sides hold the same rows, each equally often."""
    return _cells(_summed(_hashed(pair, columns), cells))


def _single_items(table: DataFrame, cells: int) -> DataFrame:
    """(n, k, r) of the items that have a cell to themselves."""
    whole = " AND ".join(f"{c} % m = 0 AND {c} div m BETWEEN 0 AND {_MASK}" for c in _SUMS)
    joined = lambda part: " | ".join(f"shiftleft({part}{i} div m, {s})" for i, s in enumerate(_SHIFTS))
    items = table.withColumn("m", F.expr("nullif(n, 0)")).where(whole).selectExpr(
        "cell", "n", *[f"{joined(part)} AS {part}" for part in "krc"])
    alone = (F.col("c") == _check(F.col("k"), F.col("r"))) & F.array_contains(_places(F.col("k"), F.col("r"), cells), F.col("cell"))
    return items.where(alone).select("n", "k", "r").distinct()


def peel(table: DataFrame, cells: int) -> tuple[list[DataFrame], int]:
    """The items of a written table of cells, round by round, and how many cells could not be resolved (0: all were).

    Every round takes out at least one item; with enough cells a handful of rounds takes out all.
    """
    found, left = [], None
    while True:
        items, count = written(_single_items(table, cells), "peeled-items")
        if not count:
            return found, table.count() if left is None else left
        found.append(items)
        parts = _summed(items, cells, -1)
        table, left = written(_cells(table.unionByName(parts.select(table.columns))), "lookup-table")
        if not left:
            return found, 0


def _named(items: DataFrame) -> DataFrame:
    return items.select(F.col("k").alias("key_hash"), F.col("r").alias("row_hash"), F.col("n").alias("surplus"))


def differences(pair: TablePair, columns: Sequence[str] | None = None, cells: Sequence[int] = CELLS) -> Differences:
    """The rows that one side has more often than the other, as hashes; keys and the listed columns are compared.

    Tables of ``cells`` are tried in turn, then rows are counted per pair of hashes. Repeated rows count: three copies against
    one are a surplus of two. NULL keys are a key like any other here.
    """
    columns = list(pair.shared_columns() if columns is None else columns)
    for size in cells:
        table, used = written(lookup_table(pair, columns, size), "lookup-table")
        found, left = peel(table, size) if used else ([], 0)
        if not left:
            items = reduce(DataFrame.unionByName, found) if found else _hashed(pair, columns).limit(0)
            items, count = written(items, "differences")
            return Differences(_named(items), count, f"lookup table of {size} cells")
    counted = _hashed(pair, columns).groupBy("k", "r").agg(F.sum("n").alias("n")).where("n <> 0")
    items, count = written(counted, "differences")
    return Differences(_named(items), count, "counts per row hash")


def _key_side(pair: TablePair, df: DataFrame, source: int) -> DataFrame:
    key = comparable(pair, pair.key)
    return df.select(key.alias(pair.key), digest([key]).alias("key_hash"), F.lit(source).cast("bigint").alias("s__"),
                     F.lit(1 - source).cast("bigint").alias("t__"))


def differing_keys(pair: TablePair, columns: Sequence[str] | None = None, cells: Sequence[int] = CELLS) -> DataFrame:
    """Every key under which rows differ: its status, its rows on either side, and how many of them the other side lacks.

    ``SOURCE_ONLY`` and ``TARGET_ONLY`` keys exist on one side, ``CHANGED`` ones on both. The keys behind the hashes are looked
    up in a second pass over the key columns alone. A key under which nothing differs is listed only if its 64-bit hash
    equals that of a differing one.
    """
    return _keys_of(pair, differences(pair, columns, cells))


def _keys_of(pair: TablePair, found: Differences) -> DataFrame:
    surplus = F.col("surplus")
    wanted = found.items.groupBy("key_hash").agg(
        F.sum(F.greatest(surplus, F.lit(0))).alias("source_surplus"), F.sum(F.greatest(-surplus, F.lit(0))).alias("target_surplus"))
    if found.count <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    sides = _key_side(pair, pair.source, 1).unionByName(_key_side(pair, pair.target, 0))
    key = quoted(pair.key)
    per_key = sides.join(wanted, "key_hash").groupBy(key).agg(
        F.sum("s__").alias("source_rows"), F.sum("t__").alias("target_rows"), F.max("source_surplus").alias("source_surplus"),
        F.max("target_surplus").alias("target_surplus"))
    status = F.when(F.col("target_rows") == 0, "SOURCE_ONLY").when(F.col("source_rows") == 0, "TARGET_ONLY").otherwise("CHANGED")
    return per_key.select(key, status.alias("row_status"), "source_rows", "target_rows", "source_surplus", "target_surplus")


def narrow_to_differing(pair: TablePair, columns: Sequence[str] | None = None, cells: Sequence[int] = CELLS) -> TablePair:
    """The pair cut to the rows under differing keys, for a comparison by value that moves no other row."""
    found = differences(pair, columns, cells)
    wanted = found.items.select(F.col("key_hash").alias("key_hash__")).distinct()
    if found.count <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    hashed = digest([comparable(pair, pair.key)]) == F.col("key_hash__")
    source, target = (df.join(wanted, hashed, "left_semi") for df in (pair.source, pair.target))
    return TablePair(pair.name, pair.key, source, target)
