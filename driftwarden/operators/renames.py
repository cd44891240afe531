"""Columns that only one side has, matched by what they hold: a renamed column instead of a missing and an extra one.

Each one-sided column gets two sketches of bounded size: the ``size`` least hashes among its distinct values, and its values
under the ``size`` keys with the least hashes, which are the same keys on both sides. The first estimates how alike the sets of
values are (Jaccard), the second under how many keys the values are the same; two flag columns may be alike in the first,
but not in the second. Columns are paired by the assignment with the greatest likeness in all. A column with no more distinct
values than ``size``, or a table with no more keys, is compared exactly.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.config import TablePair
from driftwarden.functions.names import orderable, quoted
from driftwarden.operators.row_pairing import assignment
from driftwarden.operators.row_recon import comparable
from driftwarden.sources.local import small_frame

SIZE, LEAST_LIKENESS = 1024, 0.5
_BITS = 53

RESULT = "table_name STRING, change STRING, source_column STRING, target_column STRING, value_overlap DOUBLE, key_agreement DOUBLE"


def _rank(value: Column) -> Column:
    """A hash as a whole number below 2^53."""
    return F.shiftrightunsigned(F.xxhash64(value, F.lit("rank")), 64 - _BITS)


def _least(rows: DataFrame, by: str, size: int) -> DataFrame:
    """The rows with the ``size`` least ``by`` of each column; ``rows`` has a small multiple of that."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("column").orderBy(by))).where(F.col("n") <= size).drop("n")


def sketches(pair: TablePair, df: DataFrame, columns: Sequence[str], size: int = SIZE) -> tuple[dict, dict]:
    """Per column the least value hashes, ascending, and ``{key hash: value hash}`` under the least keys (NULL values left out).

    A first pass counts rows and, roughly, distinct values; the second then keeps about twice as many hashes as are needed, so that no
    more than those are grouped, ranked and brought here: ``size`` per column.
    """
    texts = {c: orderable(F.col(quoted(c)), df.schema[c].dataType).cast("string") for c in columns}
    key = comparable(pair, pair.key).cast("string")
    about = df.agg(F.approx_count_distinct(key).alias("keys"), *[F.approx_count_distinct(texts[c]).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    limit = lambda distinct: F.lit(int(min(1.0, 2 * size / max(1, distinct)) * (1 << _BITS)))
    cells = df.where(key.isNotNull()).select(_rank(key).alias("key"), F.inline(F.array(*[F.struct(
        F.lit(i).alias("column"), _rank(texts[c]).alias("value"), texts[c].isNotNull().alias("held"), limit(about[f"c{i}"]).alias("below"))
        for i, c in enumerate(columns)])))
    values = cells.where("held AND value < below").select("column", "value").distinct()
    # the key's least ranks whether or not a column has a value there
    under = cells.where(F.col("key") < limit(about["keys"])).groupBy("column", "key").agg(F.min(F.when(F.col("held"), F.col("value"))).alias("value"))
    least, cell = defaultdict(list), defaultdict(dict)
    for r in _least(values, "value", size).orderBy("value").collect():
        least[columns[r["column"]]].append(r["value"])
    for r in _least(under, "key", size).collect():
        cell[columns[r["column"]]][r["key"]] = r["value"]
    return least, cell


def overlap(a: Sequence[int], b: Sequence[int], size: int = SIZE) -> float:
    """Estimated Jaccard likeness of two sets from their least hashes (ascending)."""
    reach = min((x[-1] for x in (a, b) if len(x) >= size), default=1 << _BITS)
    x, y = ({v for v in s if v <= reach} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def agreement(a: dict[int, int | None], b: dict[int, int | None]) -> float:
    """Share of the keys known of both columns under which they hold the same value, NULL included."""
    shared = a.keys() & b.keys()
    return sum(a[k] == b[k] for k in shared) / len(shared) if shared else 0.0


def beyond_chance(a: dict[int, int | None], b: dict[int, int | None]) -> float:
    """``agreement`` less what two columns with these values would have by chance, as a share of what is left (Cohen's kappa).

    Two unrelated flags agree under half of the keys; two columns of unrelated names under none. Equal constants count as agreeing.
    """
    shared = a.keys() & b.keys()
    held = [Counter(x[k] for k in shared) for x in (a, b)]
    chance = sum(n * held[1][v] for v, n in held[0].items()) / max(1, len(shared)) ** 2
    return agreement(a, b) if chance == 1 else (agreement(a, b) - chance) / (1 - chance)


def renamed_columns(pair: TablePair, size: int = SIZE, least_likeness: float = LEAST_LIKENESS) -> DataFrame:
    """One row per one-sided column, or pair of them: RENAMED with both measures, else MISSING or EXTRA.

    A pair counts if values overlap, and keys agree beyond chance, to ``least_likeness`` or more. Columns of NULLs alone are never paired. Only one-sided
    columns and the key are read, and none where just one side has such columns.
    """
    missing = sorted(c for c in pair.source.columns if c not in pair.target.columns)
    extra = sorted(c for c in pair.target.columns if c not in pair.source.columns)
    spark, out, taken = pair.source.sparkSession, [], set()
    if missing and extra:
        s_values, s_cells = sketches(pair, pair.source, missing, size)
        t_values, t_cells = sketches(pair, pair.target, extra, size)
        alike = {(a, b): (overlap(s_values[a], t_values[b], size), agreement(s_cells[a], t_cells[b])) for a in missing for b in extra}
        likeness = lambda a, b: (alike[a, b][0], beyond_chance(s_cells[a], t_cells[b]))
        good = np.array([[sum(likeness(a, b)) / 2 if min(likeness(a, b)) >= least_likeness else 0.0 for b in extra] for a in missing])
        for i, j in zip(*assignment(1 - good)):
            if good[i, j]:
                a, b = missing[i], extra[j]
                out.append((pair.name, "RENAMED", a, b, *(round(x, 4) for x in alike[a, b])))
                taken |= {("s", a), ("t", b)}
    out += [(pair.name, "MISSING", c, None, None, None) for c in missing if ("s", c) not in taken]
    out += [(pair.name, "EXTRA", None, c, None, None) for c in extra if ("t", c) not in taken]
    return small_frame(spark, out, RESULT)
