"""What the rows that a target lost have in common: a beam search for conditions ``column = value AND ...``.

The source is read once, with a flag for rows whose key the target lacks. Only values that a share of the lost rows have can be
part of an answer, and there are few of those; a row is then the set of such values it has. Equal sets are counted, which
leaves a small table, and every level of the search is one aggregate over it: the conditions kept so far, each with one more
value of the same rows. A condition is scored by its weighted relative accuracy, the lost rows it has beyond its fair part:
``lost(c) / N - rows(c) / N * lost / N``. Of a level the best ``beam`` go on; one that is not better than what it extends is
not an answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.config import TablePair
from driftwarden.functions.names import orderable, quoted
from driftwarden.operators.row_recon import comparable
from driftwarden.session import written
from driftwarden.sources.local import small_frame

#: Share of the lost rows that a condition must hold for, conditions kept per level, values in a condition, answers.
LEAST_SHARE, BEAM, MOST_VALUES, ANSWERS = 0.05, 20, 3, 10
RESULT = """rank INT, conditions STRING, condition_count INT, row_count BIGINT, lost_rows BIGINT, loss_pct DOUBLE,
            lost_share_pct DOUBLE, lift DOUBLE"""


def flagged(pair: TablePair, columns: Sequence[str]) -> DataFrame:
    """The listed source columns as text (``n`` for NULL, else ``v`` and the text), and whether the target lacks the row's key.

    A NULL key is in no other table, so its rows are lost. A key that the target repeats does not multiply rows.
    """
    texts = [F.coalesce(F.concat(F.lit("v"), orderable(F.col(quoted(c)), pair.source.schema[c].dataType).cast("string")), F.lit("n")).alias(f"c{i}")
             for i, c in enumerate(columns)]
    held = pair.target.select(comparable(pair, pair.key).alias("key__")).distinct().withColumn("held__", F.lit(True))
    rows = pair.source.select(comparable(pair, pair.key).alias("key__"), *texts)
    return rows.join(held, "key__", "left").select(*[f"c{i}" for i in range(len(columns))], F.col("held__").isNull().alias("lost"))


def frequent_values(rows: DataFrame, columns: int, least_rows: int) -> list[tuple[int, str]]:
    """(column, text) of the values that at least ``least_rows`` lost rows have: no more than ``columns / LEAST_SHARE``."""
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"c{i}").alias("text")) for i in range(columns)]))
    counts = rows.where("lost").select(cells).groupBy("column", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows)
    return sorted((r.column, r.text) for r in counts.select("column", "text").collect())


def baskets(rows: DataFrame, values: Sequence[tuple[int, str]]) -> DataFrame:
    """(items, n, lost): rows counted by the numbers of the listed values that they have, in order."""
    found = []
    for i in sorted({c for c, _ in values}):
        numbers = F.create_map(*[x for n, (c, text) in enumerate(values) if c == i for x in (F.lit(text), F.lit(n))])
        found.append(F.try_element_at(numbers, F.col(f"c{i}")))
    items = F.array_compact(F.array(*found)) if found else F.array().cast("array<int>")
    return rows.groupBy(items.alias("items")).agg(F.count(F.lit(1)).alias("n"), F.count_if("lost").alias("lost"))


def _excess(n: Column, lost: Column, total: int, total_lost: int) -> Column:
    """The weighted relative accuracy times N squared, as an exact number."""
    wide = "decimal(19,0)"
    return (lost.cast(wide) * F.lit(total).cast(wide) - n.cast(wide) * F.lit(total_lost).cast(wide)).cast("decimal(38,0)")


def extended(counted: DataFrame, beam: Sequence[Sequence[int]]) -> DataFrame:
    """(items, n, lost) of every condition of the beam with one more value that some row has with it."""
    conditions = F.from_json(F.lit(str([list(b) for b in beam])), "array<array<int>>")
    held = F.filter(conditions, lambda b: F.size(F.array_except(b, "items")) == 0)
    longer = F.flatten(F.transform(held, lambda b: F.transform(F.array_except("items", b), lambda x: F.array_sort(F.concat(b, F.array(x))))))
    return counted.select(F.explode(F.array_distinct(longer)).alias("items"), "n", "lost").groupBy("items").agg(
        F.sum("n").alias("n"), F.sum("lost").alias("lost"))


def loss_patterns(pair: TablePair, columns: Sequence[str] | None = None, least_share: float = LEAST_SHARE, beam: int = BEAM,
                  most_values: int = MOST_VALUES, answers: int = ANSWERS) -> DataFrame:
    """The best conditions that set lost rows apart, best first.

    Columns: ``rank``, ``conditions`` (``column = value`` in column order; NULL is a value), ``condition_count``, ``row_count``, ``lost_rows``,
    ``loss_pct`` (of the rows under the condition), ``lost_share_pct`` (of all lost rows) and ``lift`` (loss against that of the
    table). ``columns`` defaults to all source columns but the key, so also to those that only the source has. No lost row, no
    answer. Equal scores are ordered by fewer values, then by column and text of the values. ``beam`` and ``answers`` bound the
    search and its report; all counts cover all rows.
    """
    columns = [c for c in pair.source.columns if c != pair.key] if columns is None else list(columns)
    spark = pair.source.sparkSession
    rows, total = written(flagged(pair, columns), "flagged-rows")
    lost = rows.where("lost").count()
    least = max(1, ceil(lost * Fraction(str(least_share))))
    values = frequent_values(rows, len(columns), least) if lost else []
    counted, _ = written(baskets(rows, values), "baskets")

    kept: list[tuple] = []
    scores: dict[tuple[int, ...], int] = {(): 0}
    for size in range(1, most_values + 1):
        grown = extended(counted, list(scores)).where(F.col("lost") >= least).withColumn("excess", _excess(F.col("n"), F.col("lost"), total, lost))
        best = grown.where("excess > 0").orderBy(F.col("excess").desc(), "items").limit(beam).collect()
        level = {tuple(r["items"]): int(r.excess) for r in best}
        for r in best:
            parents = [scores[p] for x in r["items"] if (p := tuple(i for i in r["items"] if i != x)) in scores]
            if r.excess > max(parents):
                kept.append((-int(r.excess), size, list(r["items"]), r.n, r.lost))
        if not level:
            break
        scores = level

    def text(item: int) -> str:
        column, value = values[item]
        return f"{columns[column]} IS NULL" if value == "n" else f"{columns[column]} = {value[1:]}"

    out = []
    for rank, (_, size, items, n, gone) in enumerate(sorted(kept)[:answers], 1):
        out.append((rank, " AND ".join(map(text, items)), size, n, gone, round(100 * gone / n, 2), round(100 * gone / lost, 2),
                    round(gone * total / (n * lost), 4)))
    return small_frame(spark, out, RESULT)
