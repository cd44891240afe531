"""Which row of one side belongs to which of the other where a key does not say it: pairing of rows under repeated keys.

1. Rows are counted by key and content, +1 for the source and -1 for the target, combined in each task. Rows that both sides
   have cancel out; what is left of a key are the rows its sides hold more often.
2. These are paired so that as few columns as possible differ in all (a minimum-cost assignment); rows without a partner are
   lost or gained. Pairs are found for one key at a time, of which a task needs only a hash per column and row.
3. A key with more rows left than ``MOST_ROWS`` on a side does not go to one task. Its rows that agree in all but one column
   are paired first, by numbers in groups of such rows; the rest are ranked by value over the whole cluster, and ranks are
   cut into blocks of ``MOST_ROWS``, each paired by itself. No row is left out and as many are paired as can be, but their
   differing columns are fewest block by block rather than for the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.config import TablePair
from driftwarden.functions.fingerprint import digest
from driftwarden.functions.names import quoted
from driftwarden.operators.row_recon import comparable
from driftwarden.operators.value_diff import checked
from driftwarden.session import written

#: Rows of a side that one assignment takes; its work grows with their cube.
MOST_ROWS = 200
#: Keys up to which a list of them is broadcast.
BROADCAST_KEYS = 100_000

PAIRS_DDL = "s_digest long, s_copy int, t_digest long, t_copy int"


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs that cost least in all, as many as the shorter side has.

    Rows are added one by one; each takes the cheapest chain of reassignments to a free column (potentials keep all
    reduced costs at zero or more).
    """
    if cost.shape[0] > cost.shape[1]:
        columns, rows = assignment(cost.T)
        return rows, columns
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # of each column; the last column stands for the row being added
    for row in range(n):
        owner[m], here = row, m
        nearest, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m + 1, bool)
        while owner[here] >= 0:
            done[here] = True
            reduced = cost[owner[here]] - row_price[owner[here]] - column_price[:m]
            better = ~done[:m] & (reduced < nearest)
            nearest[better], before[better] = reduced[better], here
            following = int(np.argmin(np.where(done[:m], np.inf, nearest)))
            step = nearest[following]
            reached = np.flatnonzero(done)
            row_price[owner[reached]] += step
            column_price[reached] -= step
            nearest[~done[:m]] -= step
            here = following
        while here != m:
            owner[here] = owner[before[here]]
            here = before[here]
    taken = np.flatnonzero(owner[:m] >= 0)
    order = np.argsort(owner[taken])
    return owner[taken][order], taken[order]


def _paired(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one group; among equal costs the order of digests decides, so reruns agree."""
    group = group.sort_values(["digest", "copy"])
    s, t = group[group["surplus"] > 0], group[group["surplus"] < 0]
    if s.empty or t.empty:
        return pd.DataFrame(columns=["s_digest", "s_copy", "t_digest", "t_copy"])
    cost = (np.stack(s["hashes"].tolist())[:, None, :] != np.stack(t["hashes"].tolist())[None, :, :]).sum(axis=2)
    i, j = assignment(cost.astype(float))
    return pd.DataFrame({"s_digest": s["digest"].to_numpy()[i], "s_copy": s["copy"].to_numpy()[i],
                         "t_digest": t["digest"].to_numpy()[j], "t_copy": t["copy"].to_numpy()[j]})


def surplus_rows(pair: TablePair, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """(key, digest, surplus, matched, values, hashes) of every distinct row under ``keys``; a row that both sides have equally often has surplus 0."""
    def side(df: DataFrame, sign: int) -> DataFrame:
        key, values = comparable(pair, pair.key), [comparable(pair, c).alias(c) for c in columns]
        rows = df.where(F.col(quoted(pair.key)).isNotNull()).select(
            key.alias("key__"), digest([key, *[comparable(pair, c) for c in columns]]).alias("digest"), F.lit(sign).cast("long").alias("n"),
            F.struct(*values).alias("values"), F.array(*[digest([comparable(pair, c)]) for c in columns]).alias("hashes"))
        return rows.join(keys, "key__", "left_semi")

    both = side(pair.source, 1).unionByName(side(pair.target, -1))
    # the digest covers the key
    return both.groupBy("key__", "digest").agg(
        F.sum("n").alias("surplus"), F.least(F.count_if(F.col("n") > 0), F.count_if(F.col("n") < 0)).alias("matched"),
        F.first("values").alias("values"), F.first("hashes").alias("hashes"))


def _listed(keys: DataFrame, count: int) -> DataFrame:
    return F.broadcast(keys) if count <= BROADCAST_KEYS else keys


def _agree_but_one(left: DataFrame, column: int, columns: int, most_rows: int) -> DataFrame:
    """Pairs of rows under one key that differ in no column but this one, by their numbers in the group of such rows.

    In a group any two rows are a pair, so one larger than ``most_rows`` is dealt by hash into parts; what stays over in a part is
    left for later.
    """
    others = [F.col("hashes")[i] for i in range(columns) if i != column]
    rows = left.select("digest", "copy", "surplus", F.xxhash64("key__", *others).alias("group"))
    large, count = written(rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / most_rows).alias("parts")).where("parts > 1"), "large-groups")
    rows = rows.withColumn("part", F.lit(0).cast("long")) if not count else rows.join(_listed(large, count), "group", "left").withColumn(
        "part", F.coalesce(F.pmod("digest", "parts"), F.lit(0).cast("long")))
    order = Window.partitionBy("group", "part", F.col("surplus") > 0).orderBy("digest", "copy")
    rows = rows.withColumn("number", F.row_number().over(order))
    s = rows.where("surplus > 0").selectExpr("group", "part", "number", "digest AS s_digest", "copy AS s_copy")
    t = rows.where("surplus < 0").selectExpr("group", "part", "number", "digest AS t_digest", "copy AS t_copy")
    return s.join(t, ["group", "part", "number"]).select("s_digest", "s_copy", "t_digest", "t_copy")


def _in_blocks(left: DataFrame, most_rows: int) -> DataFrame:
    """Rows with a block: ranks by value of each key's side, computed in ranges of the whole table, in blocks of ``most_rows``."""
    side = (F.col("surplus") > 0).alias("of_source")
    ranged, _ = written(left.withColumn("of_source", side).repartitionByRange("key__", "of_source", "values", "digest", "copy").withColumn(
        "range", F.spark_partition_id()), "ranged-rows")
    held = ranged.groupBy("range", "key__", "of_source").agg(F.count(F.lit(1)).alias("rows"))  # few: large keys, and ranges
    before = F.sum("rows").over(Window.partitionBy("key__", "of_source").orderBy("range")) - F.col("rows")
    offsets = held.select("range", "key__", "of_source", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("range", "key__", "of_source").orderBy("values", "digest", "copy"))
    ranked = ranged.withColumn("inside", inside).join(offsets, ["range", "key__", "of_source"])
    return ranked.withColumn("block", F.xxhash64("key__", F.floor((F.col("before") + F.col("inside") - 1) / most_rows)))


def _without(left: DataFrame, pairs: DataFrame) -> DataFrame:
    gone = pairs.selectExpr("s_digest AS digest", "s_copy AS copy").unionByName(pairs.selectExpr("t_digest AS digest", "t_copy AS copy"))
    return left.join(gone, ["digest", "copy"], "left_anti")


def pair_rows(left: DataFrame, columns: int, most_rows: int = MOST_ROWS) -> list[DataFrame]:
    """Written pairs (s_digest, s_copy, t_digest, t_copy) of the rows ``left`` over (key__, digest, copy, surplus, values, hashes)."""
    of_source, of_target = F.count_if(F.col("surplus") > 0), F.count_if(F.col("surplus") < 0)
    sizes = left.groupBy("key__").agg(F.greatest(of_source, of_target).alias("most"), F.least(of_source, of_target).alias("least"))
    large, count = written(sizes.where(F.col("most") > most_rows), "large-keys")
    narrow = lambda rows: rows.select("block", "digest", "copy", "surplus", "hashes")
    assign = lambda rows: written(narrow(rows).groupBy("block").applyInPandas(_paired, PAIRS_DDL), "row-pairs")[0]
    # a key with rows on one side only has no pairs, and one row on each side is a pair without any choice
    sized, _ = written(left.join(sizes.where((F.col("least") > 0) & (F.col("most") <= most_rows)), "key__"), "rows-with-partners")
    of = lambda sign: F.max(F.when(F.signum("surplus") == sign, F.struct("digest", "copy")))
    single = sized.where("most = 1").groupBy("key__").agg(of(1).alias("s"), of(-1).alias("t")).selectExpr(
        "s.digest AS s_digest", "s.copy AS s_copy", "t.digest AS t_digest", "t.copy AS t_copy")
    found = [single, assign(sized.where("most > 1").withColumn("block", F.xxhash64("key__")))]
    if count:
        rest, _ = written(left.join(_listed(large.drop("least"), count), "key__"), "rows-of-large-keys")
        for column in range(columns):
            pairs, any_ = written(_agree_but_one(rest, column, columns, most_rows), "row-pairs")
            if any_:
                found.append(pairs)
                rest, _ = written(_without(rest, pairs), "rows-of-large-keys")
        found.append(assign(_in_blocks(rest, most_rows)))
    return found


def paired_rows(pair: TablePair, columns: Sequence[str] | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """Rows under keys that a side repeats: one line per pair or unpaired row, and one for all copies of a row that both sides have.

    Columns: the key, ``row_status`` (MATCH, CHANGED, SOURCE_ONLY, TARGET_ONLY), ``row_count`` (equal rows of a MATCH line, else 1),
    ``source_values`` and ``target_values`` (structs of the compared columns, NULL where there is no row) and ``changed_columns``.
    NULL keys are not paired (see ``value_diff.align``); unrepeated keys are left to the comparison by key. Rows are known by 64-bit hashes.
    """
    columns = list(pair.shared_columns() if columns is None else columns)
    pair = checked([pair])[0]
    # the join is on the text if the types differ, as in ``align``
    keys = pair.odd_keys.rows.where(F.col(quoted(pair.key)).isNotNull()).select(F.col(quoted(pair.key)).alias("key__"))
    rows, _ = written(surplus_rows(pair, columns, _listed(keys, pair.odd_keys.count)), "surplus-rows")
    copies = F.explode(F.sequence(F.lit(1), F.abs("surplus").cast("int"))).alias("copy")
    left, _ = written(rows.where("surplus <> 0").select("key__", "digest", "surplus", "values", "hashes", copies), "rows-to-pair")
    pairs = None
    for found in pair_rows(left, len(columns), most_rows):
        pairs = found if pairs is None else pairs.unionByName(found)
    s = left.where("surplus > 0").select(F.col("key__"), F.col("digest").alias("s_digest"), F.col("copy").alias("s_copy"), F.col("values").alias("source_values"))
    t = left.where("surplus < 0").select(F.col("key__").alias("t_key"), F.col("digest").alias("t_digest"), F.col("copy").alias("t_copy"), F.col("values").alias("target_values"))
    lines = s.join(pairs, ["s_digest", "s_copy"], "left").join(t, ["t_digest", "t_copy"], "full_outer")
    status = F.when(F.col("s_digest").isNull(), "TARGET_ONLY").when(F.col("t_digest").isNull() | F.col("target_values").isNull(), "SOURCE_ONLY").otherwise("CHANGED")
    changed = F.array_compact(F.array(*[F.when(~_field("source_values", c).eqNullSafe(_field("target_values", c)), c) for c in columns]))
    lines = lines.select(F.coalesce("key__", "t_key").alias("key__"), status.alias("row_status"), F.lit(1).cast("long").alias("row_count"),
                         "source_values", "target_values", F.when(status == "CHANGED", changed).alias("changed_columns"))
    equal = rows.where("matched > 0").select("key__", F.lit("MATCH").alias("row_status"), F.col("matched").alias("row_count"),
                                             F.col("values").alias("source_values"), F.col("values").alias("target_values"),
                                             F.lit(None).cast("array<string>").alias("changed_columns"))
    return equal.unionByName(lines).withColumnRenamed("key__", pair.key)


def _field(side: str, column: str) -> Column:
    return F.col(side).getField(column)
