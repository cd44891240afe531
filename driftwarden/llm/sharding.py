"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitioning.

A row's key puts equal texts side by side (the upper bits hash the text) and spreads them inside their group (the lower
bits hash doc_id), so a text that fills a third of the corpus can be cut. A size-weighted sample of keys gives the
boundaries of many fine ranges. Exact sums of the ranges then place the shard boundaries; the range in which one falls is
overfull for its shard and is subdivided along its sorted rows. No range holds more than its share of the rows, no
matter how the texts repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftwarden.llm.common import by_shuffle, materialize, set_aside, text_hash

#: Fine ranges, and sampled keys per range. Their product bounds the sample, which the driver sorts.
RANGES, SAMPLES_PER_RANGE = 2048, 32
GROUP_BITS = 24
SEED = 99


def size_in_bytes(text: str = "text", overhead: int = 8) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead


def sort_key() -> Column:
    """Upper bits from the text, ``GROUP_BITS`` lower bits from doc_id."""
    low = (1 << GROUP_BITS) - 1
    return text_hash().bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.lit(SEED), "doc_id").bitwiseAND(F.lit(low)))


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, size, text_crc32)`` of every row, as a written table; the texts are read once."""
    return materialize(docs.select(
        "doc_id", sort_key().alias("key"), size_in_bytes().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")), "shard-keys")


def splitters(rows: DataFrame, ranges: int = RANGES, per_range: int = SAMPLES_PER_RANGE) -> np.ndarray:
    """Sorted boundaries of ``ranges`` ranges of about equal size, from a sample of about ``ranges * per_range`` keys.

    A row is drawn with a probability in proportion to its size, by a hash of its key (reruns agree); a row larger than
    the sampling step is always drawn and counts by its size.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    step = max(1, total // (ranges * per_range))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), "key"), 11) / F.lit(float(1 << 53))
    drawn = rows.where(unit * step < F.col("size")).select("key", F.greatest("size", F.lit(step)).alias("weight")).toPandas()
    keys, weights = drawn["key"].to_numpy(np.int64), drawn["weight"].to_numpy(np.float64)
    order = np.argsort(keys, kind="stable")
    along = np.cumsum(weights[order])
    if not len(along):
        return np.zeros(0, np.int64)
    return np.unique(keys[order][np.searchsorted(along, along[-1] * np.arange(1, ranges) / ranges)])


def with_range(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    names = rows.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(names.index("key")).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*names, "range"])

    return rows.mapInArrow(place, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", range int")


def assign(rows: DataFrame, shards: int, ranges: int = RANGES, per_range: int = SAMPLES_PER_RANGE) -> DataFrame:
    """``rows (doc_id, key, size, ...)``, a written table, with ``shard`` and ``slot`` (gapless from 0 in each shard).

    A row goes to the shard in which the middle of its bytes falls along the key order, so shards differ from an equal
    share by at most one row at each end. Rows alike in key follow doc_id; a NULL doc_id comes first; rows alike in both
    are interchangeable. An empty table gives no rows, and a table with fewer rows than shards leaves shards empty.
    """
    ranged = materialize(with_range(rows, splitters(rows, ranges, per_range)), "ranged")
    # one row per range: at most `ranges` rows, of which the windows make the starts of the ranges
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select(
        F.col("range").alias("range__"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start_bytes"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_row"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("start_bytes") + upto - F.col("size") / 2
    placed = ranged.join(F.broadcast(starts), F.expr("range = range__")).select(
        *rows.columns, F.least(F.floor(middle * shards / F.col("total")), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("start_row") + F.row_number().over(inside) - 1).alias("row__"))
    placed = materialize(placed, "placed")
    firsts = placed.groupBy(F.col("shard").alias("shard__")).agg(F.min("row__").alias("first__"))  # a row per shard
    return placed.join(F.broadcast(firsts), F.expr("shard = shard__")).select(
        *rows.columns, "shard", (F.col("row__") - F.col("first__")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, **params) -> None:
    """``docs`` as Parquet folders ``shard=N``, rows in slot order inside each written range of slots.

    The files hold the columns of ``docs`` and ``slot``, gapless from 0 in each shard. Rows alike in doc_id and text are
    numbered on both sides and meet one to one, so each has a slot of its own. Columns of ``docs`` named ``shard`` or ``slot``, in any
    case, raise; further columns may have any name.
    """
    taken = [c for c in docs.columns if c.lower() in ("shard", "slot")]
    if taken:
        raise ValueError(f"the written files have columns of these names: {taken}")
    rows = set_aside(docs)
    same = ["id__", "key__"]
    alike = Window.partitionBy(*same)
    placed = assign(measured(rows), shards, **params).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id__"), F.col("key").alias("key__"), "shard", "slot").withColumn(
        "rn__", F.row_number().over(alike.orderBy("shard", "slot")))
    keyed = rows.withColumns({"id__": F.coalesce("doc_id", F.lit(-(1 << 63))), "key__": sort_key()}).withColumn(
        "rn__", F.row_number().over(alike.orderBy(F.lit(1))))
    ordered = keyed.join(by_shuffle(placed), [*same, "rn__"]).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select(*rows.columns, "shard", "slot").toDF(*docs.columns, "shard", "slot").write.partitionBy("shard").parquet(path)
