"""Upserts that read and write only the touched parts of a table kept as Parquet in hash partitions of its key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from driftwarden.functions.names import quoted
from driftwarden.operators.load import DuplicateKeyError
from driftwarden.session import scratch_path, written

PART = "key_part__"


class NotPartitionedError(ValueError):
    """The path holds a table that was not written by ``create``, or one with other columns than the batch."""


@dataclass(frozen=True)
class PartitionedTable:
    """A table in ``parts`` hash partitions of its key. The same key and number of parts must be given every time."""

    path: str
    key: str
    parts: int
    files: int = 1  # of each partition; more for partitions that are too large for one task

    def part_of(self) -> Column:
        """A row's partition; a NULL key has one like any other."""
        key = F.col(quoted(self.key))
        return F.pmod(F.xxhash64(key.cast("string"), key.isNull()), F.lit(self.parts)).cast("int")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows as the files of their partitions are written."""
        key = F.col(quoted(self.key))
        return rows.repartition(PART, F.pmod(F.xxhash64(key.cast("string"), F.lit("file")), F.lit(self.files)))


@dataclass(frozen=True)
class UpsertCounts:
    rows_staged: int
    rows_inserted: int
    rows_updated: int
    rows_kept: int  # current rows of the touched partitions that the batch leaves as they are
    parts_touched: int


def create(df: DataFrame, table: PartitionedTable) -> None:
    """Write a table so that it can be upserted by partition."""
    table.dealt(df.withColumn(PART, table.part_of())).write.mode("overwrite").partitionBy(PART).parquet(table.path)


def read(spark: SparkSession, table: PartitionedTable) -> DataFrame:
    """The table without its partition column."""
    return _stored(spark, table).drop(PART)


def _stored(spark: SparkSession, table: PartitionedTable) -> DataFrame:
    stored = spark.read.parquet(table.path)
    if PART not in stored.columns:
        raise NotPartitionedError(f"{table.path} is not partitioned by {PART}")
    return stored


def merged(stored: DataFrame, batch: DataFrame, table: PartitionedTable, touched: list[int]) -> DataFrame:
    """The touched partitions after the batch, with ``kind``: inserted, updated or kept. One join, of the touched rows only.

    ``touched`` is a filter on the partition column, so the other partitions are not even listed for reading.
    """
    key = quoted(table.key)
    names = [c for c in stored.columns if c != PART]
    current = stored.where(F.col(PART).isin(touched)).select(
        F.col(key).alias("current_key__"), F.col(PART).alias("current_part__"), F.struct(*map(quoted, names)).alias("current__"))
    staged = batch.select(F.col(key).alias("staged_key__"), F.col(PART), F.struct(*map(quoted, names)).alias("staged__"))
    same = (F.col("current_part__") == F.col(PART)) & F.col("current_key__").eqNullSafe(F.col("staged_key__"))
    both = current.join(staged, same, "full_outer")
    kind = F.when(F.col("current__").isNull(), "inserted").when(F.col("staged__").isNull(), "kept").otherwise("updated")
    row = F.coalesce("staged__", "current__")
    return both.select(F.coalesce(F.col(PART), F.col("current_part__")).alias(PART), kind.alias("kind__"), row.alias("row__")).select(
        PART, "kind__", *[F.col("row__").getField(c).alias(c) for c in names])


def upsert(staged: DataFrame, table: PartitionedTable) -> UpsertCounts:
    """Replace or add the rows of a batch in place. Only partitions that the batch has keys of are read and written.

    The batch is written first, so that it is one and the same for its checks and the load; a key that it repeats fails the upsert
    before the table is touched. The list of touched partitions has at most ``parts`` numbers. Spark's dynamic overwrite writes the new
    partitions aside and moves them in when all are complete, so a job that fails before changes nothing, and one that dies while
    moving is mended by running the same batch again: an upsert repeated gives the same table. Columns must be those of the table, in any order; an empty batch changes nothing.
    """
    spark = staged.sparkSession
    stored = _stored(spark, table)
    names = [c for c in stored.columns if c != PART]
    if sorted(names) != sorted(staged.columns):
        raise NotPartitionedError(f"the table has columns {names}, the batch {staged.columns}")
    aligned = staged.select(*[F.col(quoted(c)).cast(stored.schema[c].dataType).alias(c) for c in names]).withColumn(PART, table.part_of())
    batch, rows = written(aligned, "upsert-batch")
    per_key = batch.groupBy(PART, quoted(table.key)).agg(F.count(F.lit(1)).alias("n"))
    parts = per_key.groupBy(PART).agg(F.max("n").alias("most")).collect()  # a row per partition
    if any(p.most > 1 for p in parts):
        raise DuplicateKeyError(f"key {table.key} is not unique in the batch")
    if not rows:
        return UpsertCounts(0, 0, 0, 0, 0)
    seen = Observation()
    result = merged(stored, batch, table, sorted(p[PART] for p in parts)).observe(
        seen, *[F.count_if(F.col("kind__") == k).alias(k) for k in ("inserted", "updated", "kept")])
    table.dealt(result.drop("kind__")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(table.path)
    return UpsertCounts(rows, *[seen.get[k] for k in ("inserted", "updated", "kept")], len(parts))


def new_table(spark: SparkSession, key: str, parts: int, purpose: str = "partitioned") -> PartitionedTable:
    """A table at a fresh path of the shared folder."""
    return PartitionedTable(scratch_path(spark, purpose), key, parts)
