"""Loading staged tables into target tables kept as Parquet versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from driftwarden.operators.checks import duplicate_keys


class DuplicateKeyError(ValueError):
    """A batch holds a key more than once, so it does not say which row is to be loaded."""


def project_to_target(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the columns the target expects, in its order."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"staged table lacks {absent}")
    return df.select(*columns)


def upsert_conflict_keys(staged: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once in a batch; such a batch cannot be upserted."""
    return duplicate_keys(staged, key)


def require_unique(staged: DataFrame, key: str | Sequence[str]) -> None:
    if not upsert_conflict_keys(staged, key).limit(1).isEmpty():
        raise DuplicateKeyError(f"key {key} is not unique in the batch")


def load_upsert(current: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """The target after the batch: staged rows replace or add, other current rows stay.

    The batch must have unique keys (``upsert_conflict_keys``). The larger current table is
    never aggregated; a batch small enough is broadcast by Spark itself.
    """
    return _not_staged(current, staged, key).unionByName(staged.select(current.columns))


def _not_staged(current: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    return current.join(staged.select(key), key, "left_anti").select(current.columns)


def write_upsert(current: DataFrame, staged: DataFrame, key: str, path: str) -> dict[str, int]:
    """Write the upserted table as a new version and report row counts, all in one pass.

    ``path`` belongs to one run: writing it again replaces what an earlier try has left there. It must not hold ``current``.
    """
    loaded, total = Observation(), Observation()
    rows = F.count(F.lit(1)).alias("rows")
    batch = staged.select(current.columns).observe(loaded, rows)
    result = _not_staged(current, staged, key).unionByName(batch).observe(total, rows)
    result.write.mode("overwrite").parquet(path)
    return {"rows_staged": loaded.get["rows"], "rows_upserted": loaded.get["rows"],
            "target_total": total.get["rows"]}


def write_overwrite(staged: DataFrame, path: str) -> dict[str, int | str]:
    """Write the batch as the whole new version of a table; like ``write_upsert``, replaces an earlier try of the run."""
    loaded = Observation()
    staged.observe(loaded, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return {"rows_loaded": loaded.get["rows"], "method": "overwrite"}


def upsert_metrics(current: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """What an upsert would do, without writing: staged, inserted, updated and resulting rows."""
    tagged = current.select(key, F.lit(1).alias("c"), F.lit(0).alias("s")).unionByName(
        staged.select(key, F.lit(0).alias("c"), F.lit(1).alias("s")))
    per_key = tagged.groupBy(key).agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    staged_key = F.col("s") > 0
    return per_key.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("rows_staged"),
        F.coalesce(F.sum(F.when(staged_key & (F.col("c") == 0), F.col("s"))), F.lit(0)).alias("rows_inserted"),
        F.coalesce(F.sum(F.when(staged_key & (F.col("c") > 0), F.col("s"))), F.lit(0)).alias("rows_updated"),
        F.coalesce(F.sum(F.when(staged_key, F.col("s")).otherwise(F.col("c"))), F.lit(0)).alias("target_total"))
