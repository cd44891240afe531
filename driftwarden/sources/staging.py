"""Staged Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stage_extract(df: DataFrame, path: str) -> int:
    """Write a table to staging and return its row count, both from one pass over the source."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def read_stage(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read a staged table; a given schema is enforced and saves the schema-inference job."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def stage_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Stage as a catalog table bucketed by key.

    Both versions of a table staged with the same bucket count are compared without a shuffle.
    """
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def publish_table(spark: SparkSession, name: str, path: str) -> None:
    """Point a catalog table at a finished version in one metastore step.

    A load writes a new version beside the current one and publishes it only when complete, so
    a failed load leaves readers on the version they had.
    """
    path = path.replace("\\", "\\\\").replace("'", "\\'")  # as a SQL string
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        spark.catalog.refreshTable(name)
    else:
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
