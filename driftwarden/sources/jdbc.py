"""Database tables over JDBC. Thin by design; the driver jar comes from the cluster."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class JdbcEndpoint:
    host: str
    port: int
    database: str
    user: str
    password: str
    driver: str = "org.postgresql.Driver"
    fetch_size: int = 10_000
    batch_size: int = 10_000

    def options(self) -> dict[str, str]:
        return {
            "url": f"jdbc:postgresql://{self.host}:{self.port}/{self.database}",
            "user": self.user,
            "password": self.password,
            "driver": self.driver,
        }


def read_jdbc(spark: SparkSession, endpoint: JdbcEndpoint, table: str, partition_column: str | None = None,
              bounds: tuple | None = None, num_partitions: int | None = None) -> DataFrame:
    """Scan a table. With a partition column the range is read by many tasks instead of one."""
    reader = spark.read.format("jdbc").options(
        **endpoint.options(), dbtable=table, fetchsize=str(endpoint.fetch_size))
    if partition_column:
        if bounds is None or num_partitions is None:
            raise ValueError("a partitioned scan needs bounds and num_partitions")
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
            numPartitions=str(num_partitions))
    return reader.load()


def write_jdbc(df: DataFrame, endpoint: JdbcEndpoint, table: str, mode: str = "append",
               num_partitions: int | None = None) -> None:
    """Write rows; overwrite truncates and keeps the table definition. ``num_partitions`` bounds connections."""
    if num_partitions:
        df = df.coalesce(num_partitions)
    writer = df.write.format("jdbc").mode(mode).options(
        **endpoint.options(), dbtable=table, batchsize=str(endpoint.batch_size))
    if mode == "overwrite":
        writer = writer.option("truncate", "true")
    writer.save()


def merge_statement(table: str, staging_table: str, key: str, columns: Sequence[str]) -> str:
    """The upsert of a staged batch as one standard MERGE, for the database or a catalog that supports it."""
    assignments = ", ".join(f"{c} = s.{c}" for c in columns if c != key)
    values = ", ".join(f"s.{c}" for c in columns)
    return (
        f"MERGE INTO {table} t USING {staging_table} s ON t.{key} = s.{key} "
        f"WHEN MATCHED THEN UPDATE SET {assignments} "
        f"WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({values})"
    )
