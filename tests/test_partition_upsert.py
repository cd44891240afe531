from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from driftwarden.operators import partition_upsert as pu
from driftwarden.operators.load import DuplicateKeyError
from tests.test_plans import plan_of

DDL = "k BIGINT, `a.b` STRING, v DOUBLE"


@pytest.fixture
def table(spark, tmp_path):
    made = pu.PartitionedTable(f"{tmp_path}/t", "k", 16, 2)
    pu.create(spark.createDataFrame([(i, f"old{i}", 1.0) for i in range(200)] + [(None, "null key", 0.0)], DDL), made)
    return made


def rows_of(spark, table):
    return {r[0]: (r[1], r[2]) for r in pu.read(spark, table).collect()}


def files(table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.path}/{pu.PART}=*/*.parquet")}


def test_inserts_updates_and_keeps(spark, table):
    before = files(table)
    batch = [(7, "new", 2.0), (300, "new", 2.0), (None, "new", 2.0)]
    done = pu.upsert(spark.createDataFrame(batch, DDL).select("v", "k", "`a.b`"), table)
    expected = {i: (f"old{i}", 1.0) for i in range(200)} | {k: ("new", 2.0) for k in (7, 300, None)}
    assert rows_of(spark, table) == expected
    assert (done.rows_staged, done.rows_inserted, done.rows_updated) == (3, 1, 2)
    touched = {r[0] for r in spark.createDataFrame(batch, DDL).select(table.part_of()).collect()}
    assert done.parts_touched == len(touched) <= 3
    in_touched = spark.createDataFrame([(i,) for i in range(200)], "k BIGINT").where(table.part_of().isin(*touched)).count()
    assert done.rows_kept == in_touched + 1 - 2
    # no other partition has been written
    after = files(table)
    other = {f: t for f, t in before.items() if int(f.split(f"{pu.PART}=")[1].split("/")[0]) not in touched}
    assert len(other) > 0 and other.items() <= after.items()
    assert pu.upsert(spark.createDataFrame(batch, DDL), table).rows_inserted == 0 and rows_of(spark, table) == expected


def test_untouched_partitions_are_not_read(spark, table):
    stored = spark.read.parquet(table.path)
    batch = spark.createDataFrame([(7, "new", 2.0)], DDL).withColumn(pu.PART, table.part_of())
    part = batch.first()[pu.PART]
    result = pu.merged(stored, batch, table, [part])
    assert f"PartitionFilters: [isnotnull({pu.PART}" in plan_of(result) or f"PartitionFilters: [({pu.PART}" in plan_of(result)
    assert result.where("kind__ = 'kept'").count() == stored.where(F.col(pu.PART) == part).count() - 1
    touched = stored.where(F.col(pu.PART).isin([part]))
    touched.collect()
    metrics = touched._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    assert metrics.apply("numPartitions").value() == 1 and 1 <= metrics.apply("numFiles").value() <= 2


def test_failures_leave_the_table_alone(spark, table, tmp_path):
    before = files(table)
    with pytest.raises(DuplicateKeyError):
        pu.upsert(spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0)], DDL), table)
    with pytest.raises(pu.NotPartitionedError):
        pu.upsert(spark.createDataFrame([(1, "x")], "k BIGINT, other STRING"), table)
    assert pu.upsert(spark.createDataFrame([], DDL), table) == pu.UpsertCounts(0, 0, 0, 0, 0)
    assert files(table) == before
    spark.range(3).write.parquet(f"{tmp_path}/plain")
    with pytest.raises(pu.NotPartitionedError):
        pu.read(spark, pu.PartitionedTable(f"{tmp_path}/plain", "id", 4))
