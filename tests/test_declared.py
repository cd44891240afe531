from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftwarden.operators import declared, row_recon
from driftwarden.config import TablePair
from driftwarden.plans import migrate
from driftwarden.schemas import SOURCE_DDL
from tests import seeds

DDL = "`k.id` INT NOT NULL, v STRING, w DOUBLE NOT NULL"


def test_every_departure_is_listed(spark):
    df = spark.createDataFrame([(1, "a", None), (None, "b", 2), (None, None, 3)], "`k.id` INT, extra STRING, w INT")
    found = {tuple(r) for r in declared.schema_departures(df, DDL).collect()}
    assert found == {("v", "MISSING", "string", None, None), ("w", "OTHER_TYPE", "double", "int", None), ("extra", "UNDECLARED", None, "string", None),
                     ("k.id", "NULLS", "int", "int", 2), ("w", "NULLS", "double", "int", 1)}
    with pytest.raises(declared.SchemaMismatch, match="v: missing"):
        declared.require_declared(df, DDL)


def test_a_table_as_declared_passes_in_the_declared_order(spark):
    df = spark.createDataFrame([(2.0, 1, None)], "w DOUBLE, `k.id` INT, v STRING")
    read = declared.require_declared(df, DDL)
    assert read.columns == ["k.id", "v", "w"] and [tuple(r) for r in read.collect()] == [(1, None, 2.0)]
    assert declared.schema_departures(df, DDL).collect() == []
    assert declared.schema_departures(spark.createDataFrame([], "v STRING"), "v STRING").collect() == []
    with pytest.raises(Exception, match="NULL in w"):
        declared.require_declared(df.withColumn("w", F.lit(None).cast("double")), DDL).collect()


def test_a_migration_enforces_declared_sources(spark, tmp_path):
    def read(name):
        df = seeds.source(spark, name)
        if name == "vendor":
            return df.withColumn("lead_time_days", F.col("lead_time_days").cast("string"))
        return df.withColumn("status_code", F.expr("nullif(status_code, 'DEL')")) if name == "inventory_transaction" else df

    runs = {r.table_name: r for r in migrate.run_migration(spark, read, str(tmp_path), schemas=SOURCE_DDL)}
    assert {n: r.status for n, r in runs.items() if r.status != "SUCCESS"} == {"vendor": "FAILED", "inventory_transaction": "FAILED"}
    assert "lead_time_days: other_type" in runs["vendor"].error and "NULL in status_code" in runs["inventory_transaction"].error
    assert runs["purchase_order"].rows_loaded > 0


def test_replaced_tables_are_counted_and_raised(spark, tmp_path):
    current = {"vendor": spark.createDataFrame([("x",)], "unrelated STRING")}
    runs = migrate.run_migration(spark, lambda n: seeds.source(spark, n), str(tmp_path), current)
    assert migrate.migration_totals(migrate.migration_summary(spark, runs)).first().replaced_tables == 1
    migrate.raise_for_failures(runs, allow_replaced=True)
    with pytest.raises(migrate.MigrationFailed, match="vendor"):
        migrate.raise_for_failures(runs)


def test_scattered_changes_are_not_cut(spark):
    source = spark.range(400).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    pair = TablePair("t", "k", source, source.withColumn("v", F.when(F.col("k") % 2 == 0, "b").otherwise("a")))
    assert row_recon.narrow_to_changed(pair, buckets=16) is pair
    one = TablePair("t", "k", source, source.withColumn("v", F.when(F.col("k") == 7, "b").otherwise("a")))
    assert 0 < row_recon.narrow_to_changed(one, buckets=64).source.count() < 40
