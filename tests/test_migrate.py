from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from driftwarden.config import TABLES, TableSpec, load_levels, require_known_table
from driftwarden.operators import load
from driftwarden.operators.transforms import TRANSFORMS
from driftwarden.plans import migrate
from driftwarden.sources import jdbc, staging
from tests import seeds


def test_stage_counts_and_reads_back(spark, tmp_path):
    vendor = seeds.source(spark, "vendor")
    path = str(tmp_path / "vendor")
    assert staging.stage_extract(vendor, path) == 20
    again = staging.read_stage(spark, path, vendor.schema)
    assert again.exceptAll(vendor).count() == 0 and again.count() == 20


def test_transform_metrics(spark, tmp_path):
    metrics = {
        name: migrate.transform_table(name, seeds.source(spark, name), str(tmp_path / name)) for name in TABLES}
    txn = metrics["inventory_transaction"]
    assert (txn.input_rows, txn.output_rows, txn.rows_filtered, txn.columns_in, txn.columns_out) == (25, 19, 6, 9, 9)
    assert (metrics["vendor"].columns_in, metrics["vendor"].columns_out, metrics["vendor"].rows_filtered) == (11, 10, 0)


def test_every_transform_yields_the_target_columns(spark):
    for name, spec in TABLES.items():
        out = TRANSFORMS[name](seeds.source(spark, name))
        assert load.project_to_target(out, spec.target_columns).columns == list(spec.target_columns)


def test_projection_reports_absent_columns(spark):
    with pytest.raises(ValueError, match="lacks"):
        load.project_to_target(seeds.source(spark, "vendor"), ["vendor_id", "nope"])


def test_upsert_replaces_adds_and_keeps(spark, rows):
    current = spark.createDataFrame([(1, "old"), (2, "old")], "k INT, v STRING")
    staged = spark.createDataFrame([("new", 2), ("new", 3)], "v STRING, k INT")
    once = load.load_upsert(current, staged, "k")
    assert rows(once) == [(1, "old"), (2, "new"), (3, "new")]
    assert rows(load.load_upsert(once, staged, "k")) == rows(once)
    metrics = load.upsert_metrics(current, staged, "k").first().asDict()
    assert metrics == {"rows_staged": 2, "rows_inserted": 1, "rows_updated": 1, "target_total": 3}


def test_write_upsert_counts_in_one_pass(spark, tmp_path):
    current = spark.createDataFrame([(1, "old"), (2, "old")], "k INT, v STRING")
    staged = spark.createDataFrame([(2, "new"), (3, "new")], "k INT, v STRING")
    path = str(tmp_path / "v1")
    assert load.write_upsert(current, staged, "k", path) == {"rows_staged": 2, "rows_upserted": 2, "target_total": 3}
    assert spark.read.parquet(path).count() == 3


def test_repeated_key_in_batch(spark):
    staged = spark.createDataFrame([(1,), (1,), (2,)], "k INT")
    assert [tuple(r) for r in load.upsert_conflict_keys(staged, "k").collect()] == [(1, 2)]
    with pytest.raises(load.DuplicateKeyError):
        load.require_unique(staged, "k")


def run(spark, tmp_path, **kwargs):
    return {r.table_name: r for r in migrate.run_migration(
        spark, kwargs.pop("read", lambda n: seeds.source(spark, n)), str(tmp_path), **kwargs)}


def test_migration_of_all_tables(spark, tmp_path):
    current = {"vendor": TRANSFORMS["vendor"](seeds.source(spark, "vendor")).filter("vendor_id <= 'V005'")}
    runs = run(spark, tmp_path, current=current)
    assert all(r.status == "SUCCESS" for r in runs.values())
    assert (runs["vendor"].method, runs["vendor"].target_total) == ("upsert", 20)
    assert (runs["inventory_transaction"].rows_extracted, runs["inventory_transaction"].rows_loaded) == (25, 19)
    totals = migrate.migration_totals(migrate.migration_summary(spark, list(runs.values()))).first()
    assert (totals.rows_extracted, totals.rows_loaded, totals.failed_tables) == (92, 86, 0)
    migrate.raise_for_failures(list(runs.values()))


def test_one_failed_table_does_not_stop_the_others(spark, tmp_path):
    def read(name):
        if name == "inventory":
            raise OSError("source is down")
        return seeds.source(spark, name)

    runs = run(spark, tmp_path, read=read)
    assert runs["inventory"].status == "FAILED" and "source is down" in runs["inventory"].error
    assert [n for n, r in runs.items() if r.status == "FAILED"] == ["inventory"]
    with pytest.raises(migrate.MigrationFailed, match="inventory"):
        migrate.raise_for_failures(list(runs.values()))


def test_failed_upsert_falls_back_to_replacing(spark, tmp_path):
    current = {"vendor": spark.createDataFrame([("x",)], "unrelated STRING")}
    vendor = run(spark, tmp_path, current=current)["vendor"]
    assert (vendor.status, vendor.method, vendor.target_total) == ("REPLACED", "overwrite", 20)
    assert vendor.error.startswith("upsert:")


def test_a_repeated_run_upserts_again(spark, tmp_path):
    """The same batch twice under one run id: target-only rows stay, and nothing is left of the first try."""
    vendor = TRANSFORMS["vendor"](seeds.source(spark, "vendor"))
    kept = vendor.limit(1).withColumn("vendor_id", F.lit("KEPT")).select(vendor.columns)
    totals = []
    for _ in range(2):
        runs = {r.table_name: r for r in migrate.run_migration(
            spark, lambda name: seeds.source(spark, name), str(tmp_path), {"vendor": kept}, run_id="r1")}
        assert (runs["vendor"].status, runs["vendor"].method) == ("SUCCESS", "upsert")
        totals.append((runs["vendor"].target_total, spark.read.parquet(runs["vendor"].target_path).count()))
    assert totals == [(21, 21), (21, 21)]


def test_other_errors_of_an_upsert_fail_the_table(spark, tmp_path):
    """An error while rows are read is not taken as a reason to replace the table."""
    vendor = TRANSFORMS["vendor"](seeds.source(spark, "vendor"))
    broken = vendor.withColumns({"vendor_id": F.lit("KEPT"), "vendor_name": F.expr("raise_error(concat('lost ', vendor_name))").cast("string")}).select(vendor.columns)
    got = run(spark, tmp_path, current={"vendor": broken})["vendor"]
    assert got.status == "FAILED" and got.method is None


def test_repeated_key_fails_the_table(spark, tmp_path):
    def read(name):
        df = seeds.source(spark, name)
        return df.union(df) if name == "purchase_order" else df

    order = run(spark, tmp_path, read=read)["purchase_order"]
    assert order.status == "FAILED" and "DuplicateKeyError" in order.error and order.rows_loaded is None


def test_publish_switches_versions(spark, tmp_path):
    for version, rows_ in (("v1", 3), ("it's v2", 5)):
        path = str(tmp_path / version)
        load.write_overwrite(spark.range(rows_), path)
        staging.publish_table(spark, "published_numbers", path)
        assert spark.table("published_numbers").count() == rows_
    spark.sql("DROP TABLE published_numbers")


def test_load_levels_respect_foreign_keys():
    levels = load_levels()
    position = {name: i for i, level in enumerate(levels) for name in level}
    assert all(position[p] < position[n] for n, s in TABLES.items() for p in s.foreign_keys.values())
    loop = {"a": TableSpec("a", "k", ["k"], {"x": "b"}), "b": TableSpec("b", "k", ["k"], {"x": "a"})}
    with pytest.raises(ValueError, match="cycle"):
        load_levels(loop)


def test_unknown_table():
    assert require_known_table("vendor").key == "vendor_id"
    with pytest.raises(ValueError, match="unknown table"):
        require_known_table("nope")


def test_jdbc_options(spark):
    endpoint = jdbc.JdbcEndpoint("db.example", 5432, "sales", "u", "p")
    assert endpoint.options()["url"] == "jdbc:postgresql://db.example:5432/sales"
    with pytest.raises(ValueError, match="bounds"):
        jdbc.read_jdbc(spark, endpoint, "vendor", partition_column="id")


def test_merge_statement_does_what_the_upsert_does(spark, rows):
    current, staged = [(1, "old"), (2, "old")], [(2, "new"), (3, "new")]
    con = duckdb.connect()
    con.sql("CREATE TABLE cur (k INTEGER, v VARCHAR); CREATE TABLE stg (k INTEGER, v VARCHAR)")
    con.executemany("INSERT INTO cur VALUES (?, ?)", current)
    con.executemany("INSERT INTO stg VALUES (?, ?)", staged)
    con.sql(jdbc.merge_statement("cur", "stg", "k", ["k", "v"]))
    merged = load.load_upsert(spark.createDataFrame(current, "k INT, v STRING"), spark.createDataFrame(staged, "k INT, v STRING"), "k")
    assert sorted(con.sql("SELECT * FROM cur").fetchall()) == rows(merged)


def test_soft_delete_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "txn")
    seeds.source(spark, "inventory_transaction").write.parquet(path)
    out = TRANSFORMS["inventory_transaction"](spark.read.parquet(path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Not(EqualNullSafe(status_code,DEL))]" in plan
    assert out.filter(F.col("is_deleted")).count() == 0
