from __future__ import annotations

import os

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftwarden.operators import task_runs
from driftwarden.plans import registry
from driftwarden.sources import drift_views as dv, task_logs
from driftwarden.sources.task_logs import scan_task_logs, write_task_logs

RUN_A, RUN_B = "manual__2024-01-01T00:00:00+00:00", "manual__2024-01-02T00:00:00+00:00"


def write(base, task, run, name, text, modified):
    folder = base / "dag" / task / run
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    os.utime(folder / name, (modified, modified))


def logs(spark, tmp_path):
    write(tmp_path, "extract", RUN_A, "1.log", "ERROR boom\nState set to FAILED\n", 1_000)
    write(tmp_path, "extract", RUN_A, "2.log", "duration: 45.7\nTotal rows extracted: 92\npartitions: 4\n", 5_000)
    write(tmp_path, "extract", RUN_B, "1.log", "duration: 9\nTotal rows extracted: 10\n", 3_000)
    write(tmp_path, "load", RUN_B, "1.log", "rows_upserted: 86\nduration: 52\n", 4_000)
    write(tmp_path, "load", RUN_B, "notes.txt", "not a log", 9_000)
    return scan_task_logs(spark, str(tmp_path), "dag")


def test_scan_reads_whole_files_and_path_parts(spark, tmp_path, rows):
    got = rows(logs(spark, tmp_path), "dag_id", "task_id", "run_id", "file_name")
    assert got == sorted([("dag", "extract", RUN_A, "1.log"), ("dag", "extract", RUN_A, "2.log"), ("dag", "extract", RUN_B, "1.log"),
                          ("dag", "load", RUN_B, "1.log")])


def test_latest_without_run_is_newest_file(spark, tmp_path, rows):
    got = rows(task_runs.latest_log(logs(spark, tmp_path)), "task_id", "run_id", "file_name")
    assert got == [("extract", RUN_A, "2.log"), ("load", RUN_B, "1.log")]


def test_latest_of_run_is_last_name_else_newest(spark, tmp_path, rows):
    frame = logs(spark, tmp_path)
    assert rows(task_runs.latest_log(frame, RUN_B), "task_id", "run_id", "file_name") == [
        ("extract", RUN_B, "1.log"), ("load", RUN_B, "1.log")]
    assert rows(task_runs.latest_log(frame, RUN_A), "task_id", "run_id", "file_name") == [
        ("extract", RUN_A, "2.log"), ("load", RUN_B, "1.log")]


def test_task_status_covers_every_listed_task(spark, tmp_path):
    got = {r.task_id: r for r in task_runs.task_status(logs(spark, tmp_path), "dag", ["extract", "load", "explain"]).collect()}
    assert (got["extract"].status, got["extract"].duration_seconds, got["extract"].records_processed, got["extract"].partitions) == (
        "SUCCESS", 45, 92, 4)
    assert (got["load"].records_processed, got["load"].partitions) == (86, None)
    assert (got["explain"].status, got["explain"].error_message) == ("NOT_FOUND", "No logs found for task: explain")


def test_run_totals(spark, tmp_path):
    metrics = task_runs.task_metrics(logs(spark, tmp_path))
    got = {r.run_id: (r.duration_seconds, r.records_processed, r.failed_task_count) for r in task_runs.run_totals(metrics).collect()}
    assert got == {RUN_A: (45, 92, 1), RUN_B: (61, 96, 0)}


def test_latest_logs_are_chosen_without_opening_the_archive(spark, tmp_path, rows):
    frame = logs(spark, tmp_path)
    for run in (None, RUN_B):
        got = task_runs.read_latest_logs(spark, str(tmp_path), "dag", ["extract", "load", "absent"], run)
        assert rows(got) == rows(task_runs.latest_log(frame, run))
    assert rows(task_runs.read_latest_logs(spark, str(tmp_path), "dag", ["absent"])) == []
    got.collect()
    scan = next(p for p in got._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan text" in p)
    assert "file_path" in scan and "IN" in scan.upper()


def written_files(base):
    """How often each folder holds a file of that content."""
    return Counter((str(f.parent.relative_to(base)), f.read_bytes()) for f in Path(base).rglob("*.txt"))


ODD_LOGS = [("d", "extract", "20240101", "ERROR a\nb"), ("d", "extract", "20240101", "ERROR a\nb"), ("d", "load", None, "x"),
            ("d", "", "20240101", ""), ("d", "a b:c/%='+é", "20240101", None), ("d", "load", "20240102", "é\r\n")]


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_written_logs_are_those_of_sparks_own_writer(spark, tmp_path, scheme):
    logs = spark.createDataFrame(ODD_LOGS, "dag_id STRING, task_id STRING, run_id STRING, log_text STRING")
    logs = logs.withColumn("log_text", F.when(F.col("run_id").isNull(), F.unhex(F.lit("41FF42")).cast("string")).otherwise(F.col("log_text")))
    logs.write.option("maxRecordsPerFile", 1).partitionBy(*task_logs.LOG_FOLDERS).text(str(tmp_path / "spark"))
    write_task_logs(logs, f"{scheme}{tmp_path}/own")
    own = written_files(tmp_path / "own")
    assert own == written_files(tmp_path / "spark") and own.total() == 6

    def read(folder):
        columns = ["dag_id", "task_id", "run_id", F.hex("log_text")]
        return Counter(tuple(r) for r in scan_task_logs(spark, str(folder), suffix=".txt").select(*columns).collect())

    assert read(tmp_path / "own") == read(tmp_path / "spark")


def test_no_logs_are_an_empty_folder(spark, tmp_path):
    logs = spark.createDataFrame([], "dag_id STRING, task_id STRING, run_id STRING, log_text STRING")
    write_task_logs(logs, f"{tmp_path}/none")
    assert scan_task_logs(spark, f"{tmp_path}/none", suffix=".txt").count() == 0


def test_a_log_archive_is_written_and_scanned_by_few_tasks_without_a_process_per_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(task_logs, "FILES_PER_TASK", 100)
    path = tmp_path / "events.parquet"
    columns = ["id AS event_id", "TIMESTAMP_NTZ '2024-01-05' AS ts", "id % 7 AS user_id", "'view' AS event_type", "1.5D AS value", "'{}' AS props"]
    spark.range(600).selectExpr(*columns).coalesce(1).write.parquet(str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")  # every file is a split of its own
    try:
        assert registry.QUERIES["task_log_scan"](spark, str(tmp_path)).rdd.getNumPartitions() <= task_logs.SCAN_TASKS
        write_task_logs(dv.task_logs(spark, str(tmp_path)), f"{tmp_path}/logs")
        assert scan_task_logs(spark, f"{tmp_path}/logs", suffix=".txt").select("log_text").distinct().count() == 600
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    files = [f.name for f in (tmp_path / "logs").rglob("*") if f.is_file()]
    assert len(files) == 600 and not [f for f in files if f.startswith(".")]  # Spark's writer leaves checksums beside them
    assert len({f.split("-")[1] for f in files}) >= 4  # tasks that wrote


def test_packed_logs_are_unpacked(spark, tmp_path):
    import gzip
    folder = tmp_path / "dag" / "load" / RUN_A
    folder.mkdir(parents=True)
    (folder / "1.log.gz").write_bytes(gzip.compress(b"duration: 9\n"))
    assert scan_task_logs(spark, str(tmp_path), suffix=".log.gz").first().log_text == "duration: 9\n"


def test_logs_are_listed_and_read_by_tasks_as_sparks_reader_does(spark, tmp_path, monkeypatch):
    run = f"run_id={RUN_A} 100%25+é"
    for name in (f"d/load/{run}/1.log", f"d/load/{run}/.2.log", f"d/load/{run}/_3.log", f"d/load/{run}/_a=4.log", f"d/load/{run}/5.log._COPYING_",
                 f"d/load/{run}/6.txt", f"d/load/{run}/_metadata.log", "d/_hidden/r/7.log", ".d/load/r/8.log", "d/load/r/deep/er/9.log", "d/10.log", "d/empty/r/11.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"ERROR \xff" + name.encode() + b"\r\n")
    (tmp_path / "d/none/r").mkdir(parents=True)
    (tmp_path / "d/link").symlink_to(tmp_path / "d/load")
    monkeypatch.setattr(task_logs, "BATCH_ROWS", 2)
    calls = [{}, {"dag": "d"}, {"dag": "d", "task": "load", "run": run}, {"task": "load"}, {"run": "r"}, {"suffix": ".txt"}, {"suffix": "1.log"}]

    def read():
        return [Counter(tuple(r) for r in scan_task_logs(spark, str(tmp_path), **c).withColumn("log_text", F.hex("log_text")).collect()) for c in calls]

    own, columns = read(), scan_task_logs(spark, str(tmp_path)).dtypes
    monkeypatch.setattr(task_logs, "_mounted", lambda spark, base: None)
    assert own == read() and columns == scan_task_logs(spark, str(tmp_path)).dtypes
    assert [c.total() for c in own][:3] == [7, 4, 2]


def test_the_driver_holds_no_list_of_the_logs(spark, tmp_path):
    for i in range(90):
        (folder := tmp_path / "d" / f"t{i % 3}" / f"r{i % 5}").mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.log").write_text(f"log {i}")
    logs = scan_task_logs(spark, str(tmp_path))
    assert not [f for f in logs.inputFiles() if f.endswith(".log")]
    assert {r.log_text for r in logs.collect()} == {f"log {i}" for i in range(90)}
