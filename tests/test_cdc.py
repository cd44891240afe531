from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from driftwarden.operators import cdc, issues, report
from driftwarden.sources import cdc_log, run_store
from tests import seeds

DDL = "event_id STRING, table_name STRING, event_ts TIMESTAMP_NTZ, captured BOOLEAN, gap_reason STRING"
AS_OF = dt.datetime(2024, 1, 31)


def events(spark, *data):
    return spark.createDataFrame([(str(i), *row) for i, row in enumerate(data)], DDL)


def test_window_is_inclusive_and_keeps_unknown_times(spark):
    at = AS_OF - dt.timedelta(hours=168)
    df = events(spark, ("a", at, True, None), ("a", at - dt.timedelta(microseconds=1), True, None), ("a", None, True, None))
    assert sorted(r.event_id for r in cdc.filter_events(df, AS_OF).collect()) == ["0", "2"]
    assert cdc.filter_events(df).count() == 3
    assert cdc.filter_events(df, AS_OF, hours_back=24).count() == 1
    assert cdc.filter_events(df, table="b").count() == 0


def test_window_does_not_depend_on_the_session_zone(spark):
    df = events(spark, ("a", dt.datetime(2024, 1, 24), True, None), ("a", dt.datetime(2024, 1, 23, 23, 59), True, None))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert cdc.filter_events(df, AS_OF).count() == 1
        aware = dt.datetime(2024, 1, 31, 5, 30, tzinfo=dt.timezone(dt.timedelta(hours=5, minutes=30)))
        assert cdc.filter_events(df, aware).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_missing_flags_and_reasons(spark):
    df = events(spark, ("a", None, None, None), ("a", None, False, None), ("a", None, False, "X"), ("other", None, False, "X"))
    gap = {r.table_name: (r.total_events, r.captured, r.missed, r.gap_rate) for r in cdc.cdc_gap(df, ["a", "b"]).collect()}
    assert gap == {"a": (3, 1, 2, 66.67), "b": (0, 0, 0, 0.0)}
    patterns = [(r.table_name, r.reason, r.event_count, r.pattern_no) for r in cdc.cdc_gap_patterns(df).orderBy("table_name", "pattern_no").collect()]
    assert patterns == [("a", "UNKNOWN", 1, 1), ("a", "X", 1, 2), ("other", "X", 1, 1)]


def test_summary_replaces_computed_figures(spark):
    summary = spark.createDataFrame([seeds.VENDOR_SUMMARY, ("unlisted", 1, 0, 1, 100.0)], seeds.SUMMARY_DDL)
    df = events(spark, ("vendor", None, True, None), ("inventory", None, False, None))
    got = {r.table_name: (r.total_events, r.missed) for r in cdc.cdc_gap(df, ["vendor", "inventory"], summary).collect()}
    assert got == {"vendor": (4230, 847), "inventory": (1, 1)}


def test_event_document_and_summary_document(spark, tmp_path):
    names = [f.split()[0] for f in seeds.EVENT_DDL.split(",")]
    listed = [dict(zip(names, row)) for row in seeds.event_rows()]
    for event in listed:
        event["before"], event["after"] = json.loads(event["before"]), json.loads(event["after"])
    document = {
        "metadata": {"source": "x"}, "events": listed,
        "gap_analysis": {
            "vendor": {"total_events": 4230, "captured": 3383, "missed": 847, "gap_rate": 20.02, "gap_patterns": [
                {"reason": "CDC_TRIGGER_SKIP", "description": "bulk updates", "count": 847, "affected_columns": ["vendor_tier"],
                 "first_occurrence": "2024-01-02T03:00:00Z", "last_occurrence": "2024-01-15T03:00:00Z"}]},
            "inventory": {"total_events": 18450, "captured": 18450, "missed": 0, "gap_rate": 0.0, "gap_patterns": []}}}
    path = str(tmp_path / "log.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, indent=1)
    read = cdc_log.read_cdc_events(spark, path, document=True)
    assert read.count() == 35 and read.filter("NOT captured").count() == 18
    assert read.agg(F.min("event_ts")).first()[0] == dt.datetime(2024, 1, 2, 4)
    detail = cdc.cdc_pattern_detail(read).first()
    assert (detail.reason, detail.event_count, detail.affected_columns) == ("CDC_TRIGGER_SKIP", 18, ["updated_ts", "vendor_tier"])
    assert (detail.first_occurrence, detail.last_occurrence) == (dt.datetime(2024, 1, 2, 4), dt.datetime(2024, 1, 2, 21))
    summary = cdc_log.read_cdc_summary(spark, path)
    figures = {r.table_name: (r.missed, r.gap_rate, len(r.gap_patterns)) for r in summary.collect()}
    assert figures == {"vendor": (847, 20.02, 1), "inventory": (0, 0.0, 0)}


def test_json_lines_round_trip(spark, tmp_path):
    df = cdc_log._event_columns(seeds.raw_events(spark))
    cdc_log.write_cdc_events(df, str(tmp_path / "lines"))
    again = cdc_log.read_cdc_events(spark, str(tmp_path / "lines"))
    assert again.exceptAll(df).count() == 0 and df.exceptAll(again).count() == 0


def test_daily_runs_match_direct_windows(spark):
    day = lambda n, h=5: dt.datetime(2024, 1, n, h)
    df = events(spark, ("a", day(1), False, None), ("a", day(2), True, None), ("b", day(9), True, None), ("a", day(10), True, None))
    by_day = cdc.cdc_gap_by_run_day(df)
    got = {(r.as_of.day, r.table_name): (r.total_events, r.missed) for r in by_day.filter("as_of <= DATE'2024-01-11'").collect()}
    for (as_of, table), figures in got.items():
        direct = df.filter((F.col("event_ts") < dt.datetime(2024, 1, as_of)) & (F.col("table_name") == table))
        direct = cdc.filter_events(direct, dt.datetime(2024, 1, as_of))
        assert figures == (direct.count(), direct.filter("NOT captured").count())
    runs = issues.runs_from_gaps(by_day, "m").orderBy("started_at").collect()
    assert [(r.run_id, r.health_score, r.issues_found) for r in runs] == [
        ("20240102", 75, 1), ("20240103", 75, 1), ("20240110", 100, 0), ("20240111", 100, 0)]


def test_run_history_appends_and_trends(spark, tmp_path):
    path = str(tmp_path / "runs")
    make = lambda i, score: spark.createDataFrame(
        [(f"r{i}", "m", "complete", dt.datetime(2024, 1, i), score, 1)], run_store.RUN_DDL)
    run_store.append_run(make(1, 40), path)
    run_store.append_run(make(2, 70), path)
    trend = report.score_trend(run_store.run_history(spark, path)).orderBy("started_at").collect()
    assert [(r.run_id, r.score_change) for r in trend] == [("r1", None), ("r2", 30)]


def test_pattern_detail_counts_each_event_once(spark):
    data = [("a", '{"x":1,"y":2}'), ("a", '{"y":1}'), ("a", "{}"), ("a", None), ("a", '{"x":1,"y":2}')]
    df = spark.createDataFrame([(t, dt.datetime(2024, 1, i + 1), False, None, after) for i, (t, after) in enumerate(data)],
                               "table_name STRING, event_ts TIMESTAMP_NTZ, captured BOOLEAN, gap_reason STRING, after STRING")
    got = cdc.cdc_pattern_detail(df).collect()
    assert [(r.reason, r.event_count, r.affected_columns, r.first_occurrence.day, r.last_occurrence.day) for r in got] == [
        ("UNKNOWN", 5, ["x", "y"], 1, 5)]


@pytest.mark.parametrize("k", [1, 2])
def test_top_reasons(spark, k):
    patterns = spark.createDataFrame([("a", "x", 5), ("a", "y", 9), ("a", "z", 5), ("b", "x", 1)], "table_name STRING, reason STRING, event_count BIGINT")
    got = [(r.table_name, r.reason) for r in cdc.ranked_patterns(patterns, k).orderBy("table_name", "pattern_no").collect()]
    assert got == {1: [("a", "y"), ("b", "x")], 2: [("a", "y"), ("a", "x"), ("b", "x")]}[k]


def test_damaged_lines_fail_the_read_unless_left_out(spark, tmp_path):
    good = '{"event_id": "1", "table_name": "vendor", "timestamp": "2024-01-01T00:00:00Z"}'
    (tmp_path / "log.json").write_text(good + "\n" + good[:30] + "\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        cdc_log.read_cdc_events(spark, str(tmp_path)).collect()
    assert [r.table_name for r in cdc_log.read_cdc_events(spark, str(tmp_path), skip_corrupt=True).collect()] == ["vendor"]
    assert [r.line for r in cdc_log.read_corrupt_lines(spark, str(tmp_path)).collect()] == [good[:30]]


def test_undated_events_are_in_every_form(spark):
    events = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 5), False), ("a", None, False)], "table_name STRING, event_ts TIMESTAMP_NTZ, captured BOOLEAN")
    windows = {r.window_start: r.missed for r in cdc.cdc_gap_windowed(events).collect()}
    assert windows == {None: 1, dt.datetime(2024, 1, 1, 5): 1}
    assert {r.missed for r in cdc.cdc_gap_by_run_day(events).collect()} == {2}


def test_given_patterns_win_and_repeats_are_rejected(spark, rows):
    events = spark.createDataFrame([("a", None, False, "X"), ("b", None, False, "Y")], "table_name STRING, event_ts TIMESTAMP_NTZ, captured BOOLEAN, gap_reason STRING")
    pattern = [("BATCH", "night job", 847, ["c"], "2024-01-01T00:00:00Z", None)]
    ddl = """table_name STRING, total_events BIGINT, captured BIGINT, missed BIGINT, gap_rate DOUBLE, gap_patterns ARRAY<STRUCT<reason: STRING,
        description: STRING, count: BIGINT, affected_columns: ARRAY<STRING>, first_occurrence: STRING, last_occurrence: STRING>>"""
    summary = spark.createDataFrame([("a", 900, 53, 847, 94.11, pattern)], ddl)
    found = cdc.cdc_gap_patterns(events, summary)
    assert rows(found, "table_name", "reason", "event_count", "description") == [("a", "BATCH", 847, "night job"), ("b", "Y", 1, None)]
    assert rows(report.report_cdc_patterns(found)) == [("BATCH", "847", "night job"), ("Y", "1", "")]
    with pytest.raises(Exception, match="lists a table twice: a"):
        cdc.cdc_gap(events, ["a", "b"], summary.union(summary)).collect()
