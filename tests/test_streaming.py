from __future__ import annotations

import datetime as dt

from driftwarden.operators.cdc import cdc_gap_windowed
from driftwarden.streaming import gap_stream

DDL = "table_name STRING, event_ts TIMESTAMP_NTZ, captured BOOLEAN"


def stream(spark, tmp_path, batches, watermark, files_per_trigger=1):
    """Feed one file per batch in order and return the windows read back."""
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    for batch in batches:
        spark.createDataFrame(batch, DDL).coalesce(1).write.mode("append").parquet(source)
        events = gap_stream.stream_events(spark, source, spark.createDataFrame([], DDL).schema, files_per_trigger)
        gap_stream.write_gap_updates(gap_stream.cdc_gap_stream(events, watermark=watermark), out, state).awaitTermination()
    return gap_stream.read_gap_windows(spark, out)


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def test_stream_equals_batch_when_nothing_is_too_late(spark, tmp_path, rows):
    batches = [
        [("a", at(1, 5), True), ("a", at(1, 50), False), ("b", at(1, 10), True)],
        [("a", at(1, 59), False), ("b", at(2, 0), None)],
        [("a", at(3), True), ("a", at(1, 1), True)]]
    got = stream(spark, tmp_path, batches, watermark="12 hours")
    batch = cdc_gap_windowed(spark.createDataFrame([r for b in batches for r in b], DDL))
    assert rows(got, *gap_stream.RESULT) == rows(batch, *gap_stream.RESULT)


def test_late_events_are_dropped(spark, tmp_path, rows):
    batches = [[("a", at(1), True)], [("a", at(9), True)], [("a", at(1, 30), False), ("a", at(9, 30), False)]]
    got = {r.window_start.hour: (r.total_events, r.missed) for r in stream(spark, tmp_path, batches, watermark="10 minutes").collect()}
    assert got == {1: (1, 0), 9: (2, 1)}


def test_restart_adds_nothing_twice(spark, tmp_path):
    batches = [[("a", at(1), False)]]
    stream(spark, tmp_path, batches, watermark="1 hour")
    again = stream(spark, tmp_path, [[("b", at(1), True)]], watermark="1 hour")
    assert {r.table_name: r.total_events for r in again.collect()} == {"a": 1, "b": 1}


def test_windows_do_not_depend_on_the_session_zone(spark, tmp_path, rows):
    """Half-hour zones, and hours that daylight saving skips or repeats."""
    events = [("a", dt.datetime(2024, 3, 10, 2, 10), True), ("a", dt.datetime(2024, 3, 10, 3, 10), False),
              ("a", dt.datetime(2024, 11, 3, 5, 30), True), ("a", dt.datetime(2024, 11, 3, 6, 30), False), ("b", at(10, 10), False)]
    expected = rows(cdc_gap_windowed(spark.createDataFrame(events, DDL)), *gap_stream.RESULT)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for i, zone in enumerate(("Asia/Kolkata", "America/New_York", "UTC")):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = stream(spark, tmp_path / str(i), [events], watermark="300 days")
            assert rows(got, *gap_stream.RESULT) == expected, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
