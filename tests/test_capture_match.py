from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest

from driftwarden.streaming import capture_match, gap_stream

CHANGES, CAPTURED = "table_name STRING, event_id BIGINT, event_ts TIMESTAMP_NTZ", "table_name STRING, event_id BIGINT, captured_ts TIMESTAMP_NTZ"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


class Run:
    """Two folders of files, fed part by part; every part is a new start of the stream with the same checkpoint."""

    def __init__(self, spark, tmp_path):
        self.spark = spark
        self.changes, self.captured, self.out, self.state = (str(tmp_path / d) for d in ("changes", "captured", "out", "state"))

    def feed(self, changes, captured, within="1 hour", lateness="10 minutes"):
        for rows, ddl, path in ((changes, CHANGES, self.changes), (captured, CAPTURED, self.captured)):
            self.spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
        streams = [gap_stream.stream_events(self.spark, path, self.spark.createDataFrame([], ddl).schema)
                   for path, ddl in ((self.changes, CHANGES), (self.captured, CAPTURED))]
        query = capture_match.write_matches(capture_match.match_stream(*streams, within, lateness), self.out, self.state)
        query.awaitTermination()
        self.progress = query.recentProgress
        return self

    def found(self):
        return sorted(((r.table_name, r.event_id, r.captured_ts, r.status) for r in capture_match.read_matches(self.spark, self.out).collect()), key=repr)


def test_missed_is_reported_after_its_time(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.feed([("a", 1, at(0)), ("a", 2, at(5)), ("b", 2, at(5))], [("a", 1, at(3))])
    assert run.found() == [("a", 1, at(3), "MATCHED")]  # the others may still be captured
    run.feed([("a", 3, at(300))], [("b", 2, at(66)), ("a", 3, at(301))])
    assert run.found() == sorted([("a", 1, at(3), "MATCHED"), ("a", 3, at(301), "MATCHED"), ("a", 2, None, "MISSED"),
                                  ("b", 2, None, "MISSED")], key=repr)  # b was captured a minute too late


@pytest.mark.parametrize("seed", [1, 2])
def test_restarts_equal_the_batch_twin(spark, tmp_path, seed):
    draw = np.random.default_rng(seed)
    changes = [("ab"[i % 2], i, at(3 * i + 0.5)) for i in range(200)]
    captured = [(t, i, ts + dt.timedelta(minutes=int(draw.integers(1, 80)))) for t, i, ts in changes if draw.random() > 0.2]
    captured += [c for c in captured if c[1] % 40 == 7]  # captured twice
    run = Run(spark, tmp_path)
    for part in range(4):
        inside = lambda ts: part * 150 <= (ts - at(0)).total_seconds() / 60 < part * 150 + 150 or (part == 3 and ts >= at(600))  # noqa: B023, E731
        run.feed([c for c in changes if inside(c[2])], [c for c in captured if inside(c[2])], lateness="3 hours")
    batch = capture_match.match_batch(spark.createDataFrame(changes, CHANGES), spark.createDataFrame(captured, CAPTURED), lateness="3 hours")
    expected = sorted(((r.table_name, r.event_id, r.captured_ts, r.status) for r in batch.collect()), key=repr)
    assert run.found() == expected and {x[3] for x in expected} == {"MATCHED", "MISSED"}


def test_state_is_bounded(spark, tmp_path):
    """Twenty hours of changes, of which state keeps those of the last hours."""
    run = Run(spark, tmp_path)
    for hour in range(0, 20, 4):
        run.feed([("a", 1000 * hour + i, at(60 * hour + i)) for i in range(240)], [("a", 1000 * hour + i, at(60 * hour + i + 1)) for i in range(0, 240, 2)])
    rows = sum(json.loads(s.json if isinstance(s.json, str) else s.json())["numRowsTotal"] for s in run.progress[-1].stateOperators)
    assert rows < 300


def test_counts_and_empty_sides(spark):
    none = spark.createDataFrame([], CAPTURED)
    changes = spark.createDataFrame([("a", 1, at(0)), ("a", 2, at(600)), ("a", 3, None)], CHANGES)
    assert capture_match.match_batch(changes, none).collect() == []  # nothing says how far the capture has come
    one = spark.createDataFrame([("b", 9, at(600)), (None, 9, at(1)), ("a", 1, None)], CAPTURED)
    counts = capture_match.match_counts(capture_match.match_batch(changes, one)).collect()
    assert [tuple(r) for r in counts] == [("a", 0, 1, None)]
