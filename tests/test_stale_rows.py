from __future__ import annotations

import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwarden.operators import stale_rows as sr

START = dt.datetime(2024, 1, 1)
LOG = "event_id STRING, primary_key STRING, event_ts TIMESTAMP_NTZ, captured BOOLEAN"


def hour(n):
    return START + dt.timedelta(hours=n)


def plain(rows, events):
    out = []
    for key, at in rows:
        if key is None or at is None:
            out.append((key, at, None, None, 0, 0, None, "UNDATED"))
            continue
        own = sorted((t, i, c) for i, k, t, c in events if k == str(key) and t is not None)
        before, later = [e for e in own if e[0] <= at], [e for e in own if e[0] > at]
        got = sum(c is not False for _, _, c in later)
        verdict = "NEVER_CAPTURED" if later and not got else "LAGGING" if later else "CURRENT" if before else "NO_EVENTS"
        out.append((key, at, *(before[-1][:2] if before else (None, None)), len(later), got,
                    int((later[-1][0] - at).total_seconds()) if later else None, verdict))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, hot", [(1, 0.0), (2, 0.6)])
def test_rows_equal_brute_force(spark, seed, hot):
    """With and without a key that fills most ranges; times repeat, so events and rows tie."""
    draw = np.random.default_rng(seed)
    key = lambda: 7 if draw.random() < hot else int(draw.integers(0, 40))
    events = [(f"e{i:04d}", str(key()), hour(int(draw.integers(0, 60))), [True, False, None][draw.integers(3)]) for i in range(900)]
    events += [("x", None, hour(1), True), ("y", "3", None, True)]
    rows = [(key(), hour(int(draw.integers(-5, 70)))) for _ in range(300)] + [(None, hour(2)), (4, None), (None, None), (999, hour(9))]
    rows += [(7, hour(30))] * 5
    # columns named like the operator's own must not matter
    table = spark.createDataFrame(rows, "`k.id` BIGINT, `t.s` TIMESTAMP_NTZ").withColumns({"place": F.lit("x"), "at": F.lit(1), "kind": F.lit(5)})
    log = spark.createDataFrame(events, LOG).withColumn("range__", F.lit(3)).repartition(7)
    found = sr.stale_rows(table.repartition(5), log, "k.id", "t.s")
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, events)


def test_empty_sides(spark):
    none, log = spark.createDataFrame([], "k STRING, t TIMESTAMP_NTZ"), spark.createDataFrame([("1", "a", hour(1), True)], LOG)
    assert sr.stale_rows(none, log, "k", "t").collect() == []
    rows = spark.createDataFrame([("a", hour(0))], "k STRING, t TIMESTAMP_NTZ")
    assert [r.verdict for r in sr.stale_rows(rows, log.where("false"), "k", "t").collect()] == ["NO_EVENTS"]
    assert [(r.verdict, r.behind_seconds) for r in sr.stale_rows(rows, log, "k", "t").collect()] == [("LAGGING", 3600)]


def test_counts_add_up(spark):
    rows = spark.createDataFrame([(i % 3, hour(i)) for i in range(30)], "k INT, t TIMESTAMP_NTZ")
    log = spark.createDataFrame([(str(i), str(i % 2), hour(10 + i), i % 4 != 0) for i in range(10)], LOG)
    stale = sr.stale_rows(rows, log, "k", "t")
    counted = {r.verdict: r.row_count for r in sr.stale_counts(stale).collect()}
    assert counted == Counter(r.verdict for r in stale.collect()) and sum(counted.values()) == 30
