from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwarden.config import TablePair
from driftwarden.operators import ordered_runs


def plain_holes(numbers):
    held = sorted(set(numbers))
    return [(a + 1, b - 1, b - a - 1) for a, b in zip(held, held[1:]) if b - a > 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_holes_equal_brute_force(spark, seed):
    draw = np.random.default_rng(seed)
    rows = [(str(draw.choice(["a", "b", "c"], p=[.9, .08, .02])), int(n)) for n in draw.integers(-200, 1500, 900)] + [(None, 1), (None, 9), ("z", 5), ("a", None)]
    df = spark.createDataFrame(rows, "`g.h` STRING, `n.o` BIGINT").repartition(7)
    found = sorted(map(tuple, ordered_runs.missing_intervals(df, "n.o", ["g.h"]).collect()), key=repr)
    assert found == sorted(((g, *h) for g in {r[0] for r in rows} for h in plain_holes([n for x, n in rows if x == g and n is not None])), key=repr)
    whole = sorted(map(tuple, ordered_runs.missing_intervals(df, "n.o", first=-300, last=1600).collect()))
    assert whole == plain_holes([-301, 1601] + [n for _, n in rows if n is not None])


def test_holes_of_nothing(spark):
    none = spark.createDataFrame([], "n BIGINT")
    assert ordered_runs.missing_intervals(none, "n", first=1, last=9).collect() == []
    assert [tuple(r) for r in ordered_runs.missing_intervals(spark.createDataFrame([(5,)], "n BIGINT"), "n", first=4, last=6).collect()] == [(4, 4, 1), (6, 6, 1)]


@pytest.mark.parametrize("stretch", [1, 5, 400])
def test_segments_equal_brute_force(spark, stretch):
    """Stretches within one range, over a border, and over many ranges."""
    draw = np.random.default_rng(stretch)
    rows, at = [], 0
    while len(rows) < 1200:
        value = [None, 1, 2][draw.integers(3)]
        for _ in range(int(draw.integers(1, 2 * stretch + 1))):
            rows.append(("ab"[len(rows) % 10 == 0], at := at + 1, value))
    found = ordered_runs.segments(spark.createDataFrame(rows, "g STRING, o INT, v INT").repartition(5), ["g"], ["o"], F.col("v"))
    want = []
    for g in "ab":
        number, last = 0, ()
        for _, o, v in (r for r in rows if r[0] == g):
            if (v,) != last:
                number, last = number + 1, (v,)
                want.append([g, number, v, o, o, 0])
            want[-1][4:] = [o, want[-1][5] + 1]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want), key=repr)


def test_a_change_of_the_offset_shows_its_dates(spark):
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    source = [(i, day(i)) for i in range(300)] + [(900, None), (901, day(3))]
    target = [(i, day(i) + dt.timedelta(hours=5 if i < 120 else 4)) for i in range(300) if i != 50] + [(900, day(1)), (902, day(9))]
    target[200] = (target[200][0], day(0))  # a stale row
    ddl = "k INT, t TIMESTAMP_NTZ"
    pair = TablePair("t", "k", spark.createDataFrame(source, ddl), spark.createDataFrame(target, ddl))
    every = ordered_runs.ts_offset_segments(pair, "t").orderBy("segment").collect()
    assert [r.offset_seconds for r in every][:2] == [18000, 14400] and len(every) == 4
    found = [tuple(r)[2:] for r in ordered_runs.ts_offset_segments(pair, "t", 3).orderBy("segment").collect()]
    assert found == [(1, 18000, day(0), day(119), 119), (2, 14400, day(120), day(299), 179)]
