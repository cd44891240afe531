from __future__ import annotations

import itertools

import numpy as np
import pytest

from driftwarden.config import TablePair
from driftwarden.operators.loss_patterns import loss_patterns
from tests import seeds

DDL = "k BIGINT, `a.b` STRING, c INT, d STRING"


def planted(seed, rows=600):
    """Rows lost under ``a.b = x AND c IS NULL``, and some by chance."""
    draw = np.random.default_rng(seed)
    source = [(k, str(draw.choice(list("xyz"))), [None, 1, 2, 3][draw.integers(4)], f"d{draw.integers(200)}") for k in range(rows)]
    target = [r for r in source if not (r[1] == "x" and r[2] is None) and draw.random() > 0.02]
    return source, target


def every_condition(source, target, least_share=0.05):
    """Excess of all conditions with enough lost rows, by brute force."""
    kept = {r[0] for r in target}
    gone = [r for r in source if r[0] not in kept]
    found = {}
    for size in (1, 2, 3):
        for columns in itertools.combinations((1, 2, 3), size):
            for values in {tuple(r[c] for c in columns) for r in gone}:
                matching = [r for r in source if tuple(r[c] for c in columns) == values]
                lost = sum(r[0] not in kept for r in matching)
                if lost >= least_share * len(gone):
                    found[tuple(zip(columns, values))] = (lost * len(source) - len(matching) * len(gone), len(matching), lost)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_planted_conditions_come_first(spark, seed):
    source, target = planted(seed)
    pair = TablePair("t", "k", spark.createDataFrame(source, DDL), spark.createDataFrame(target, DDL))
    found = loss_patterns(pair).collect()
    assert found[0].conditions == "a.b = x AND c IS NULL" and found[0].loss_pct == 100.0 and found[0].rank == 1
    every = every_condition(source, target)
    name = {1: "a.b", 2: "c", 3: "d"}
    text = {" AND ".join(f"{name[c]} = {v}" if v is not None else f"{name[c]} IS NULL" for c, v in k): v for k, v in every.items()}
    assert [text[r.conditions][1:] for r in found] == [(r.row_count, r.lost_rows) for r in found]
    excess = [text[r.conditions][0] for r in found]
    assert excess == sorted(excess, reverse=True) and excess[0] == max(v[0] for v in every.values())


def test_a_narrow_beam_still_finds_the_best_single_value(spark):
    source, target = planted(7)
    pair = TablePair("t", "k", spark.createDataFrame(source, DDL), spark.createDataFrame([r for r in target if r[2] != 1], DDL))
    assert loss_patterns(pair, beam=1, most_values=1, answers=1).first().conditions == "c = 1"


def test_seed_transactions_are_explained_by_their_status(spark):
    first = loss_patterns(seeds.pair(spark, "inventory_transaction")).first()
    assert (first.conditions, first.lost_rows, first.lost_share_pct, first.lift) == ("status_code = DEL", 6, 100.0, round(25 / 6, 4))


def test_nothing_lost_everything_lost_null_and_repeated_keys(spark):
    rows = [(1, "x", 1, "d"), (1, "x", 1, "d"), (2, "y", None, None), (None, "n", 5, "e")]
    frame = lambda r: spark.createDataFrame(r, DDL)
    assert loss_patterns(TablePair("t", "k", frame(rows[:3]), frame(rows))).collect() == []
    assert loss_patterns(TablePair("t", "k", frame([]), frame(rows))).collect() == []
    assert loss_patterns(TablePair("t", "k", frame(rows), frame([]))).collect() == []  # no condition sets them apart
    only_null = loss_patterns(TablePair("t", "k", frame(rows), frame([rows[0], rows[1], rows[2]]))).first()
    assert (only_null.conditions, only_null.row_count, only_null.lost_rows) == ("a.b = n", 1, 1)
