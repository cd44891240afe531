from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftwarden.config import TablePair
from driftwarden.operators import row_pairing

DDL = "k STRING, a INT, b STRING, c DOUBLE"


@pytest.mark.parametrize("shape", [(1, 1), (4, 4), (3, 6), (6, 2), (5, 5)])
def test_assignment_costs_least(shape):
    draw = np.random.default_rng(sum(shape))
    for _ in range(30):
        cost = draw.integers(0, 5, shape).astype(float)
        rows, columns = row_pairing.assignment(cost)
        few, many = sorted(shape)
        wide = cost if shape[0] <= shape[1] else cost.T
        least = min(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(many), few))
        assert len(rows) == len(set(rows)) == len(set(columns)) == few and cost[rows, columns].sum() == least


def make_pair(spark, source, target):
    return TablePair("t", "k", spark.createDataFrame(source, DDL), spark.createDataFrame(target, DDL))


def lines(df):
    return sorted(((r.k, r.row_status, r.row_count, r.source_values and tuple(r.source_values), r.target_values and tuple(r.target_values),
                    r.changed_columns and tuple(r.changed_columns)) for r in df.collect()), key=repr)


def test_lost_changed_and_gained_rows_are_told_apart(spark):
    source = [("o", 1, "x", 1.0), ("o", 2, "y", 2.0), ("o", 3, "z", 3.0), ("o", 3, "z", 3.0), ("one", 1, "x", 1.0), ("p", 1, None, 1.0), (None, 1, "x", 1.0)]
    target = [("o", 2, "y", 2.5), ("o", 3, "z", 3.0), ("one", 1, "x", 9.0), ("p", 1, None, 1.0), ("p", 1, None, None), ("p", 1, "", 1.0)]
    found = lines(row_pairing.paired_rows(make_pair(spark, source, target)))
    assert found == sorted([
        ("o", "MATCH", 1, (3, "z", 3.0), (3, "z", 3.0), None), ("o", "CHANGED", 1, (2, "y", 2.0), (2, "y", 2.5), ("c",)),
        ("o", "SOURCE_ONLY", 1, (1, "x", 1.0), None, None), ("o", "SOURCE_ONLY", 1, (3, "z", 3.0), None, None),
        ("p", "MATCH", 1, (1, None, 1.0), (1, None, 1.0), None), ("p", "TARGET_ONLY", 1, None, (1, None, None), None),
        ("p", "TARGET_ONLY", 1, None, (1, "", 1.0), None)], key=repr)


def drifted(seed, keys, rows):
    draw = np.random.default_rng(seed)
    source = [(f"k{draw.integers(keys)}", int(draw.integers(4)), f"v{draw.integers(3)}", float(draw.integers(5))) for _ in range(rows)]
    target = []
    for r in source:
        kind = draw.integers(6)
        if kind == 1:
            r = (r[0], r[1], r[2], r[3] + 0.5)
        if kind == 2:
            r = (r[0], r[1] + 1, "changed", r[3])
        if kind:
            target.append(r)
    return source, target + [("k0", 99, "gained", 0.0)]


def checked_lines(found, source, target):
    """That the lines account for all rows of repeated keys, and pair as many as can be; returns the number of differing columns."""
    s, t, cost, status = Counter(), Counter(), 0, defaultdict(Counter)
    for k, kind, n, a, b, changed in found:
        if a:
            s[(k, *a)] += n
        if b:
            t[(k, *b)] += n
        cost += len(changed or ())
        status[k][kind] += n
        assert (kind == "CHANGED") == (changed is not None) and (kind != "CHANGED" or len(changed) == sum(x != y for x, y in zip(a, b)))
    counts = [Counter(r[0] for r in side) for side in (source, target)]
    odd = {k for c in counts for k, n in c.items() if n > 1}
    assert +s == Counter(r for r in source if r[0] in odd) and +t == Counter(r for r in target if r[0] in odd)
    assert all(not (c["SOURCE_ONLY"] and c["TARGET_ONLY"]) for c in status.values())
    return cost


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_cost_least_under_each_key(spark, seed):
    source, target = drifted(seed, 12, 60)
    cost = checked_lines(lines(row_pairing.paired_rows(make_pair(spark, source, target))), source, target)
    least = 0
    for k in {r[0] for r in source}:
        s, t = Counter(r for r in source if r[0] == k), Counter(r for r in target if r[0] == k)
        a, b = list((s - t).elements()), list((t - s).elements())
        if max(s.total(), t.total()) > 1 and a and b:
            matrix = np.array([[sum(x != y for x, y in zip(p, q)) for q in b] for p in a], float)
            i, j = row_pairing.assignment(matrix)
            least += int(matrix[i, j].sum())
    assert cost == least


def test_a_large_key_is_cut_into_blocks(spark):
    """All rows are accounted for and as many paired as can be; fewest columns only block by block."""
    source, target = drifted(5, 2, 300)
    found = lines(row_pairing.paired_rows(make_pair(spark, source, target), most_rows=8))
    exact = lines(row_pairing.paired_rows(make_pair(spark, source, target)))
    assert checked_lines(exact, source, target) <= checked_lines(found, source, target)


def test_a_large_key_with_one_changed_column_a_row_is_paired_exactly(spark):
    source = [("k", i, f"v{i}", float(i)) for i in range(120)]
    target = [("k", i, f"v{i}", i + 0.5) if i % 3 else ("k", i, "changed", float(i)) for i in range(120) if i % 10]
    found = lines(row_pairing.paired_rows(make_pair(spark, source, target), most_rows=20))
    assert Counter(x[1] for x in found) == {"CHANGED": 108, "SOURCE_ONLY": 12}
    assert all(a[0] == b[0] and len(c) == 1 for _, kind, _, a, b, c in found if kind == "CHANGED")


def test_tables_without_repeated_keys_and_empty_ones(spark):
    assert row_pairing.paired_rows(make_pair(spark, [("a", 1, "x", 1.0)], [("a", 2, "x", 1.0)])).collect() == []
    assert row_pairing.paired_rows(make_pair(spark, [], [])).collect() == []
    only = lines(row_pairing.paired_rows(make_pair(spark, [("a", 1, "x", 1.0)] * 3, [])))
    assert only == [("a", "SOURCE_ONLY", 1, (1, "x", 1.0), None, None)] * 3
