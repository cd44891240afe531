from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwarden.config import TablePair
from driftwarden.operators import lookup_table, value_diff
from driftwarden.plans import registry
from tests.test_plans import plan_of

DDL = "k BIGINT, a STRING, b DOUBLE"


def tables(spark, seed, changed):
    """Mostly equal tables with lost, gained, changed and repeated rows and a NULL key."""
    draw = np.random.default_rng(seed)
    source = [(int(k), f"v{k % 7}", float(k)) for k in draw.permutation(400)] + [(None, "n", None), (5, "again", 0.0), (6, "v6", 6.0), (6, "v6", 6.0)]
    target = [*source]
    for _ in range(changed):
        i = int(draw.integers(len(target)))
        row = target.pop(i)
        if (kind := draw.integers(4)) == 1:
            target.append((row[0], None, row[2]))
        elif kind == 2:
            target += [row, row]
        elif kind == 3:
            target.append((int(draw.integers(1000, 9000)), row[1], row[2]))
    return source, target, TablePair("t", "k", spark.createDataFrame(source, DDL), spark.createDataFrame(target, DDL))


def expected(source, target):
    s, t = Counter(source), Counter(target)
    plus, minus = Counter(), Counter()
    for row, n in (s - t).items():
        plus[row[0]] += n
    for row, n in (t - s).items():
        minus[row[0]] += n
    ks, kt = Counter(r[0] for r in source), Counter(r[0] for r in target)
    return {(k, "SOURCE_ONLY" if not kt[k] else "TARGET_ONLY" if not ks[k] else "CHANGED", ks[k], kt[k], plus[k], minus[k]) for k in {*plus, *minus}}


@pytest.mark.parametrize(("cells", "method"), [((300,), "lookup table of 300 cells"), ((6, 600), "lookup table of 600 cells"), ((6,), "counts per row hash")])
def test_differing_keys_by_every_way(spark, cells, method):
    source, target, pair = tables(spark, 1, 40)
    assert lookup_table.differences(pair, cells=cells).method == method
    assert {tuple(r) for r in lookup_table.differing_keys(pair, cells=cells).collect()} == expected(source, target)


@pytest.mark.parametrize("seed", range(3))
def test_more_rows_than_cells_still_peel_if_few_differ(spark, seed):
    source, target, pair = tables(spark, seed + 10, 8)
    assert lookup_table.differences(pair, cells=(90,)).method.startswith("lookup")
    assert {tuple(r) for r in lookup_table.differing_keys(pair, cells=(90,)).collect()} == expected(source, target)


def test_equal_and_empty_tables(spark):
    _, _, pair = tables(spark, 2, 0)
    shuffled = TablePair("t", "k", pair.source, pair.target.orderBy(F.rand(3)).repartition(3))
    assert lookup_table.lookup_table(shuffled, ["a", "b"], 60).count() == 0
    assert lookup_table.differing_keys(shuffled).count() == 0
    empty = TablePair("t", "k", pair.source.limit(0), pair.target.limit(0))
    assert lookup_table.differing_keys(empty).collect() == []
    assert lookup_table.differences(TablePair("t", "k", pair.source, empty.target), cells=(2000,)).count == 402  # three rows are alike


def test_types_that_differ_compare_as_text(spark):
    pair = TablePair("t", "k", spark.createDataFrame([(1, 5), (2, 6)], "k INT, a INT"), spark.createDataFrame([("1", 5), ("2", 7)], "k STRING, a INT"))
    assert [tuple(r) for r in lookup_table.differing_keys(pair).collect()] == [("2", "CHANGED", 1, 1, 1, 1)]


def test_values_of_differing_keys_equal_the_full_comparison(spark):
    _, _, pair = tables(spark, 4, 40)
    cut = lookup_table.narrow_to_differing(pair)
    diffs = lambda p: {tuple(r) for r in value_diff.value_diffs(p).where("diff_type NOT LIKE '%_KEY'").collect()}
    assert diffs(cut) == diffs(pair) and cut.source.count() < 80


def test_no_row_is_shuffled(spark, sf_dir):
    """The sums combine before the only exchange, and keys are looked up from key columns with a broadcast list."""
    pair = registry.edited_orders(spark, sf_dir)
    plan = plan_of(lookup_table.lookup_table(pair, pair.shared_columns(), 999))
    assert plan.count("Exchange hashpartitioning(cell") == plan.count("Exchange") == 1
    assert plan.index("Exchange") < plan.index("partial_sum")
    lookup = plan_of(lookup_table.differing_keys(pair))
    assert "o_totalprice" not in lookup and "SortMergeJoin" not in lookup
