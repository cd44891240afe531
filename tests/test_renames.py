from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwarden.config import TablePair
from driftwarden.operators import renames


@pytest.mark.parametrize(("share", "rows"), [(1.0, 5000), (0.8, 5000), (0.8, 60)])
def test_renamed_columns_are_found_with_their_overlap(spark, share, rows):
    source = spark.range(rows).select(
        F.col("id").alias("k"), F.concat(F.lit("name"), "id").alias("old.name"), (F.col("id") * 7).alias("amount"), (F.col("id") % 2 == 0).alias("flag"),
        F.lit(None).cast("string").alias("nothing"), F.col("id").alias("same"))
    target = source.where("k % 11 <> 0").select(
        "k", F.when(F.rand(3) < share, F.col("`old.name`")).otherwise("other").alias("new.name"), F.col("amount").alias("sum"),
        (F.col("k") % 3 == 0).alias("other_flag"), F.lit(None).cast("string").alias("also_nothing"), "same").cache()
    found = {(r.change, r.source_column, r.target_column): r for r in renames.renamed_columns(TablePair("t", "k", source, target), size=256).collect()}
    assert set(found) == {("RENAMED", "old.name", "new.name"), ("RENAMED", "amount", "sum"), ("MISSING", "flag", None), ("EXTRA", None, "other_flag"),
                          ("MISSING", "nothing", None), ("EXTRA", None, "also_nothing")}
    name, amount = found["RENAMED", "old.name", "new.name"], found["RENAMED", "amount", "sum"]
    exact = target.where("`new.name` <> 'other'").count() / target.count()
    assert abs(name.key_agreement - exact) < 0.1 and amount.key_agreement == 1.0
    assert abs(name.value_overlap - exact * 10 / 11) < 0.12 and abs(amount.value_overlap - 10 / 11) < 0.08


def test_sketches_are_bounded_and_exact_for_small_sets(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 40).alias("few"), F.col("id").alias("many"))
    values, cells = renames.sketches(TablePair("t", "k", df, df), df.repartition(5), ["few", "many"], 100)
    assert (len(values["few"]), len(values["many"]), len(cells["few"]), len(cells["many"])) == (40, 100, 100, 100)
    assert values["many"] == sorted(values["many"]) and cells["few"].keys() == cells["many"].keys()


def test_overlap_is_unbiased():
    draw = np.random.default_rng(1)
    for both, only in ((2000, 500), (100, 4000)):
        x = draw.choice(1 << 50, both + 2 * only, replace=False).tolist()
        a, b = sorted(x[:both + only])[:512], sorted(x[:both] + x[both + only:])[:512]
        assert abs(renames.overlap(a, b, 512) - both / (both + 2 * only)) < 0.08
    assert renames.overlap([], []) == 0.0 and renames.overlap([1], [1]) == 1.0


def test_one_sided_on_one_side_only_and_empty_tables(spark):
    a, b = spark.createDataFrame([(1, "x", 2)], "k INT, p STRING, q INT"), spark.createDataFrame([(1, "x")], "k INT, p STRING")
    assert [tuple(r) for r in renames.renamed_columns(TablePair("t", "k", a, b)).collect()] == [("t", "MISSING", "q", None, None, None)]
    empty = renames.renamed_columns(TablePair("t", "k", a.limit(0), b.limit(0).withColumnRenamed("p", "r"))).collect()
    assert {r.change for r in empty} == {"MISSING", "EXTRA"}
