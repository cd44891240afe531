from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftwarden.config import TablePair
from driftwarden.operators import checks, row_recon, value_diff
from driftwarden.session import shuffle_partitions
from tests import seeds

DDL = "k BIGINT, a STRING, b DOUBLE"


def make_pair(spark, source, target, ddl=DDL):
    return TablePair("t", "k", spark.createDataFrame(source, ddl), spark.createDataFrame(target, ddl))


@pytest.mark.parametrize(("table", "column", "samples", "label", "affected"), [
    ("inventory", "unit_cost", 10, "FLOAT_ROUNDING", 20), ("inventory", "last_counted_ts", 10, "TZ_DRIFT", 20),
    ("vendor", "active_flag", 10, "TYPE_COERCION_BOOL", 20), ("vendor", "updated_ts", 9, "TZ_DRIFT", 9),
    ("vendor", "vendor_tier", 10, "MISSING_COLUMN", 20), ("inventory_transaction", "is_deleted", 10, "EXTRA_COLUMN", 19),
    ("supplier_contract", "terms_notes", 5, "NULL_EMPTY", 5)])
def test_sample_diff_on_seeds(spark, table, column, samples, label, affected):
    p = seeds.pair(spark, table)
    got = value_diff.sample_diff(p, column).collect()
    assert len(got) == samples and {r.diff_type for r in got} == {label}
    assert value_diff.sampled_totals(p, [column]).first().affected_rows == affected


def test_lost_rows_count_as_affected(spark):
    p = seeds.pair(spark, "inventory_transaction")
    assert value_diff.sampled_totals(p, ["txn_ts"]).first().affected_rows == 25
    labels = {r.diff_type: r.row_count for r in value_diff.diff_type_summary(p, ["txn_ts"]).collect()}
    assert labels == {"TZ_DRIFT": 19, "MISSING_VALUE": 6}


def test_lost_row_with_null_value_is_affected_but_no_value_diff(spark):
    p = make_pair(spark, [(1, None, 1.0), (2, "a", 1.0)], [(2, "a", 1.0)])
    assert [tuple(r) for r in value_diff.sampled_totals(p, ["a"]).collect()] == [("t", "a", 1, "MISSING_ROW")]
    assert value_diff.diff_type_summary(p, ["a"]).count() == 0
    assert value_diff.count_affected(p, ["a"]).first().affected_rows == 1


def test_samples_are_ordered_by_key_text(spark):
    p = make_pair(spark, [(i, "x", 1.0) for i in (2, 10, 100, 9)], [(i, "y", 1.0) for i in (2, 10, 100, 9)])
    assert [r.pk for r in value_diff.sample_diff(p, "a", limit=3).collect()] == ["10", "100", "2"]


def test_window_cuts_each_side_by_key(spark):
    p = make_pair(spark, [(i, "x", 1.0) for i in range(10)], [(i, "x", 1.0) for i in range(5, 10)])
    got = value_diff.sample_diff(p, "a", limit=10, window_rows=5).collect()
    assert [(r.pk, r.diff_type) for r in got] == [(str(i), "MISSING_VALUE") for i in range(5)]


def test_unknown_column(spark):
    with pytest.raises(ValueError, match="no column"):
        value_diff.sample_diff(seeds.pair(spark, "vendor"), "nope")


def test_row_status_and_key_sets(spark, rows):
    p = make_pair(spark, [(1, "a", 1.0), (2, "b", None), (3, "c", 1.0)], [(2, "b", None), (3, "c", 2.0), (4, "d", 1.0)])
    assert dict(rows(value_diff.row_status(p))) == {1: "SOURCE_ONLY", 2: "MATCH", 3: "CHANGED", 4: "TARGET_ONLY"}
    assert rows(value_diff.missing_keys(p), "k") == [(1,)] and rows(value_diff.extra_keys(p), "k") == [(4,)]
    assert rows(value_diff.common_keys(p)) == [(2,), (3,)]


def test_all_null_row_is_present(spark, rows):
    p = make_pair(spark, [(1, None, None)], [(1, None, None)])
    assert rows(value_diff.row_status(p)) == [(1, "MATCH")]


def test_keys_of_different_types_compare_by_text(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, a STRING")
    target = spark.createDataFrame([("1", "a")], "k STRING, a STRING")
    p = TablePair("t", "k", source, target)
    assert [r.k for r in value_diff.missing_keys(p).collect()] == ["2"]
    assert row_recon.row_recon([p]).first().delta == 1


def test_repeated_keys_do_not_multiply(spark, rows):
    source = [(7, "a", 1.0)] * 3000 + [(i, "a", 1.0) for i in range(100, 200)]
    target = [(7, "a", 1.0)] * 2000 + [(i, "a", 2.0) for i in range(100, 200)]
    p = make_pair(spark, source, target)
    counts = {r.row_status: r.row_count for r in value_diff.row_status_counts(p).collect()}
    assert counts == {"DUPLICATE_KEY": 1, "CHANGED": 100}
    found = value_diff.value_diffs(p).collect()
    assert len(found) == 101
    assert [(r.pk, r.column_name, r.source_value, r.target_value) for r in found if r.diff_type == "DUPLICATE_KEY"] == [("7", "k", "3000", "2000")]


def test_lost_row_of_a_repeated_key_is_reported(spark, rows):
    p = make_pair(spark, [(1, "a", 1.0), (1, "b", 1.0), (2, "x", 1.0), (None, "n", 1.0)], [(1, "b", 1.0), (2, "x", 1.0), (None, "m", 1.0)])
    assert rows(value_diff.row_status_rows(p)) == [("DUPLICATE_KEY", 1, 2, 1), ("MATCH", 1, 1, 1), ("NULL_KEY", 1, 1, 1)]
    assert {r.affected_rows for r in value_diff.count_affected(p).collect()} == {3}
    assert rows(value_diff.diff_type_summary(p, ["a"]), "diff_type", "row_count") == [("DUPLICATE_KEY", 2), ("NULL_KEY", 1)]


def test_names_that_meet_internal_ones(spark, rows):
    ddl = "s BIGINT, `a.b` STRING, rows_ STRING, t STRING"
    source, target = (spark.createDataFrame([(1, v, v, v)], ddl) for v in ("x", "y"))
    p = TablePair("t", "s", source, target)
    assert {r.column_name for r in value_diff.value_diffs(p, ["a.b", "rows_", "t"]).collect()} == {"a.b", "rows_", "t"}
    assert {r.row_count for r in value_diff.diff_type_summary(p, ["a.b", "rows_", "t"]).collect()} == {1}


def test_totals_follow_the_window(spark):
    p = make_pair(spark, [(i, "x", 1.0) for i in range(10)], [(i, "y", 1.0) for i in range(10)])
    assert value_diff.sampled_totals(p, ["a"], window_rows=4).first().affected_rows == 4
    assert value_diff.count_affected(p, ["a"], window_rows=4).first().affected_rows == 4


def test_alignment_against_brute_force(spark):
    rng = random.Random(11)
    source = {k: (rng.choice(["", "a", None]), rng.choice([1.0, 1.001, None])) for k in range(0, 200)}
    target = {k: (rng.choice(["", "a", None]), rng.choice([1.0, 1.001, None])) for k in range(50, 260)}
    p = make_pair(spark, [(k, *v) for k, v in source.items()], [(k, *v) for k, v in target.items()])
    expected = {}
    for i, column in enumerate(("a", "b")):
        expected[column] = sum(1 for k in source if k not in target or source[k][i] != target[k][i])
    assert {r.column_name: r.affected_rows for r in value_diff.count_affected(p).collect()} == expected


def test_key_checks_agree_with_each_other(spark):
    """Exact comparison, fingerprints and buckets decide alike, whatever the difference."""
    base = [(i, "a", 1.0) for i in range(50)]
    cases = {"same": base[::-1], "lost": base[1:], "renamed": [(99, "a", 1.0), *base[1:]], "repeated": [*base[1:], base[1]]}
    for name, target in cases.items():
        p = make_pair(spark, base, target)
        exact = row_recon.key_checksum_exact([p]).first().checksum_match
        assert exact is (name == "same"), name
        assert row_recon.row_recon([p]).first().checksum_match is exact
        prints = {r.side: (r.row_count, r.fingerprint) for r in row_recon.key_fingerprint([p]).collect()}
        assert (prints["source"] == prints["target"]) is exact
        assert (row_recon.bucket_fingerprint(p, 8).count() == 0) is exact


def test_empty_tables_match(spark):
    got = row_recon.row_recon([make_pair(spark, [], [])]).first()
    assert (got.source_count, got.target_count, got.checksum_match, got.row_status, got.delta_pct) == (0, 0, True, "MATCH", 0.0)
    assert row_recon.key_checksum_exact([make_pair(spark, [], [])]).first().checksum_match


def test_bucket_fingerprint_localises_a_value_change(spark):
    rows_ = [(i, "a", 1.0) for i in range(500)]
    changed = [(i, "z" if i == 77 else "a", 1.0) for i in range(500)]
    p = make_pair(spark, rows_, changed)
    assert row_recon.bucket_fingerprint(p, 32).count() == 0
    assert row_recon.bucket_fingerprint(p, 32, ["a"]).count() == 1


def test_narrowed_pair_gives_the_same_differences(spark, rows):
    base = [(i, "a", 1.0) for i in range(2000)] + [(None, "n", 1.0)]
    target = [(i, "z" if i in (5, 900) else "a", 1.0) for i in range(2000) if i != 44] + [(None, "m", 1.0), (7, "a", 1.0)]
    p = make_pair(spark, base, target)
    cut = row_recon.narrow_to_changed(p, buckets=512)
    assert 0 < cut.source.count() < 60
    assert rows(value_diff.value_diffs(cut)) == rows(value_diff.value_diffs(p))
    assert rows(value_diff.diff_type_summary(cut)) == rows(value_diff.diff_type_summary(p))
    same = row_recon.narrow_to_changed(TablePair("t", "k", p.source, p.source), buckets=512)
    assert same.source.count() == 0 and same.target.count() == 0


def test_shuffle_partitions_follow_the_input():
    assert [shuffle_partitions(n) for n in (0, 1 << 30, 100 << 40)] == [8, 8, 409_600]
    assert shuffle_partitions(1 << 40) == 4096


def test_offset_profile_separates_clock_drift_from_stale_rows(spark, rows):
    zone = value_diff.ts_offset_profile(seeds.pair(spark, "inventory"), ["last_counted_ts"])
    assert rows(zone, "offset_seconds", "row_count", "share") == [(18000, 20, 1.0)]
    stale = value_diff.ts_offset_profile(seeds.pair(spark, "vendor"), ["updated_ts"])
    assert rows(stale, "offset_seconds", "row_count") == [(-40 * 86400, 9), (0, 11)]


def test_constraint_checks(spark, rows):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "fk BIGINT")
    parent = spark.createDataFrame([(2,), (2,)], "id BIGINT")
    assert rows(checks.orphan_keys(child, "fk", parent, "id")) == [(1, 2)]
    assert rows(checks.duplicate_keys(child.na.drop(), "fk")) == [(1, 2)]
    assert rows(checks.null_violations(child, ["fk"])) == [("fk", 1)]
    assert checks.count_non_null(child, ["fk"]).first().fk == 3


def test_first_n(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "k INT")
    assert [r.k for r in value_diff.first_n_by_key(df, "k", 2).collect()] == [1, 2]
    assert df.filter(F.col("k") > 5).count() == 0


NAMED = "`k.id` BIGINT, `a.b` STRING, m MAP<STRING, INT>, n STRUCT<x: ARRAY<MAP<STRING, INT>>>"


@pytest.fixture
def oddly_named(spark):
    """Names with dots, and maps at any depth: equal in 1 whatever the order of entries, different in 2, absent in 3 and 4."""
    def nested(m):
        return ([m],)

    source = [(1, "x", {"p": 1, "q": 2}, nested({"p": 1, "q": 2})), (2, "x", {"p": 1}, nested({"p": 1})), (3, None, None, None)]
    target = [(1, "x", {"q": 2, "p": 1}, nested({"q": 2, "p": 1})), (2, "y", {"p": 2}, nested({"p": 2})), (4, None, None, None)]
    return TablePair("t", "k.id", spark.createDataFrame(source, NAMED), spark.createDataFrame(target, NAMED))


@pytest.mark.parametrize("run", [
    value_diff.missing_keys, value_diff.extra_keys, lambda p: value_diff.common_keys(p).limit(1), lambda p: value_diff.first_n_by_key(p.source, p.key, 1),
    lambda p: value_diff.value_diffs(p).limit(1), lambda p: value_diff.count_affected(p).where("affected_rows = 2").limit(1),
    lambda p: value_diff.sample_diff(p, "a.b").limit(1), lambda p: value_diff.sample_diff(p, "m", window_rows=2).limit(1),
    lambda p: checks.duplicate_keys(p.source.union(p.source.limit(1)), p.key), lambda p: checks.null_violations(p.source, ["a.b"]),
    lambda p: checks.orphan_keys(p.source, p.key, p.target, p.key), lambda p: checks.count_non_null(p.source, ["a.b", "m"]),
    lambda p: row_recon.row_recon([p], "row"), lambda p: row_recon.row_recon([p]), lambda p: row_recon.key_checksum_exact([p]),
    lambda p: row_recon.row_fingerprint([p]).limit(1), lambda p: row_recon.key_fingerprint([p]).limit(1),
    lambda p: value_diff.row_status(row_recon.narrow_to_changed(p)).where("row_status = 'CHANGED'")])
def test_dotted_names_and_maps(oddly_named, run):
    assert len(run(oddly_named).collect()) == 1


def test_maps_compare_by_entries(oddly_named):
    assert {tuple(r)[:2] for r in value_diff.row_status(oddly_named).collect()} == {
        (1, "MATCH"), (2, "CHANGED"), (3, "SOURCE_ONLY"), (4, "TARGET_ONLY")}
    counts = {(r.column_name, r.diff_type): r.row_count for r in value_diff.diff_type_summary(oddly_named).collect()}
    assert counts == {("a.b", "VALUE_MISMATCH"): 1, ("m", "VALUE_MISMATCH"): 1, ("n", "VALUE_MISMATCH"): 1}


def test_odd_keys_are_looked_for_once(spark):
    pairs = value_diff.checked([make_pair(spark, [(1, "x", 1.0), (1, "y", 1.0), (2, "x", 1.0)], [(2, "x", 1.0)]),
                                make_pair(spark, [(1, "x", 1.0)], [(1, "x", 1.0)])])
    assert [p.odd_keys.count for p in pairs] == [1, 0]
    assert value_diff.checked(pairs) == pairs
    assert {tuple(r)[:2] for r in value_diff.row_status(pairs[0]).collect()} == {(1, "DUPLICATE_KEY"), (2, "MATCH")}
