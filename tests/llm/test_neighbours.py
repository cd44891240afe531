from __future__ import annotations

from collections import defaultdict

import numpy as np

from driftwarden.llm import neighbours, registry

SCHEMA = "vec_id long, vector array<float>, rep string"


def plain(rows, every, k):
    """Brute force over ``(vec_id, vector)``: query id to [(score, -vec_id)], best first."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        scores = x @ x[at]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[at]][:k]
        out[int(ids[at])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def by_query(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(found, expected):
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in e}) for q, e in expected.items())
    return hits / sum(map(len, expected.values()))


def test_query_recall(spark, sf_dir):
    found = by_query(registry.op10_nearest_neighbours(spark, sf_dir).collect())
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected = plain(rows, 20, 20)
    assert found.keys() == expected.keys() and all(len(f) == 20 for f in found.values())
    assert recall(found, expected) >= 0.9


def test_recall_with_many_fine_buckets(spark):
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(200, 24))
    x = centres[draw.integers(0, 200, 6000)] + 0.35 * draw.normal(size=(6000, 24))
    rows = [(i, (v * (1 + i % 3)).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = by_query(neighbours.nearest(df, 40, 10, tables=16, probes=24, bucket_rows=16).collect())
    assert neighbours.CrossPolytope(24, 6000, 16, 16).fine > 0
    assert recall(found, plain(rows, 40, 10)) >= 0.9


def test_odd_rows_and_ties(spark):
    base = [(i, [float(i % 7), 1.0, 0.5]) for i in range(60)]
    odd = [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 0.0]), (160, [float("nan"), 1.0, 0.0]), (180, [float("inf"), 1.0, 0.0]),
           (None, [1.0, 1.0, 1.0]), (40, [5.0, 1.0, 0.5])]
    df = spark.createDataFrame([(*r, "x") for r in base + odd + base[:3]], SCHEMA)
    found = by_query(neighbours.nearest(df).collect())
    expected = plain(base, 20, 20)
    assert found.keys() == expected.keys()
    for q, rows in expected.items():
        assert [(i, round(s, 9)) for i, s in found[q]] == [(i, round(s, 9)) for i, s in rows]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_fewer_rows_than_asked_for(spark):
    rows = [(i, [1.0, float(i)]) for i in range(0, 100, 20)]
    found = by_query(neighbours.nearest(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect())
    assert {q: len(f) for q, f in found.items()} == {i: 4 for i, _ in rows}
    assert recall(found, plain(rows, 20, 20)) == 1


def test_too_few_candidates_are_made_up_for(spark):
    draw = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(900, 16)))]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = by_query(neighbours.nearest(df, 100, 20, tables=1, probes=1, bucket_rows=4).collect())
    expected = plain(rows, 100, 20)
    assert all(len(found[q]) == 20 for q in expected) and recall(found, expected) > 0.99


def test_hadamard_keeps_inner_products():
    x = np.random.default_rng(13).normal(size=(5, 32))
    y = neighbours.hadamard(x)
    assert np.allclose(x @ x.T, y @ y.T)


def test_probes_follow_the_number_of_vectors(spark):
    draw = np.random.default_rng(14)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(12_000, 64)))]
    rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = by_query(neighbours.nearest(df, 60, bucket_rows=16).collect())  # as many buckets as 384,000 vectors have
    assert recall(found, plain(rows, 60, 20)) >= 0.9


def test_buckets_keep_their_size():
    for rows in (10 ** 5, 10 ** 7, 10 ** 9, 10 ** 11):
        for dim in (3, 64, 768):
            assert rows / 2 / neighbours.CrossPolytope(dim, rows, 1).count <= neighbours.BUCKET_ROWS, (rows, dim)


def test_probes_are_the_least_costs_over_three_parts():
    hashes = neighbours.CrossPolytope(4, 300, 2, 1)
    assert len(hashes.axes) == 3
    x = np.random.default_rng(15).normal(size=(20, 4))
    for table in (0, 1):
        parts = hashes.projections(x, table)
        cost = np.zeros((20, 1))
        for p in parts:
            cost = (cost[:, :, None] + ((p.max(axis=1, keepdims=True) - p) ** 2)[:, None, :]).reshape(20, -1)
        found = hashes.probes(x, table, 9)
        assert (found[:, 0] == hashes.buckets(x, table)).all() and hashes.count == cost.shape[1]
        assert np.allclose(np.take_along_axis(cost, found, 1), np.sort(cost, axis=1)[:, :9])


def test_recall_with_three_parts(spark):
    draw = np.random.default_rng(16)
    centres = draw.normal(size=(300, 8))
    x = centres[draw.integers(0, 300, 6000)] + 0.1 * draw.normal(size=(6000, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert len(neighbours.CrossPolytope(8, 6000, 1, 8).axes) == 3
    found = by_query(neighbours.nearest(df, 40, 10, probes=32, bucket_rows=8).collect())
    assert recall(found, plain(rows, 40, 10)) >= 0.9


def test_many_queries_against_all(spark, monkeypatch):
    """More blocks than one, written one after the other."""
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    draw = np.random.default_rng(17)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(400, 16)))]
    found = by_query(neighbours.nearest(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), 10, 20, tables=1, probes=1, bucket_rows=4).collect())
    expected = plain(rows, 10, 20)
    assert all(len(found[q]) == 20 for q in expected) and recall(found, expected) > 0.99
