from __future__ import annotations

from collections import Counter, defaultdict

from driftwarden.llm import mixing, registry
from tests.llm.conftest import ODD


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    targets, left, still = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-9 and still:
        share, left = left / sum(weight[s] for s in still), 0.0
        for s in sorted(still, key=str):
            targets[s] += share * weight[s]
            if targets[s] >= epochs * sizes[s]:
                left += targets[s] - epochs * sizes[s]
                targets[s] = float(epochs * sizes[s])
                still.discard(s)
    return targets


def check(rows):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    expected = plain_targets(sizes)
    assert all(r.source_size == sizes[r.source] for r in rows)
    for s in sizes:
        assert abs(target[s] - expected[s]) < 1e-6 * max(1, expected[s])
        assert abs(taken[s] - expected[s]) <= 1


def test_query_meets_targets_and_repeats(spark, sf_dir):
    rows = registry.op3_mix_sources(spark, sf_dir).collect()
    check(rows)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, registry.op3_mix_sources(spark, sf_dir).collect()))


def test_odd_rows_and_small_sources(documents):
    rows = [*ODD, *((i, "w " * (i % 9), "en", f"s{i % 4}") for i in range(20, 60)), (99, "only one here", "en", "tiny")]
    found = mixing.mix(mixing.measured(documents(*rows))).collect()
    assert len(found) == len(rows)
    check(found)
    assert mixing.mix(mixing.measured(documents(*ODD).limit(0))).count() == 0


def test_mixed_documents_are_whole_and_repeat_by_epochs(documents):
    rows = [(i, f"w{i} " * 10, "en", "abc"[i % 3] if i < 40 else "a") for i in range(200)] + [(0, "w0 " * 10, "en", "a")]
    docs = documents(*rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = Counter((r.doc_id, r.text) for r in mixed.collect())
    texts = {(i, t) for i, t, *_ in rows}
    assert set(counts) <= texts and max(counts.values()) <= 6
    words = Counter()
    for (i, t), n in counts.items():
        words["abc"[i % 3] if i < 40 else "a"] += 10 * n
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += 10
    for s, target in plain_targets(sizes).items():
        assert abs(words[s] - target) <= 10


def test_heavier_documents_are_drawn_first(spark):
    rows = [(i, i, "s", 10, 1.0 if i % 2 else 100.0) for i in range(2000)] + [(5000 + i, i, "t", 10, 1.0) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text_key long, source string, size long, quality double")
    taken = mixing.mix(mixing.materialize(df, "t"), weights=(1, 15), epochs=9).where("source = 's' AND taken > 0").collect()
    heavy = sum(r.doc_id % 2 == 0 for r in taken)
    assert heavy > 0.9 * len(taken)
