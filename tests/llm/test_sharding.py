from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwarden.llm import registry, sharding
from tests.llm.conftest import ODD


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_shards_all_bytes_evenly(spark, sf_dir, sample):
    rows = registry.op7_shard_by_splitters(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(sample)
    check_slots(rows)
    sizes = defaultdict(int)
    for r in rows:
        raw = (sample[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r.size
    largest = max(r.size for r in rows)
    assert set(sizes) == set(range(24))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_hot_text_is_split_and_others_stay_together(documents):
    rows = [(i, "same text everywhere") for i in range(1000)] + [(i, f"pair {i // 2}") for i in range(1000, 3000)]
    placed = sharding.assign(sharding.measured(documents(*rows)), 8, ranges=64).collect()
    check_slots(placed)
    sizes, groups, texts = defaultdict(int), defaultdict(set), dict(rows)
    for r in placed:
        sizes[r.shard] += r.size
        groups[texts[r.doc_id]].add(r.shard)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in placed)
    assert len(groups["same text everywhere"]) > 1
    assert sum(len(g) > 1 for g in groups.values()) <= 8


def test_odd_rows(documents, tmp_path):
    docs = documents(*ODD)
    placed = sharding.assign(sharding.measured(docs), 3).collect()
    assert len(placed) == len(ODD)
    check_slots(placed)
    assert sharding.assign(sharding.measured(docs.limit(0)), 3).count() == 0
    sharding.write_shards(docs, str(tmp_path / "shards"), 3)
    back = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(repr, (r.text for r in back.collect()))) == sorted(repr(r[1]) for r in ODD)


def test_splitters_weigh_sizes(spark):
    rows = [(i, i, 1000 if i < 100 else 1, 0) for i in range(10_000)]
    table = sharding.materialize(spark.createDataFrame(rows, "doc_id long, key long, size long, text_crc32 long"), "t")
    bounds = sharding.splitters(table, ranges=10)
    assert (np.diff(bounds) > 0).all() and (bounds < 100).sum() >= 8


def test_written_rows_have_the_slots_of_the_assignment_and_their_columns(documents, tmp_path):
    rows = [(1, "again and again")] * 40 + [(i, f"text {i % 7} " * (i % 5)) for i in range(2, 60)] + [(None, None)] * 3
    docs = documents(*rows).withColumnRenamed("rank", "key").withColumn("id__", F.lit("mine")).withColumn("rn__", F.lit(5))
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, 4, ranges=16)
    back = docs.sparkSession.read.parquet(path)
    assert {*back.columns} == {*docs.columns, "shard", "slot"}
    found = back.collect()
    check_slots(found)
    assert sorted(repr((r.doc_id, r.text)) for r in found) == sorted(map(repr, rows))
    assert {(r.key, r.size, r.id__, r.rn__) for r in found} == {(7, "x", "mine", 5)}
    expected = sharding.assign(sharding.measured(docs), 4, ranges=16).groupBy("shard").count().collect()
    assert sorted((r.shard, r["count"]) for r in expected) == sorted(Counter(r.shard for r in found).items())
    with pytest.raises(ValueError, match="Slot"):
        sharding.write_shards(docs.withColumn("Slot", F.lit(1)), path, 4)


def test_assignment_by_brute_force(documents):
    rows = [(i % 400, f"text {i % 23} " * (i % 11)) for i in range(900)] + [(None, None), (5000, "hot " * 500)]
    placed = sharding.assign(sharding.measured(documents(*rows)), 6, ranges=32).collect()
    order = sorted(placed, key=lambda r: (r.key, r.doc_id is not None, r.doc_id or 0, r.size))
    total, upto, slots = sum(r.size for r in placed), 0, Counter()
    expected, found = Counter(), Counter()
    for r in order:
        shard = min(5, int((upto + r.size / 2) * 6 // total))
        upto += r.size
        expected[r.key, r.doc_id, r.size, shard, slots[shard]] += 1
        slots[shard] += 1
        found[r.key, r.doc_id, r.size, r.shard, r.slot] += 1
    assert found == expected
