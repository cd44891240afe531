from __future__ import annotations

import re

import numpy as np
import xxhash

from driftwarden.llm import registry, simhash
from driftwarden.llm.components import connected_components
from tests.llm.conftest import ODD


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= radius:
                a_root, b_root = find(i), find(j)
                parent[max(a_root, b_root)] = min(a_root, b_root)
    return [find(i) for i in range(len(prints))]


def test_query_equals_brute_force(spark, sf_dir, sample):
    ids = sorted(sample)
    prints = [plain_fingerprint(sample[i].text) for i in ids]
    roots = plain_components(prints)
    expected = {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots)}
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op1_simhash_components(spark, sf_dir).collect()}
    assert found == expected


def test_odd_rows(documents):
    rows = simhash.near_duplicates(documents(*ODD)).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {by_id[i].component_id for i in (1, 2, 3)} == {1}
    assert by_id[1].fp == bytes(8) and by_id[5].component_id == by_id[6].component_id == 5
    assert [r.component_id for r in rows if r.doc_id is None and r.fp == bytes(8)] == [1]
    assert simhash.near_duplicates(documents(*ODD).limit(0)).count() == 0


def test_links_are_lossless_in_one_lane(spark):
    draw = np.random.default_rng(1)
    prints = []
    for _ in range(60):  # clusters of fingerprints a few bits apart
        at = int(draw.integers(0, 1 << 63))
        for _ in range(6):
            prints.append(at)
            for bit in draw.integers(0, 64, draw.integers(1, 4)):
                at ^= 1 << int(bit)
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in prints], "fp binary")
    for blocks in (5, 6, 7):
        stars = connected_components(simhash.links(nodes, len(prints), 1, 4, blocks)).collect()
        root = {bytes(r.node): bytes(r.root) for r in stars}
        found = [root.get(p.to_bytes(8, "big"), p.to_bytes(8, "big")) for p in prints]
        assert found == [prints[r].to_bytes(8, "big") for r in plain_components(prints)]


def test_breadth_first_search_spans_large_keys():
    draw = np.random.default_rng(2)
    fps = np.array([1 << int(b) for b in range(64)] + draw.integers(0, 1 << 63, 100).tolist(), np.uint64)[:, None]
    edges = simhash.spanning_edges(fps, simhash.references(6), 4)
    assert len(edges) == 63 and all(max(e) < 64 for e in edges)


def test_pivots_bound_distances():
    draw = np.random.default_rng(3)
    fps = draw.integers(0, 1 << 63, (200, 1)).astype(np.uint64)
    table = simhash.pivot_table(fps, simhash.references(6))
    for u in range(0, 200, 7):
        apart = np.abs(table - table[u]).max(axis=2).sum(axis=1)
        assert (apart <= np.bitwise_count(fps ^ fps[u]).sum(axis=1)).all()


def test_keep_one_keeps_the_smallest_of_each_group(documents):
    words = [f"w{i}" for i in range(300)]
    copy = [*words[:150], "changed", *words[151:]]
    docs = documents((5, " ".join(words)), (3, " ".join(copy)), (9, " ".join(words)), (3, " ".join(copy)), (4, " ".join(words[::-1])), (None, "x y z"))
    kept = simhash.keep_one(docs, **simhash.SIMILAR)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, None]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 499), (7, 7)], "u long, v long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 500: 499}


def test_the_shingles_decide_at_the_limit(documents):
    def jaccard(a, b):
        a, b = ({tuple(x.split()[i:i + 5]) for i in range(len(x.split()) - 4)} for x in (a, b))
        return len(a & b) / len(a | b)

    draw, rows, near = np.random.default_rng(4), [], []
    for i in range(60):  # half of the pairs just above 0.8, half below
        words = [f"w{x}" for x in draw.integers(0, 1 << 40, 400)]
        copy = list(words)
        for at in range(3, 400, 400 // (8 if i % 2 else 11)):
            copy[at] = f"c{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        near.append(jaccard(rows[-2][1], rows[-1][1]) >= 0.8)
    assert 20 <= sum(near) <= 40
    kept = {r.doc_id for r in simhash.keep_one(documents(*rows), **simhash.SIMILAR).collect()}
    assert kept == {2 * i for i in range(60)} | {2 * i + 1 for i in range(60) if not near[i]}


def test_tiles_of_a_large_group_lose_no_link(documents, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_TEXTS", 4)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[:10 * i], f"c{i}", *words[10 * i + 1:]])) for i in range(25)]
    assert [r.doc_id for r in simhash.keep_one(documents(*rows), **simhash.SIMILAR).collect()] == [0]
