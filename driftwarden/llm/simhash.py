"""SimHash near-duplicates found through pivot distance tables.

Each fingerprint gets a row of Hamming distances to fixed reference fingerprints (pivots). The references come in
one family per block of bits, each with ones only inside its block, next to the all-zero reference. By the triangle
inequality two fingerprints within ``r`` bits differ by at most ``r`` in every coordinate, and in a block without a
differing bit their coordinates relative to the zero reference are equal. Of ``blocks`` blocks at most ``r`` can hold
a differing bit, so linked fingerprints agree on the coordinates of at least ``blocks - r`` blocks: those coordinates
are the key by which rows are dealt, which makes the search lossless without comparing all pairs. Inside a key, pairs
whose largest coordinate difference exceeds ``r`` are discarded and the survivors verified bit by bit.

Distances of random 64-bit fingerprints crowd around 32, so a window on one pivot lets over half of all pairs pass;
this is why the table is dealt by whole groups of coordinates and not scanned by windows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from driftwarden.llm.common import by_shuffle, give_back, materialize, set_aside, small_side, text_hash
from driftwarden.llm.components import connected_components

BITS = 64
SEED = 42
#: References in each block's family, and the seed from which they are drawn.
REFERENCES, REFERENCE_SEED = 8, 7
#: Shingles whose bits are counted at once, so that memory does not grow with a text.
SHINGLES_AT_ONCE = 1 << 15
#: Keys with up to so many rows have all their pairs compared side by side; larger ones are searched breadth first.
FEW_ROWS = 16

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None, shingle_words: int = 4, lanes: int = 1) -> bytes:
    """Big-endian fingerprint of ``8 * lanes`` bytes; NULL and texts without a word give zeros.

    Lane ``i`` takes the hashes with seed ``42 + i``. Fewer words than a shingle form one shingle.
    """
    words = text.translate(_FOLD).split() if text else []
    if not words:
        return bytes(8 * lanes)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(shingle_words, len(words))
    spans = list(zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()))
    out = []
    for lane in range(lanes):
        counts = np.zeros(BITS, np.int64)
        for at in range(0, len(spans), SHINGLES_AT_ONCE):
            part = spans[at:at + SHINGLES_AT_ONCE]
            digests = b"".join([xxhash.xxh64_digest(joined[s:e], SEED + lane) for s, e in part])
            counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * counts > len(spans)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, shingle_words: int = 4, lanes: int = 1) -> DataFrame:
    """``(doc_id, text_key, fp)`` for every row of ``docs``; other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle_words, lanes) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())],
                                             ["doc_id", "text_key", "fp"])

    return docs.select("doc_id", text_hash().alias("text_key"), F.col("text").cast("binary").alias("t")).mapInArrow(
        run, "doc_id long, text_key long, fp binary")


def blocks_for(rows: int, radius: int) -> int:
    """Fewest blocks, two beyond the radius at least, whose keys keep the expected rows of a key below about eight."""
    for blocks in range(radius + 2, BITS // 4):
        if rows / 2 ** (BITS * (blocks - radius) / blocks) < 8:
            return blocks
    return BITS // 4


def block_masks(blocks: int) -> list[int]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]


def references(blocks: int) -> np.ndarray:
    """The pivots: the zero fingerprint, then ``REFERENCES`` random patterns inside each block."""
    draw = np.random.default_rng(REFERENCE_SEED)
    table = [sum(1 << i for i in range(BITS) if mask >> i & 1 and draw.random() < 0.5)
             for mask in block_masks(blocks) for _ in range(REFERENCES)]
    return np.array([0, *table], np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (any shape) to the pivots, along a new last axis."""
    return np.bitwise_count(fps[..., None] ^ pivots).astype(np.int8)


def _keys(fps: np.ndarray, lane: int, pivots: np.ndarray, combos: list[tuple[int, ...]]) -> np.ndarray:
    """``n x combos`` keys: a hash of the coordinates, relative to the zero reference, of the combination's blocks."""
    table = pivot_table(fps, pivots)
    relative = (table[:, 1:] - table[:, :1]).reshape(len(fps), -1, REFERENCES)
    keys = np.empty((len(fps), len(combos)), np.int64)
    for c, combo in enumerate(combos):
        rows = np.ascontiguousarray(relative[:, combo, :]).reshape(len(fps), -1)
        seed = lane * 1000 + c
        keys[:, c] = [xxhash.xxh64_intdigest(r, seed) - (1 << 63) for r in map(np.ndarray.tobytes, rows)]
    return keys


def _close(fps: np.ndarray, table: np.ndarray, others: np.ndarray, u: int, max_bits: int) -> np.ndarray:
    """Which of ``others`` link to ``u``: the coordinates discard, the bits verify.

    Lanes are disjoint bits, so the largest coordinate differences of the lanes add up to a lower bound.
    """
    near = others[np.abs(table[others] - table[u]).max(axis=2, initial=0).sum(axis=1, dtype=np.int64) <= max_bits]
    return near[np.bitwise_count(fps[near] ^ fps[u]).sum(axis=1, dtype=np.int64) <= max_bits]


def spanning_edges(fps: np.ndarray, pivots: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the links among ``fps`` (``n x lanes``), so never more than ``n - 1``.

    Searched breadth first: a fingerprint leaves the list once it is reached, so groups of near-equal fingerprints cost
    about one pass. ``left`` stays in order of one coordinate, of which only the window of ``max_bits`` is looked at.
    """
    table = pivot_table(fps, pivots)
    first = table[:, 0, 0].astype(np.int64)
    left, edges = np.argsort(first, kind="stable"), []
    while left.size > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and left.size:
            u = frontier.pop()
            a, b = np.searchsorted(first[left], (first[u] - max_bits, first[u] + max_bits + 1))
            reached = _close(fps, table, left[a:b], u, max_bits)
            if reached.size:
                edges += [(u, v) for v in reached]
                frontier += reached.tolist()
                left = left[~np.isin(left, reached)]
    return edges


def links(nodes: DataFrame, rows: int, lanes: int, max_bits: int, blocks: int | None = None, agree: int | None = None) -> DataFrame:
    """Spanning links ``(u, v)`` among the distinct fingerprints ``nodes.fp``.

    One lane: lossless. Several lanes: a pair is found if in some lane the coordinates of ``agree`` blocks agree, and
    verified over all lanes.
    """
    blocks = blocks or blocks_for(rows, max_bits)
    agree = agree or blocks - max_bits
    pivots = references(blocks)
    combos = list(itertools.combinations(range(blocks), agree))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            fps = np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(-1, lanes)
            for lane in range(lanes):
                keys = _keys(fps[:, lane], lane, pivots, combos)
                for c in range(len(combos)):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, c]), batch.column(0)], ["key", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.zeros(0, np.int64), []

        def found(keys: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
            fps = np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(-1, lanes)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(keys)])
            pairs = [(s + u, s + v) for s, n in zip(starts[sizes > FEW_ROWS], sizes[sizes > FEW_ROWS])
                     for u, v in spanning_edges(fps[s:s + n], pivots, max_bits)]
            few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= FEW_ROWS), sizes))
            keys, fps = keys[few], fps[few]
            table = pivot_table(fps, pivots)
            for apart in range(1, min(FEW_ROWS, len(few))):
                u = np.flatnonzero(keys[apart:] == keys[:-apart])
                if not u.size:
                    break
                u = u[np.abs(table[u] - table[u + apart]).max(axis=2).sum(axis=1, dtype=np.int64) <= max_bits]
                u = u[np.bitwise_count(fps[u] ^ fps[u + apart]).sum(axis=1, dtype=np.int64) <= max_bits]
                pairs += zip(few[u], few[u + apart])
            return pa.RecordBatch.from_arrays([pa.array([raw[u] for u, _ in pairs], pa.binary()),
                                               pa.array([raw[v] for _, v in pairs], pa.binary())], ["u", "v"])

        for batch in batches:  # sorted by key; the last key may go on in the next batch
            keys, raw = np.r_[held_keys, batch.column(0).to_numpy()], held + batch.column(1).to_pylist()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield found(keys[:cut], raw[:cut])
            held_keys, held = keys[cut:], raw[cut:]
        yield found(held_keys, held)

    dealt = nodes.select("fp").mapInArrow(deal, "key long, fp binary")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(link, "u binary, v binary")


def near_duplicates(docs: DataFrame, shingle_words: int = 4, lanes: int = 1, max_bits: int = 4,
                    blocks: int | None = None, agree: int | None = None) -> DataFrame:
    """``(doc_id, text_key, fp, root, component_id)`` for every row of ``docs``.

    ``root`` names the group (a fingerprint), ``component_id`` is its smallest doc_id. NULL and empty texts share the
    zero fingerprint; a NULL doc_id is never the smallest, and a group without any other has a NULL component_id;
    repeated rows stay repeated; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, shingle_words, lanes), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    stars = connected_components(links(nodes, nodes.count(), lanes, max_bits, blocks, agree))
    rooted = materialize(nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    # written, so that the join has plain shuffles below and a large group can be split
    groups = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "groups")
    return fps.join(rooted.select("fp", "root").join(groups, "root"), "fp").select(
        "doc_id", "text_key", "fp", "root", "component_id")


def bits_for_similarity(similarity: float, lanes: int) -> int:
    """Differing bits that ``lanes`` fingerprints show on average at a Jaccard similarity of the shingles.

    Sets of equal size with that similarity have the cosine ``2 s / (1 + s)``, and each bit differs with the
    probability angle / pi.
    """
    return math.floor(lanes * BITS * math.acos(2 * similarity / (1 + similarity)) / math.pi)


#: Texts, and bytes of shingles, of a candidate group that meet in one tile with as many others.
TILE_TEXTS, TILE_BYTES = 1024, 16 << 20


def shingle_set(text: bytes | None, shingle_words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles, the same shingles that ``fingerprint`` counts."""
    words = text.translate(_FOLD).split() if text else []
    width = min(shingle_words, len(words))
    spans = range(len(words) - width + 1 if words else 0)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), SEED) for i in spans], np.uint64))


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def similar_edges(fps: np.ndarray, sets: list[np.ndarray], max_bits: int, similarity: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the pairs within ``max_bits`` whose shingle sets have the ``similarity``."""
    left, sizes, edges = np.arange(len(sets)), np.array([len(x) for x in sets]), []
    while left.size > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and left.size:
            u = frontier.pop()
            near = left[np.minimum(sizes[left], sizes[u]) >= similarity * np.maximum(sizes[left], sizes[u]) - 1e-9]
            near = near[np.bitwise_count(fps[near] ^ fps[u]).sum(axis=1, dtype=np.int64) <= max_bits]
            reached = [v for v in near if _similar(sets[u], sets[v], similarity)]
            edges += [(u, v) for v in reached]
            frontier += reached
            left = left[~np.isin(left, reached)]
    return edges


def verified(docs: DataFrame, grouped: DataFrame, shingle_words: int, max_bits: int, similarity: float) -> DataFrame:
    """``(doc_id, text_key, root)``: the candidate groups of ``near_duplicates`` split by the similarity of the shingle sets.

    Every two texts of a candidate group meet in some tile of bounded size; a tile passes on spanning links of what is
    similar in it, so the groups are those of all similar pairs.
    """
    grouped = materialize(grouped.select("doc_id", "text_key", "fp", "root"), "candidate-groups")
    texts = materialize(grouped.groupBy("text_key").agg(
        F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("root").alias("root")), "texts")
    many = materialize(texts.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "large-groups")
    members = small_side(materialize(texts.join(many.select("root"), "root"), "members")).withColumnsRenamed(
        {"text_key": "key__", "least": "least__"})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle_words).tobytes() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["text_key", "fp", "root", "shingles"])

    rows = docs.select("doc_id", "text", text_hash().alias("text_key")).join(
        members, F.expr("text_key = key__ AND doc_id <=> least__")).select("text_key", "fp", "root", F.col("text").cast("binary"))
    sets = materialize(rows.mapInArrow(hashed, "text_key long, fp binary, root binary, shingles binary"), "shingles")
    parts = materialize(sets.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / TILE_TEXTS), F.ceil(F.sum(F.octet_length("shingles")) / TILE_BYTES)).cast("int").alias("parts")), "tiles")
    own = F.pmod(F.xxhash64("text_key"), F.col("parts")).cast("int")
    tiled = sets.join(parts, "root").withColumn("p", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "root", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "text_key", "fp", "shingles")

    def link(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.drop_duplicates("text_key")
        keys = tile["text_key"].to_numpy(np.int64)
        fps = np.frombuffer(b"".join(tile["fp"]), ">u8").astype(np.uint64).reshape(len(tile), -1)
        edges = similar_edges(fps, [np.frombuffer(x, np.uint64) for x in tile["shingles"]], max_bits, similarity)
        at = np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": keys[at[:, 0]], "v": keys[at[:, 1]]})

    stars = connected_components(tiled.groupBy("root", "i", "j").applyInPandas(link, "u long, v long"))
    stars = stars.select(F.col("node").alias("text_key"), "root")
    return grouped.select("doc_id", "text_key").join(stars, "text_key", "left").select(
        "doc_id", "text_key", F.coalesce("root", "text_key").alias("root"))


#: Candidates for a similarity of 0.8 of the five-word shingles: there 48 of 320 bits differ on average (see
#: ``bits_for_similarity``) with a spread of 6, and one pair in 300 meets in no key or is further apart.
SIMILAR = {"shingle_words": 5, "lanes": 5, "max_bits": 75, "blocks": 8, "agree": 2, "similarity": 0.8}


def keep_one(docs: DataFrame, similarity: float | None = None, **params) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id, NULL last, then the smallest text hash.

    With a ``similarity`` fingerprints only give candidates, and the shingle sets decide. Further columns may have any name.
    """
    none = F.lit(-(1 << 63))
    first = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "text_key")
    rows = set_aside(docs)
    groups = near_duplicates(rows, **params)
    if similarity is not None:
        groups = verified(rows, groups, params["shingle_words"], params["max_bits"], similarity)
    kept = groups.withColumn("rn", F.row_number().over(first)).where("rn = 1").select(
        F.coalesce("doc_id", none).alias("id__"), F.col("text_key").alias("key__"))
    one = Window.partitionBy("id__", "key__").orderBy(F.lit(1))
    keyed = rows.withColumns({"id__": F.coalesce("doc_id", none), "key__": text_hash()})
    return give_back(keyed.join(by_shuffle(kept), ["id__", "key__"]).withColumn("rn__", F.row_number().over(one)).where("rn__ = 1"), docs)
