"""Repeated passages across documents, found with one FM-index per shard.

1. Sampling by minimizers: of the word 8-grams in a 50-word window, the one with the least hash is the window's anchor.
   Equal windows have equal anchors at the same place, so windows need comparing only under a common anchor. The windows
   of one anchor occurrence are consecutive and form a segment.
2. Only anchors that occur in two documents go on. Equal segments are one entry with the smallest doc_id.
3. Where an anchor has several different segments, these are dealt to shards by anchor. A shard builds an FM-index (a
   wavelet matrix over the Burrows-Wheeler transform of the segments' words) and streams the segments through it:
   backward search from each window's end gives its matching statistic, cut off as soon as nothing but the window itself
   matches, and intervals that reach 50 words report the smallest doc_id among their suffixes.
4. The reported intervals of all segments meet per document, and the words they cover are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from driftwarden.llm.common import by_shuffle, give_back, materialize, set_aside, text_hash

WINDOW, ANCHOR_WORDS = 50, 8
#: Words indexed by a shard on average.
SHARD_WORDS = 1 << 16
#: Different segments of one anchor that a shard takes; anchors with more are split (see ``repeated_segments``).
ANCHOR_SEGMENTS = 500
#: Words whose anchors are found at once: bounds memory for very long texts.
WORDS_AT_ONCE = 1 << 20
REMEMBERED = 500_000


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 1)
        return value


def segments(hashes: np.ndarray, window: int = WINDOW, gram: int = ANCHOR_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each segment of a text given as word hashes."""
    parts = []
    for at in range(0, max(0, len(hashes) - window + 1), WORDS_AT_ONCE):
        h = hashes[at:at + WORDS_AT_ONCE + window - 1]
        g = h[:len(h) - gram + 1].copy()
        for j in range(1, gram):
            g *= np.uint64(0x9E3779B97F4A7C15)
            g += h[j:len(h) - gram + 1 + j]
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(29)
        # the least of the upper hash bits, then the leftmost: both depend on the window's words alone
        low = np.uint64((1 << 21) - 1)
        best, width, wide = (g & ~low) | np.arange(len(g), dtype=np.uint64), 1, window - gram + 1
        while width < wide:
            step = min(width, wide - width)
            best, width = np.minimum(best[:-step], best[step:]), width + step
        place = best & low
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        parts.append((g[place[first].astype(np.int64)], first + at, np.diff(np.r_[first, len(place)])))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


class WaveletMatrix:
    """Bit-packed wavelet matrix: ranks of symbols in a sequence, for many positions at once."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.shifts = range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1)
        self.words, self.counts, self.zeros = [], [], []
        for shift in self.shifts:
            bits = (symbols >> shift & 1).astype(bool)
            padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
            padded[:len(bits)] = bits
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            self.zeros.append(len(bits) - int(bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def place(self, symbols: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Where ``positions`` lie after the symbols' last level; differences from position 0 are ranks."""
        for shift, words, counts, zeros in zip(self.shifts, self.words, self.counts, self.zeros):
            block = positions >> 6
            below = (np.uint64(1) << (positions & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[block] + np.bitwise_count(words[block] & below)
            positions = np.where(symbols >> shift & 1, zeros + ones, positions - ones)
        return positions


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of at least their first ``depth`` symbols, by doubling the compared length."""
    rank, length = text.astype(np.int64), 1
    while True:
        order = np.argsort(rank, kind="stable")
        if length >= depth:
            return order
        follower = np.zeros_like(rank)
        follower[:-length] = rank[length:] + 1
        pair = rank * (int(follower.max()) + 1) + follower
        order = np.argsort(pair, kind="stable")
        rank[order] = np.cumsum(np.r_[0, np.diff(pair[order]) != 0])
        length *= 2


class FmIndex:
    """Index of segments of word numbers (1 and up; 0 ends a segment) for patterns of up to ``depth`` words."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.text, alphabet = text, int(text.max()) + 1
        self.order = suffix_order(text, depth + 1)
        self.transform = WaveletMatrix(text[self.order - 1], alphabet)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=alphabet))]
        symbols = np.arange(alphabet)
        self.base = self.first[:-1] - self.transform.place(symbols, np.zeros(alphabet, np.int64))

    def matching_statistics(self, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the indexed positions ``ends``: how many words up to there, ``most`` at the most, occur elsewhere too.

        Backward search of all ends side by side; one whose interval has shrunk to itself is done. Also the intervals
        (low, high) of those that reached ``most``, 0 for the others.
        """
        low, high = self.first[self.text[ends]], self.first[self.text[ends] + 1]
        length = np.zeros(len(ends), np.int64)
        alive = np.flatnonzero(high - low > 1)
        for step in range(1, most + 1):
            length[alive] = step
            if step == most or not alive.size:
                break
            symbols = self.text[ends[alive] - step]
            both = self.base[np.r_[symbols, symbols]] + self.transform.place(
                np.r_[symbols, symbols], np.r_[low[alive], high[alive]])
            low[alive], high[alive] = both[:len(alive)], both[len(alive):]
            alive = alive[high[alive] - low[alive] > 1]
        reached = length == most
        return length, np.where(reached, low, 0), np.where(reached, high, 0)


def shard_matches(words: list[list[str]], least: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window of the shard's segments: the segment, the window's place in it, and the smallest doc_id that holds it."""
    numbers: dict[str, int] = {}
    text = np.array([numbers.setdefault(w, len(numbers) + 1) if w else 0 for s in words for w in (*s, "")], np.int64)
    sizes = np.array([len(s) for s in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    windows = sizes - window + 1
    segment = np.repeat(np.arange(len(words)), windows)
    place = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    index = FmIndex(text, window)
    _, low, high = index.matching_statistics(starts[segment] + place + window - 1, window)
    smallest = least[segment].copy()
    hit = np.flatnonzero(high)
    if hit.size:
        # intervals of patterns of one length are equal or disjoint
        lows, at = np.unique(low[hit], return_index=True)
        doc = least[np.repeat(np.arange(len(words)), sizes + 1)][index.order]
        bounds = np.stack([lows, high[hit][at]], axis=1).ravel()
        mins = np.minimum.reduceat(np.r_[doc, doc.max()], bounds)[::2]
        smallest[hit] = mins[np.searchsorted(lows, low[hit])]
    return segment, place, smallest


def covered_ranges(places: np.ndarray, window: int = WINDOW) -> list[int]:
    """Windows at sorted ``places`` to the word ranges they cover, as from, to, from, to ..."""
    if not len(places):
        return []
    gaps = np.flatnonzero(np.diff(places) > window)
    return np.stack([np.r_[places[0], places[gaps + 1]], np.r_[places[gaps], places[-1]] + window], axis=1).ravel().tolist()


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    """One row per segment of every document that has a doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows, anchors, segs, firsts, counts = [], [], [], [], []
                for i in range(at, min(at + 512, batch.num_rows)):
                    words = batch.column(2)[i].as_py().split()
                    if len(words) < window:
                        continue
                    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    anchor, first, n = segments(hashes, window)
                    raw = memoryview(hashes.tobytes())
                    rows.append(np.full(len(n), i))
                    anchors.append(anchor.view(np.int64))
                    firsts.append(first)
                    counts.append(n)
                    segs += [xxhash.xxh64_intdigest(raw[8 * f:8 * (f + k + window - 1)], 5) for f, k in zip(first.tolist(), n.tolist())]
                if rows:
                    index = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(index), batch.column(1).take(index), pa.array(np.concatenate(anchors)),
                        pa.array(np.array(segs, np.uint64).view(np.int64)), pa.array(np.concatenate(firsts).astype(np.int32)),
                        pa.array(np.concatenate(counts).astype(np.int32))], ["doc_id", "text_key", "anchor", "seg", "first", "n"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", text_hash().alias("text_key"), F.col("text").cast("binary").alias("t")).mapInArrow(
        run, "doc_id long, text_key long, anchor long, seg long, first int, n int")


def _segment_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``wanted`` segments with their words joined by blanks."""
    lists = wanted.groupBy(F.col("rep.doc_id").alias("id__"), F.col("rep.text_key").alias("key__")).agg(
        F.collect_list(F.struct("anchor", "seg", "least", "n", "shard", F.col("rep.first").alias("first"))).alias("wanted"))
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").alias("id__"), text_hash().alias("key__"), F.col("text").cast("binary").alias("t"))
    # rows alike in doc_id and text repeat their segments, which changes no result
    rows = rows.join(by_shuffle(lists), ["id__", "key__"]).select("wanted", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wanted, text in zip(batch.column(0), batch.column(1)):
                words, out = text.as_py().split(), wanted.as_py()
                yield pa.RecordBatch.from_arrays([
                    *[pa.array([x[c] for x in out], t) for c, t in (("anchor", pa.int64()), ("seg", pa.int64()), ("least", pa.int64()), ("shard", pa.int64()))],
                    pa.array([b" ".join(words[x["first"]:x["first"] + x["n"] + window - 1]) for x in out], pa.binary())],
                    ["anchor", "seg", "least", "shard", "words"])

    return rows.mapInArrow(run, "anchor long, seg long, least long, shard long, words binary")


def repeated_segments(todo: DataFrame, docs: DataFrame, window: int, shard_words: int, anchor_segments: int) -> DataFrame:
    """``(anchor, seg, ranges)``: words of each segment, relative to its start, that windows known from a smaller doc_id cover.

    Whole anchors go to a shard by hash. An anchor with more than ``anchor_segments`` different segments is split into
    as many shards of its own as needed. There a window whose smallest doc_id inside the shard is its own may still be
    known from a smaller one in a sister shard: such windows are reported with a digest and meet in one aggregate.
    """
    words = todo.agg(F.sum(F.col("n") + (window - 1))).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    parts = F.ceil(F.col("segs") / anchor_segments)
    todo = todo.withColumn("shard", F.when(F.col("segs") <= anchor_segments, F.pmod("anchor", F.lit(shards))).otherwise(
        F.xxhash64("anchor", F.pmod("seg", parts)).bitwiseOR(F.lit(-(1 << 63)))))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        split, out = key[0] < 0, []
        least = group["least"].to_numpy(np.int64)
        words = [w.split(b" ") for w in group["words"]]
        segment, place, smallest = shard_matches(words, least, window)
        known = smallest < least[segment]
        bounds = np.searchsorted(segment, np.arange(len(group) + 1))
        for i, (anchor, seg) in enumerate(zip(group["anchor"], group["seg"])):
            here = slice(bounds[i], bounds[i + 1])
            if ranges := covered_ranges(place[here][known[here]], window):
                out.append((anchor, seg, ranges, None, None))
            if split:
                out += [(anchor, seg, [int(p), int(p) + window], xxhash.xxh3_128_digest(b" ".join(words[i][p:p + window])), least[i])
                        for p in place[here][~known[here]]]
        return pd.DataFrame(out, columns=["anchor", "seg", "ranges", "digest", "least"])

    found = materialize(_segment_words(docs, todo, window).groupBy("shard").applyInPandas(
        run, "anchor long, seg long, ranges array<int>, digest binary, least long"), "shard-matches")
    open_ = found.where("digest IS NOT NULL")
    smaller = open_.groupBy("digest").agg(F.min("least").alias("smallest"), F.max("least").alias("largest")).where(
        "smallest < largest").drop("largest")
    known = open_.join(smaller, "digest").where("smallest < least").select("anchor", "seg", "ranges")
    return found.where("digest IS NULL").select("anchor", "seg", "ranges").unionByName(known)


def repeated_ranges(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
                    anchor_segments: int = ANCHOR_SEGMENTS) -> DataFrame:
    """``(doc_id, text_key, ranges)`` of documents with words covered by a window known from a smaller doc_id.

    ``ranges`` holds from, to pairs of word numbers, which may overlap; a written table. Rows with a NULL doc_id or text neither have
    nor give repeats; rows alike in doc_id and text have the same ranges; repeats inside one doc_id do not count.
    """
    every = materialize(_occurrences(docs, window), "segments")
    # written before they are joined, so that a join has plain shuffles below and a hot anchor can be split
    twice = materialize(every.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where(
        "a < b").select("anchor"), "anchors-of-several")
    hits = materialize(every.join(twice, "anchor"), "repeated-anchors")
    segs = materialize(hits.groupBy("anchor", "seg").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key", "first")).alias("rep"), F.first("n").alias("n")), "distinct-segments")
    several = materialize(segs.groupBy("anchor").agg(F.count("*").alias("segs")).where("segs > 1"), "varied-anchors")
    todo = materialize(segs.join(several, "anchor"), "segments-to-compare")
    found = repeated_segments(todo, docs, window, shard_words, anchor_segments).withColumnsRenamed({"anchor": "a__", "seg": "s__"})
    found = materialize(found.groupBy("a__", "s__").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "known-ranges")
    placed = hits.join(segs.select("anchor", "seg", "least"), ["anchor", "seg"])
    whole = placed.where("doc_id > least").select("doc_id", "text_key", F.array("first", F.expr(f"first + n + {window - 1}")).alias("ranges"))
    part = placed.where("doc_id = least").join(found, F.expr("anchor = a__ AND seg = s__")).select(
        "doc_id", "text_key", F.transform("ranges", lambda x: x + F.col("first")).alias("ranges"))
    return materialize(whole.unionByName(part).groupBy("doc_id", "text_key").agg(
        F.flatten(F.collect_set("ranges")).alias("ranges")), "repeated-ranges")


def kept_words(words: list[bytes], ranges: list[int] | None) -> list[bytes]:
    if not ranges:
        return words
    keep = np.ones(len(words), bool)
    for a, b in zip(ranges[::2], ranges[1::2]):
        keep[a:b] = False
    return [words[i] for i in np.flatnonzero(keep)]


def _with_ranges(docs: DataFrame, window: int) -> DataFrame:
    ranges = repeated_ranges(docs, window).withColumnsRenamed({"doc_id": "id__", "text_key": "key__"})
    return docs.join(by_shuffle(ranges), (F.col("doc_id") == F.col("id__")) & (text_hash() == F.col("key__")), "left")


def dedup_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row; NULL and empty texts have no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or b"").split()
                kept = kept_words(words, ranges.as_py())
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, digest = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_ranges(docs.select("doc_id", "text"), window).select("doc_id", F.col("text").cast("binary").alias("t"), "ranges")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without repeated passages: texts that lose words are the words left, joined by blanks; emptied rows go.

    Texts that lose nothing stay as they are. A column ``n_chars`` follows the text. Further columns may have any name.
    """
    @F.pandas_udf("string")
    def rest(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(kept_words(t.encode().split(), list(r))).decode() for t, r in zip(texts, ranges)])

    needed = ("doc_id", "text", "n_chars")
    own = set_aside(docs, needed).columns
    rows = _with_ranges(set_aside(docs, needed), window)
    same = rows.where("ranges IS NULL").select(*own)
    cut = rows.where("ranges IS NOT NULL").withColumn("text", rest("text", "ranges")).where("text <> ''")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return give_back(same.unionByName(cut.select(*own)), docs, needed)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(words[i + 1:i + 50], ' ')) AS h FROM w, unnest(range(len(words) - 49)) u(i)),
r AS (SELECT doc_id, i FROM v QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
c AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM r, unnest(range(50)) t(k) GROUP BY doc_id),
k AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
         CASE WHEN gone IS NULL THEN words ELSE (SELECT coalesce(list(x ORDER BY j), []) FROM (
           SELECT unnest(words) AS x, unnest(range(len(words))) AS j) WHERE NOT list_contains(gone, j)) END AS kept
  FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
