"""Periodic runs in sequences of words: seeds from minimizers at several scales, direct scans for short periods.

A run is a longest stretch of words that keeps a period q, at least ``least_exponent`` periods long.

1. Periods up to SHORT are found by comparing the text with itself at every such lag.
2. Longer ones come in scales ``low..high`` with ``high`` about 1.5 ``low``. A scale hashes every block of ``high`` words
   and takes the least block of each window of ``2 low - high + 1`` blocks (its minimizers). In a run of three periods q
   of that scale some window and the one q further on lie inside the run, hold the same words and so choose places q
   apart. A block of at least q words recurs in the run only at multiples of q, so the two are neighbours among the
   equal minimizers: pairs of neighbours are seeds for q.
3. Seeds are extended to both sides, by comparing hashes of blocks of halving length. Candidates are then compared word
   by word, so a hash decides nothing alone.
4. Stretches with the same bounds keep their least period: if it were not the smallest, the stretch would also have been
   found for that one.

Documents are searched many at a time: their words stand in one array with a number of its own between any two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftwarden.llm.common import WORD

LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Longest period that is scanned for directly.
SHORT = 16
#: Words searched at once; a longer text is searched alone.
WORDS_AT_ONCE = 1 << 17
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Blocks:
    """Hashes of blocks of a number sequence, from one sum over prefixes (all arithmetic modulo 2^64)."""

    def __init__(self, numbers: np.ndarray) -> None:
        n = len(numbers)
        values = _mixed(numbers.astype(np.uint64) + np.uint64(BASE))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(BASE, n), out=self.sums[1:])
        self.back = _powers(BASE_INVERSE, n + 1)

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        return (self.sums[starts + width] - self.sums[starts]) * self.back[starts]

    def all(self, width: int) -> np.ndarray:
        return (self.sums[width:] - self.sums[:-width]) * self.back[:len(self.sums) - width]

    def equal_after(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Words in common from ``a`` and from ``b > a`` on, up to ``most``."""
        n, got, width = len(self.sums) - 1, np.zeros(len(a), np.int64), 1 << max(0, most.bit_length() - 1)
        while width:
            fits = np.flatnonzero(b + got + width <= n)
            x, y = a[fits] + got[fits], b[fits] + got[fits]
            got[fits[self.at(x, width) == self.at(y, width)]] += width
            width >>= 1
        return got

    def equal_before(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Words in common before ``a`` and before ``b > a``, up to ``most``."""
        got, width = np.zeros(len(a), np.int64), 1 << max(0, most.bit_length() - 1)
        while width:
            fits = np.flatnonzero(a - got - width >= 0)
            x, y = a[fits] - got[fits] - width, b[fits] - got[fits] - width
            got[fits[self.at(x, width) == self.at(y, width)]] += width
            width >>= 1
        return got


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash (the leftmost of equals) of every ``window`` consecutive ones, each once."""
    window = min(window, len(hashes))
    best, place, width = _mixed(hashes), np.arange(len(hashes)), 1
    while width < window:
        step = min(width, window - width)
        later = best[step:] < best[:-step]
        best, place = np.where(later, best[step:], best[:-step]), np.where(later, place[step:], place[:-step])
        width += step
    return np.unique(place)


def scales(longest: int, short: int = SHORT) -> Iterator[tuple[int, int]]:
    """``(low, high)`` of the ranges of periods from ``short + 1`` to ``longest``."""
    low = short + 1
    while low <= longest:
        high = low + low // 2
        yield low, high
        low = high + 1


def _short_runs(x: np.ndarray, short: int, least_length: int, least_exponent: int) -> list[np.ndarray]:
    found = []
    for q in range(1, min(short, len(x) - 1) + 1):
        same = np.flatnonzero(np.diff(np.r_[False, x[q:] == x[:-q], False].view(np.int8)))
        starts, ends = same[::2], same[1::2] + q
        long = ends - starts >= max(least_length, least_exponent * q)
        found.append(np.stack([starts[long], ends[long], np.full(long.sum(), q)], axis=1))
    return found


def _long_runs(x: np.ndarray, longest: int, short: int, least_length: int, least_exponent: int) -> list[np.ndarray]:
    found, blocks = [], None
    for low, high in scales(longest, short):
        if high >= len(x):
            high = len(x) - 1
        blocks = blocks or Blocks(x)
        hashes = blocks.all(high)
        places = minimizers(hashes, 2 * low - high + 1)
        places = places[np.lexsort((places, hashes[places]))]
        gaps = np.diff(places)
        pairs = np.flatnonzero((hashes[places[1:]] == hashes[places[:-1]]) & (gaps >= low) & (gaps <= high))
        if not pairs.size:
            continue
        a, q = places[pairs], gaps[pairs]
        # extended while a stretch could still be growing: doubling the bound reaches any length in few rounds
        starts, ends = a.copy(), a + q
        open_, most = np.arange(len(a)), 4 * high
        while open_.size:
            more = blocks.equal_after(ends[open_] - q[open_], ends[open_], most)
            ends[open_] += more
            open_, most = open_[more >= most], most * 2
        open_, most = np.arange(len(a)), 4 * high
        while open_.size:
            more = blocks.equal_before(starts[open_], starts[open_] + q[open_], most)
            starts[open_] -= more
            open_, most = open_[more >= most], most * 2
        long = ends - starts >= np.maximum(least_length, least_exponent * q)
        found.append(np.unique(np.stack([starts[long], ends[long], q[long]], axis=1), axis=0))
    return found


def _compared(x: np.ndarray, s: int, e: int, q: int) -> tuple[int, int]:
    """Bounds of the stretch with period q around the middle of ``s..e``, word by word."""
    if np.array_equal(x[s:e - q], x[s + q:e]) and (s == 0 or x[s - 1] != x[s - 1 + q]) and (e == len(x) or x[e] != x[e - q]):
        return s, e
    same = np.r_[False, x[q:] == x[:-q], False]  # two blocks of one hash: look at all words at this lag
    edges, middle = np.flatnonzero(np.diff(same.view(np.int8))), (s + e - q) // 2
    at = np.searchsorted(edges[::2], middle, side="right") - 1
    return (int(edges[2 * at]), int(edges[2 * at + 1]) + q) if at >= 0 and edges[2 * at + 1] > middle else (s, s)


def runs(x: np.ndarray, longest: int | None = None, short: int = SHORT, least_length: int = LEAST_LENGTH,
         least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows ``(start, end, period)`` of all runs of a sequence of numbers, by start, then period.

    ``longest`` bounds the periods looked for; no run has one beyond ``len(x) // least_exponent``, which is the default.
    The seeds need at least three periods, so ``least_exponent`` is 3 or more.
    """
    if least_exponent < 3:
        raise ValueError("seeds are complete for three periods or more")
    longest = len(x) // least_exponent if longest is None else longest
    if len(x) < least_length:
        return np.zeros((0, 3), np.int64)
    rows = _short_runs(x, min(short, longest), least_length, least_exponent) + _long_runs(x, longest, short, least_length, least_exponent)
    kept: dict[tuple[int, int], int] = {}
    for s, e, q in np.concatenate(rows).tolist():
        if q > short:
            s, e = _compared(x, s, e, q)
            if e - s < max(least_length, least_exponent * q):
                continue
        kept[s, e] = min(q, kept.get((s, e), q))
    out = np.array(sorted((s, q, e) for (s, e), q in kept.items()), np.int64).reshape(-1, 3)
    return out[:, [0, 2, 1]]


class _Numbers(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _searched(texts: list[list[bytes]], short: int, least_length: int, least_exponent: int) -> list[np.ndarray]:
    """Runs of each text, all searched in one sequence with different numbers between the texts."""
    numbers = _Numbers()
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    x = np.empty(int(sizes.sum()) + len(texts), np.int64)
    for t, at in zip(texts, starts.tolist()):
        x[at:at + len(t)] = np.fromiter(map(numbers.__getitem__, t), np.int64, len(t))
    x[starts + sizes] = -1 - np.arange(len(texts))
    found = runs(x, int(sizes.max()) // least_exponent, short, least_length, least_exponent)
    text = np.searchsorted(starts, found[:, 0], side="right") - 1
    found[:, :2] -= starts[text][:, None]
    return np.split(found, np.searchsorted(text, np.arange(1, len(texts))))


def collapsed_words(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not len(found):
        return words
    keep = np.ones(len(words), bool)
    for s, e, q in found.tolist():
        keep[s + q:e] = False
    return [words[i] for i in np.flatnonzero(keep)]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, short: int = SHORT) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every row.

    ``runs`` lists ``start``, ``length`` and ``period`` in words by start, then period; ``collapsed`` is the text's words, joined by
    blanks, without those that a run holds after its first period. NULL, empty and blank texts have no words and no runs; rows that
    repeat a doc_id stay separate; other columns of ``docs`` are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, held, first = [], 0, at
                while at < batch.num_rows and (not texts or held < WORDS_AT_ONCE):
                    texts.append((batch.column(1)[at].as_py() or b"").split())
                    held += len(texts[-1])
                    at += 1
                found = _searched(texts, short, least_length, least_exponent)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, at - first), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[{"start": s, "length": e - s, "period": q} for s, e, q in f.tolist()] for f in found], RUNS),
                    pa.array([b" ".join(collapsed_words(t, f)).decode() for t, f in zip(texts, found)], pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """``periodic_runs`` as counts and digests: the number of runs, the one with the greatest exponent, and SHA-256 of runs and words.

    Exponents are compared as exact fractions; of equals the smallest start, then the smallest period counts. Without a run its four
    columns are NULL. The digest of runs is over a line ``start,length,period`` for each.
    """
    better = "a.length * b.period > b.length * a.period OR (a.length * b.period = b.length * a.period AND (a.start, a.period) < (b.start, b.period))"
    best = F.expr(f"aggregate(runs, get(runs, 0), (b, a) -> CASE WHEN {better} THEN a ELSE b END)")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``, a tenth of the texts with a periodic end, chosen and shaped by the checksum of the doc_id.

    With h the CRC-32 of the decimal doc_id, g = h // 10, n words and h divisible by 10, every word from a = g % n on becomes
    word ``a + (i - a) % p`` of the original, p = 1 + (n - a) // (3 + g % 8). Texts without words and rows without a doc_id stay.
    """
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    rows = rows.withColumns({"g": F.expr("h div 10"), "n": F.size("w")}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.transform("w", word), " ")).otherwise(F.col("text")).alias("text"))
