"""Spelling variants: words of a vocabulary at one edit from a much commoner word, found with bidirectional FM-indexes.

Search scheme: a word that differs from a pattern by one edit holds the pattern's first or its second half unchanged. So the
pattern is searched twice: its first half exactly, then extended to the right across the second half with one edit, and its
second half exactly, extended to the left across the first. The index of the delimited words (``|word|word|``) keeps an
interval of suffix ranks in each reading direction; extending it to one side is a step in that direction's transform, and
the other interval moves by the number of smaller symbols.

The vocabulary is dealt to shards, because two words that share a half share its outer symbols: for patterns of length n
these are the first (last) ``d(n) = min(n // 2, DEPTH)`` ones. A word goes to the shards of its own pattern key and, to be
found, to those of patterns one shorter and one longer; hence two near words meet in at least one shard. Keys with more words
than a shard takes are cut into tiles: each tile of words meets each tile of patterns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from driftwarden.llm.common import LOWER, UPPER, materialize, small_side
from driftwarden.llm.substring import WaveletMatrix, suffix_order

#: Letters of a word, after A-Z are lower-cased.
LETTERS = r"a-z\u00C0-\u00FF"
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: One in so many pairs of document and word loses a letter in the query's vocabulary.
MISSPELT = 31
#: A form occurs at least so many times as often as its variant.
COMMONER = 10
DEPTH = 5
#: Words of a key that a shard takes, and words of a shard on average.
TILE_WORDS, SHARD_WORDS = 1 << 15, 1 << 14


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, misspelt: int = MISSPELT) -> DataFrame:
    """``(word, n)``: words of all texts with enough letters and occurrences, some with a planted misspelling.

    Words are longest runs of letters, A-Z lower-cased. With h the CRC-32 of ``<doc_id>:<word>``, a word whose h ``misspelt`` divides
    loses its letter ``h % length``; ``misspelt=0`` plants none, and rows without a doc_id have none. NULL texts have no words.
    """
    lowered = F.translate("text", UPPER, LOWER)
    rows = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))).alias("word"))
    if misspelt:
        rows = rows.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.left("word", at), F.substring("word", at + 2, F.length("word")))
        rows = rows.select(F.when(F.col("h") % misspelt == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_letters)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class BiIndex:
    """FM-index of delimited sequences in both reading directions.

    ``symbols`` is their concatenation, delimiter 0 at both ends and between; patterns have up to ``depth`` symbols. An interval is
    (left, right, size): the first rank of the suffixes that start with the pattern, that of the prefixes that end with it (ordered
    from their ends), and their number.
    """

    def __init__(self, symbols: np.ndarray, depth: int, alphabet: int) -> None:
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=alphabet))]
        self.order = suffix_order(symbols, depth + 1)
        turned = symbols[::-1]
        self.neighbours = {True: symbols[self.order - 1], False: turned[suffix_order(turned, depth + 1) - 1]}
        self.ranks = {to_left: WaveletMatrix(x, alphabet) for to_left, x in self.neighbours.items()}

    def whole(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of single symbols."""
        return self.first[symbols], self.first[symbols], self.first[symbols + 1] - self.first[symbols]

    def _inside(self, to_left: bool, symbols: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols equal to the given ones before ``low`` and among the ``size`` from there on, and the smaller ones among these."""
        matrix, smaller = self.ranks[to_left], np.zeros_like(low)
        places = np.stack([np.zeros_like(low), low, low + size])
        for shift, words, counts, zeros in zip(matrix.shifts, matrix.words, matrix.counts, matrix.zeros):
            below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[places >> 6] + np.bitwise_count(words[places >> 6] & below)
            bit = (symbols >> shift & 1).astype(bool)
            smaller += np.where(bit, (places[2] - ones[2]) - (places[1] - ones[1]), 0)
            places = np.where(bit, zeros + ones, places - ones)
        return places[1] - places[0], places[2] - places[1], smaller

    def extend(self, to_left: bool, symbols: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol put before (behind) them; size 0 where the text has none."""
        rank, inside, smaller = self._inside(to_left, symbols, left if to_left else right, size)
        near = self.first[symbols] + rank
        return (near, right + smaller, inside) if to_left else (left + smaller, near, inside)

    def continuations(self, to_left: bool, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(interval, symbol)`` for every symbol next to each interval. Equal intervals are read once, and different ones of patterns of
        one length are disjoint, so no more is read than the text for each length."""
        keys, first, same = np.unique((left if to_left else right) * (len(self.order) + 1) + size, return_index=True, return_inverse=True)
        item, step = _elements(size[first])
        pairs = np.unique(item * (1 << 32) + self.neighbours[to_left][(left if to_left else right)[first][item] + step])
        bounds = np.searchsorted(pairs >> 32, np.arange(len(first) + 1))
        row, step = _elements(np.diff(bounds)[same])
        return row, pairs[bounds[same][row] + step] & ((1 << 32) - 1)


def _elements(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with ``sizes`` elements: the item of every element and its number inside it."""
    item = np.repeat(np.arange(len(sizes)), sizes)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)


def near_words(words: list[str], patterns: list[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(pattern, word)`` numbers of all pairs at one edit in which the word holds one half of the pattern unchanged.

    ``words`` differ from each other. ``first_half`` keeps the first half and seeks the edit behind it, otherwise the other way round;
    pairs that hold the first half too are then left out, so that the two searches together report every pair once.
    """
    lengths, sizes = np.array([len(w) for w in words], np.int64), np.array([len(p) for p in patterns], np.int64)
    if not lengths.sum() or not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.unique(_codes(words))
    starts = np.cumsum(lengths + 1) - lengths
    text = np.zeros(int(lengths.sum()) + len(words) + 1, np.int64)
    text[np.repeat(starts, lengths) + _elements(lengths)[1]] = np.searchsorted(letters, _codes(words)) + 1
    index = BiIndex(text, int(max(lengths.max(), sizes.max())) + 2, len(letters) + 2)

    # patterns with a delimiter at both ends, read away from the half that is kept; the last symbol stands for letters of no word
    item, step = _elements(sizes)
    codes = _codes(patterns)
    at = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    p = np.zeros((len(patterns), int(sizes.max()) + 2), np.int64)
    p[item, (step if first_half else sizes[item] - 1 - step) + 1] = np.where(letters[at] == codes, at + 1, len(letters) + 1)
    half = sizes // 2 if first_half else sizes - sizes // 2
    end = sizes + 1
    outwards, onwards = first_half, not first_half  # whether these two directions are to the left

    # the kept half, from its inner end outwards to the delimiter
    who, at = np.arange(len(p)), half
    state = index.whole(p[who, at])
    kept = []
    while who.size:
        live = state[2] > 0
        who, at, state = who[live], at[live], tuple(x[live] for x in state)
        done = at == 0
        kept.append((who[done], half[who[done]] + 1, *(x[done] for x in state)))
        who, at, state = who[~done], at[~done] - 1, tuple(x[~done] for x in state)
        state = index.extend(outwards, p[who, at], *state)
    exact = tuple(np.concatenate(x) for x in zip(*kept))  # pattern, next place, interval

    found: list[np.ndarray] = []
    edited = tuple(x[:0] for x in exact)
    while exact[0].size or edited[0].size:
        # the edit is here: another symbol for the next one, a symbol more, or the next one left out
        who, at, *interval = exact
        row, symbol = index.continuations(onwards, *interval)
        row, symbol = row[symbol > 0], symbol[symbol > 0]
        after = index.extend(onwards, symbol, *(x[row] for x in interval))
        other = (at[row] < end[who[row]]) & (symbol != p[who[row], at[row]])
        left_out = at < end[who]
        branches = [edited, (who[row][other], at[row][other] + 1, *(x[other] for x in after)), (who[row], at[row], *after),
                    (who[left_out], at[left_out] + 1, *(x[left_out] for x in interval))]
        # or further on
        who, at, interval = who[left_out], at[left_out], [x[left_out] for x in interval]
        interval = index.extend(onwards, p[who, at], *interval)
        exact = tuple(x[interval[2] > 0] for x in (who, at + 1, *interval))
        # patterns that have had their edit go on without another
        who, at, *interval = (np.concatenate(x) for x in zip(*branches))
        interval = index.extend(onwards, p[who, at], *interval)
        live = interval[2] > 0
        who, at, interval = who[live], at[live], [x[live] for x in interval]
        done = at == end[who]
        # delimited words differ, so the interval is one word; its suffix begins with the delimiter before it
        found.append(who[done] * len(words) + np.searchsorted(starts, index.order[interval[0][done]] + 1))
        edited = (who[~done], at[~done] + 1, *(x[~done] for x in interval))
    pattern, word = np.divmod(np.unique(np.concatenate([np.zeros(0, np.int64), *found])), len(words))
    if not first_half:
        new = np.array([not words[w].startswith(patterns[q][:len(patterns[q]) // 2]) for q, w in zip(pattern, word)], bool)
        pattern, word = pattern[new], word[new]
    return pattern, word


def _keys(words: DataFrame, depth: int) -> DataFrame:
    """``(side, key, pattern, word, n)``: every word under the keys where it searches and where it is to be found."""
    def depths(*lengths: int) -> Column:
        return F.array_distinct(F.array(*[F.least(F.floor((F.length("word") + x) / 2).cast("int"), F.lit(depth)) for x in lengths]))

    every = F.array(F.struct(F.lit(True).alias("pattern"), depths(0).alias("ds")), F.struct(F.lit(False).alias("pattern"), depths(-1, 0, 1).alias("ds")))
    rows = words.select("word", "n", F.explode(every).alias("e")).select("word", "n", "e.pattern", F.explode("e.ds").alias("d"))
    rows = rows.select("word", "n", "pattern", "d", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    outer = F.when(F.col("side") == 0, F.left("word", F.col("d"))).otherwise(F.right("word", F.col("d")))
    return rows.select("side", F.concat(F.col("d").cast("string"), F.lit(":"), outer).alias("key"), "pattern", "word", "n")


def _dealt(words: DataFrame, depth: int, tile_words: int, shard_words: int) -> DataFrame:
    """``_keys`` with a ``shard``: whole keys together by hash; a key with over ``tile_words`` words in tiles, words by patterns."""
    keys = _keys(words, depth)
    shards = max(1, -(-keys.where("NOT pattern").count() // (2 * shard_words)))
    large = materialize(keys.where("NOT pattern").groupBy("side", "key").agg(F.count(F.lit(1)).alias("words")).where(
        F.col("words") > tile_words).select("side", "key", F.ceil(F.col("words") / tile_words).cast("int").alias("tiles")), "large-keys")
    whole = keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)) * 2 + F.col("side"))
    if large.isEmpty():
        return whole
    mine = F.pmod(F.xxhash64("word"), F.col("tiles"))
    each = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda other: F.xxhash64(
        "key", F.when(F.col("pattern"), mine).otherwise(other), F.when(F.col("pattern"), other).otherwise(mine)).bitwiseAND(F.lit(-2)).bitwiseOR(
        F.col("side")).bitwiseOR(F.lit(-(1 << 63))))
    rows = whole.join(small_side(large), ["side", "key"], "left")
    return rows.withColumn("shard", F.explode(F.when(F.col("tiles").isNull(), F.array("shard")).otherwise(each))).select(*whole.columns)


def nearest_common(words: DataFrame, depth: int = DEPTH, tile_words: int = TILE_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(word, n, n_near, best, best_n)``: per word the number of words at one edit, and the one of them with the largest n.

    ``words`` has distinct words of at least two letters; of near words with equal n the first in code-point order is ``best``.
    """
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        searching = group["pattern"].to_numpy(bool)
        held = group[~searching].sort_values("word")  # strings compare by code points
        asked = group[searching].reset_index(drop=True)
        pattern, word = near_words(held["word"].tolist(), asked["word"].tolist(), key[0] % 2 == 0)
        n = held["n"].to_numpy(np.int64)
        order = np.lexsort((word, -n[word], pattern))
        pattern, word = pattern[order], word[order]
        who, first, count = np.unique(pattern, return_index=True, return_counts=True)
        out = asked[["word", "n"]].assign(n_near=0, best=None, best_n=0)
        out.loc[who, "n_near"] = count
        out.loc[who, "best"] = held["word"].to_numpy(object)[word[first]]
        out.loc[who, "best_n"] = n[word[first]]
        return out

    found = _dealt(words, depth, tile_words, shard_words).groupBy("shard").applyInPandas(
        run, "word string, n long, n_near long, best string, best_n long")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("least"), "best")))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n", "n_near", "b.best", (-F.col("b.least")).alias("best_n"))


def _roots(links: DataFrame, most_n: int, commoner: int) -> DataFrame:
    """``(word, root)``: links followed to their ends. Counts grow ``commoner``-fold a link, so a chain has few and doubling is soon done."""
    followed, reach = links, 1
    while commoner ** reach <= most_n:
        ahead = followed.select(F.col("word").alias("w__"), F.col("root").alias("r__"))
        joined = materialize(followed.join(ahead, F.col("root") == F.col("w__"), "left"), "forms-followed")
        if joined.where("w__ IS NOT NULL").isEmpty():
            break
        followed, reach = joined.select("word", F.coalesce("r__", "root").alias("root")), reach * 2
    return followed


def variants(words: DataFrame, commoner: int = COMMONER) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of a vocabulary ``(word, n)``.

    ``form`` is the near word with the largest n if that is ``commoner`` times the word's n or more, else NULL; ``root`` is reached by
    following forms, the word itself if it has none. An empty vocabulary gives no rows.
    """
    if commoner < 2:
        raise ValueError("forms must be commoner than their variants")
    near = materialize(nearest_common(materialize(words, "vocabulary")), "near-words")
    has = F.col("best_n") >= F.col("n") * commoner
    rows = near.select("word", F.when(has, F.col("best")).alias("form"), "n", "n_near", F.when(has, F.col("best_n")).alias("form_n"))
    most_n = rows.agg(F.max("form_n")).first()[0] or 0
    roots = _roots(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), most_n, commoner)
    joined = rows.join(roots.select(F.col("word").alias("w__"), "root"), F.col("word") == F.col("w__"), "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
