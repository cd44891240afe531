from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from driftwarden.llm import registry, spelling
from tests.llm.conftest import ODD


def near(a, b):
    """Whether two strings differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, commoner=10):
    out, form = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= commoner * n else None
        out[w] = [form[w], None, n, len(others), counts[best] if form[w] else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {(w, *r) for w, r in out.items()}


def vocabulary(n, seed, alphabet="abé", least=7, most=10):
    draw = np.random.default_rng(seed)
    words = {"".join(draw.choice(list(alphabet), draw.integers(least, most + 1))) for _ in range(n)}
    for w in list(words)[:n // 2]:
        i = int(draw.integers(len(w)))
        words |= {w[:i] + w[i + 1:] + "a", w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1:]}
    return {w: int(draw.choice([2, 3, 20, 30, 300, 4000])) for w in sorted(words) if len(w) >= least}


@pytest.mark.parametrize(("seed", "alphabet", "most"), [(1, "ab", 9), (2, "abcé", 8), (3, "abcdefghÿ", 12), (4, "a", 40)])
def test_halves_equal_brute_force(seed, alphabet, most):
    words = list(vocabulary(150, seed, alphabet, most=most))
    patterns = words[::2] + ["qqqqqqq", "ab" * 30]
    pairs = [(q, w) for half in (True, False) for q, w in zip(*(x.tolist() for x in spelling.near_words(words, patterns, half)))]
    assert sorted(pairs) == [(q, w) for q, p in enumerate(patterns) for w, v in enumerate(words) if near(p, v)]
    assert pairs


def test_intervals_of_both_directions():
    """Extending left and right in any order gives the interval of the whole pattern."""
    text = np.array([0, 1, 2, 1, 1, 0, 2, 1, 2, 0, 1, 1, 2, 1, 0])
    index = spelling.BiIndex(text, 6, 4)
    for pattern in ([1, 2, 1], [0, 2, 1], [1, 1], [2, 2], [1, 2, 0]):
        expected = sum(text[i:i + len(pattern)].tolist() == pattern for i in range(len(text)))
        for start in range(len(pattern)):
            state = index.whole(np.array([pattern[start]]))
            for c in reversed(pattern[:start]):
                state = index.extend(True, np.array([c]), *state)
            for c in pattern[start + 1:]:
                state = index.extend(False, np.array([c]), *state)
            assert state[2].tolist() == [expected]
            if expected:
                assert {tuple(text[index.order[state[0][0] + i]:][:len(pattern)]) for i in range(expected)} == {tuple(pattern)}


@pytest.mark.parametrize("params", [{}, {"depth": 3, "tile_words": 5, "shard_words": 20}, {"tile_words": 40, "shard_words": 7}])
def test_shards_and_tiles_do_not_matter(spark, params):
    counts = vocabulary(120, 5, "abc")
    found = spelling.nearest_common(spark.createDataFrame(list(counts.items()), "word string, n long"), **params).collect()
    assert len(found) == len(counts)
    for r in found:
        others = sorted((v for v in counts if near(r.word, v)), key=lambda v: (-counts[v], v))
        assert (r.n, r.n_near, r.best, r.best_n) == (counts[r.word], len(others), *((others[0], counts[others[0]]) if others else (None, None)))


def test_variants_and_chains(spark):
    counts = vocabulary(60, 6) | {"abcdefgh": 40_000, "abcdefg": 4_000, "abcdefx": 400, "abcdexx": 40, "abcdxxx": 4}
    found = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {tuple(r) for r in found} == plain_variants(counts) and len(found) == len(counts)
    assert {r.root for r in found if r.word.startswith("abcd")} == {"abcdefgh"}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []


def plain_vocabulary(rows, misspelt=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % misspelt == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_query_equals_brute_force(spark, documents, tmp_path):
    draw = np.random.default_rng(7)
    pool = ["Straßenbahn", "ÉCOLIERS", "écoliers", "children", "CHILDREN", "a×b÷cdefg", "seventh7seventh", "sevent", "wonderful", "wonderfull"]
    rows = [(i, " ".join(draw.choice(pool, 30, p=[.02, .02, .02, .3, .3, .1, .1, .1, .03, .01]))) for i in range(200)]
    rows += [r[:2] for r in ODD] + [(None, "children wonderful"), (3, "lettersonly" * 200), (4, "lettersonly" * 200)]
    documents(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    counts = plain_vocabulary(rows)
    found = registry.op13_spelling_variants(spark, str(tmp_path)).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == plain_variants(counts) and len(found) == len(counts)
    assert any(r.form for r in found) and max(len(r.word) for r in found) == 2_200


def test_query_finds_what_brute_force_finds_in_the_sample(spark, sf_dir, sample):
    counts = plain_vocabulary([(i, r.text) for i, r in sample.items()])
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    found = {r.word: r for r in registry.op13_spelling_variants(spark, sf_dir).collect()}
    assert {w: r.n for w, r in found.items()} == counts
    for w in sorted(counts)[::7]:
        others = [v for n in (-1, 0, 1) for v in by_length.get(len(w) + n, []) if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        assert (found[w].n_near, found[w].form) == (len(others), best if best and counts[best] >= 10 * counts[w] else None)
