from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from driftwarden.llm import periodic, registry
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(x, least_length=24, least_exponent=3):
    """Rows (start, period, length) of every run, by comparing at all lags."""
    found = {}
    for q in range(1, len(x) // least_exponent + 1):
        s = 0
        while s < len(x) - q:
            e = s
            while e < len(x) - q and x[e] == x[e + q]:
                e += 1
            if e > s and e + q - s >= max(least_length, least_exponent * q):
                found.setdefault((s, e + q), q)
            s = max(e, s) + 1
    return sorted((s, q, e - s) for (s, e), q in found.items())


def sequences(seed):
    """Sequences with planted runs of many periods, some nested, beside random words."""
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(25):
        x = []
        for _ in range(draw.integers(1, 5)):
            x += draw.integers(0, int(draw.choice([2, 5, 50])), draw.integers(0, 40)).tolist()
            q = int(draw.choice([1, 2, 7, 15, 16, 17, 18, 25, 26, 27, 38, 39, 40, 59, 60, 90]))
            root = draw.integers(0, int(draw.choice([2, 3, 30])), q).tolist()
            if draw.random() < 0.3:
                root = [*root, *root, *root[:2]]
            x += (root * 9)[:int(len(root) * draw.uniform(2.5, 6))]
        out.append(x)
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("short", [1, 16])
def test_runs_equal_brute_force(seed, short):
    some = 0
    for x in sequences(seed):
        found = periodic.runs(np.array(x, np.int64), short=short)
        assert [(s, q, e - s) for s, e, q in found.tolist()] == plain_runs(x)
        some += len(found)
    assert some > 25


def test_texts_searched_together_stay_apart():
    texts = [[b"w%d" % n for n in x] for x in sequences(9)] + [[], [b"a"] * 24, [b"a"] * 24]
    for t, found in zip(texts, periodic._searched(texts, 16, 24, 3)):
        assert [(s, q, e - s) for s, e, q in found.tolist()] == plain_runs(t)


def test_equal_hashes_do_not_decide(monkeypatch):
    """With all blocks alike only the comparison word by word is left."""
    x = np.r_[np.arange(100), np.tile(np.arange(200, 230), 4), np.arange(300, 400)]
    assert periodic._compared(x, 90, 230, 30) == (100, 220)
    assert periodic._compared(x, 0, 90, 30) == (0, 0)


def planted(i, words):
    if i is None or not words or zlib.crc32(str(i).encode()) % 10:
        return words
    g, n = zlib.crc32(str(i).encode()) // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def plain_row(i, text):
    words = planted(i, WORD.findall(text or ""))
    found = plain_runs(words)
    gone = {k for s, q, n in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(found), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else [None] * 4),
            digest("".join(f"{s},{n},{q}\n" for s, q, n in found)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_equals_brute_force(spark, documents, tmp_path):
    hit = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [r[:2] for r in ODD] + [(hit[k], " ".join(f"w{(j * j) % 41}" for j in range(60 + 9 * k))) for k in range(30)]
    rows += [(9, "x\ty " * 40 + "tail"), (hit[40], ""), (hit[41], "one"), (None, "a b " * 30)]
    documents(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = sorted((plain_row(*r) for r in rows if r[0] != 7), key=repr)
    assert sorted((tuple(r) for r in found if r.doc_id != 7), key=repr) == want
    long = [r for r in found if r.doc_id == 7]
    assert [(r.n_runs, r.start, r.length, r.period) for r in long] == [(1, 0, 30_000, 1)]


def test_collapsed_text_and_general_bounds(documents):
    rows = [(1, "a b " * 3 + "c"), (1, "a b " * 3 + "c"), (2, None)]
    found = periodic.periodic_runs(documents(*rows), least_length=6).collect()
    assert [(r.doc_id, r.n_words, r.collapsed, [tuple(x) for x in r.runs]) for r in sorted(found)] == [
        (1, 7, "a b c", [(0, 6, 2)]), (1, 7, "a b c", [(0, 6, 2)]), (2, 0, "", [])]
    assert periodic.periodic_runs(documents()).collect() == []
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(50, np.int64), least_exponent=2)
