from __future__ import annotations

import functools
import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftwarden.llm import registry, syncmers
from tests.llm.conftest import ODD


def hashed(b, seed=42):
    return xxhash.xxh64_intdigest(b, seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_anchors(b, k, s):
    found = []
    for i in range(len(b) - k + 1):
        inner = [signed(hashed(b[i + j:i + j + s])) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append((i, hashed(b[i:i + k]) >> 33))
    return found


@functools.cache
def plain_marks(text, k, s, most):
    b = (text or "").encode()
    marks = sorted({m for _, m in plain_anchors(b, k, s)})[:most]
    return marks or ([hashed(b) >> 33] if b else [])


def plain_likeness(a, b, most):
    union = sorted({*a, *b})[:most]
    return len([m for m in union if m in a and m in b]) / len(union) if union else 1.0


def plain_edited(rows):
    """``(doc_id, text, edited, next)`` in the operator's order."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(hashed(r[1].encode()))))
    out = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        out.append((i, t, t[:len(t) - half] + n[:half], n))
    return out


def texts(n, seed):
    draw = np.random.default_rng(seed)
    alphabet = list("abc é ü😀")
    return [(int(i), "".join(draw.choice(alphabet, draw.integers(0, 200)))) for i in draw.permutation(n * 3)[:n]]


def test_places_and_marks(documents):
    rows = [*texts(12, 1), *[r[:2] for r in ODD if r[0] != 7]]
    found = sorted(tuple(r) for r in syncmers.syncmers(documents(*rows), 9, 4, 16).collect() if r.doc_id is not None)
    assert found == sorted((i, at, m) for i, t in rows if i is not None for at, m in plain_anchors((t or "").encode(), 9, 4))


@pytest.mark.parametrize(("ranges", "k", "s", "most", "size"), [(1, 8, 3, 10, 16), (5, 12, 5, 64, 1 << 16), (40, 32, 17, 64, 40)])
def test_equals_brute_force(documents, ranges, k, s, most, size):
    rows = [*texts(30, k), *[r[:2] for r in ODD if r[0] != 7], (9, "x" * 700), (9, "other text of the same id " * 20), (None, None)]
    found = syncmers.edited(documents(*rows), ranges, k, s, most, size).collect()
    want = [(i, len(t), e, plain_marks(t, k, s, most), plain_marks(e, k, s, most), plain_marks(n, k, s, most)) for i, t, e, n in plain_edited(rows)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    whole = syncmers.with_fingerprints(documents(*rows), k, s, most, size).collect()
    assert sorted(map(tuple, whole), key=repr) == sorted(((i, plain_marks(t, k, s, most)) for i, t in rows), key=repr)


def test_pieces_do_not_matter(documents):
    long = " ".join(f"w{i * i % 977}" for i in range(30_000))
    docs = documents((1, long), (2, long[100:]))
    runs = [sorted(map(tuple, syncmers.with_fingerprints(docs, size=size).collect())) for size in (1000, 1 << 16, 1 << 24)]
    assert runs[0] == runs[1] == runs[2]


def test_query_on_odd_rows(spark, documents, tmp_path):
    rows = [r[:2] for r in ODD]
    documents(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.op11_syncmer_fingerprints(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    want = {(i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(plain_likeness(plain_marks(t, 32, 17, 64), plain_marks(n, 32, 17, 64), 64), 12))
            for i, t, e, n in plain_edited(rows)}
    assert {(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_next, 12)) for r in found} == want
    by_text = {}
    for r in found:
        assert 0 <= r.near_edited <= 1 and len(r.fingerprint) % 8 == 0
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by_text[1] == by_text[2] == {""} and len(by_text[4]) == 1


def test_empty_table_and_one_row(documents):
    assert syncmers.edited(documents()).collect() == []
    assert [(r.edited, r.edited_marks == r.next_marks) for r in syncmers.edited(documents((1, "ab"))).collect()] == [("aa", False)]


def test_likeness_tells_edits_from_others(spark, sf_dir):
    found = registry.op11_syncmer_fingerprints(spark, sf_dir).where("n_chars > 500").agg(
        F.avg("near_edited").alias("edited"), F.avg("near_next").alias("next"), F.min("near_edited").alias("least")).first()
    assert found.edited > 0.28 and found.next < 0.1 and found.least > 0.05
