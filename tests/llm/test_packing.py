from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from driftwarden.llm import packing, registry
from tests.llm.conftest import ODD


def encode_all(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def check_places(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return sequences


def test_query_equals_the_tokenizer(spark, sf_dir, sample):
    rows = registry.op6_pack_sequences(spark, sf_dir).collect()
    ids = dict(zip(sample, encode_all([r.text for r in sample.values()])))
    seen = defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += range(r.start, r.start + r.length)
    assert all(sorted(seen[d]) == list(range(len(x))) for d, x in ids.items())
    sequences = check_places(rows, 2048)
    assert sum(map(len, ids.values())) > 0.97 * 2048 * (len(sequences) - 1)


def test_odd_rows_and_round_trip(documents):
    rows = [*ODD, (70, "before <|endoftext|> after it's 12345   \n\n x"), (71, "\u200b\u0301" * 50)]
    packed = packing.packed_pieces(documents(*rows))
    placed = packed.collect()
    check_places(placed, 2048)
    expected = sorted(encode_all([r[1] for r in rows]))
    pieces = defaultdict(list)
    for r in placed:
        if r.doc_id is not None and r.doc_id != 4:
            pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for doc_id, text, *_ in rows:
        if doc_id in pieces:
            assert sum((p for _, p in sorted(pieces[doc_id])), []) == encode_all([text])[0]
    assert sum(r.length for r in placed) == sum(map(len, expected))
    out = {r.sequence_id: (np.frombuffer(bytes(r.ids), "<u4").tolist(), r.tokens) for r in packing.sequences(packed).collect()}
    for r in placed:
        assert out[r.sequence_id][0][r.offset:r.offset + r.length] == np.frombuffer(r.ids, "<u4").tolist()
    assert all(len(ids) == (n if n & (n - 1) == 0 else 2048) for ids, n in out.values())
    assert packing.packed_pieces(documents(*ODD).limit(0)).count() == 0


def test_first_fit_decreasing_takes_the_first_bin():
    lengths = np.random.default_rng(4).integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    free, expected = [100] * 300, {}
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        b = next(b for b in range(300) if free[b] >= lengths[i])
        expected[i] = (b, 100 - free[b])
        free[b] -= int(lengths[i])
    assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets))} == expected


def test_groups_are_independent_of_each_other(spark):
    rows = [(i, i, 0, int(n)) for i, n in enumerate(np.random.default_rng(5).integers(1, 65, 500))]
    pieces = packing.materialize(spark.createDataFrame(rows, "doc_id long, text_key long, start long, length long"), "t")
    placed = packing.pack(pieces, 64, group_pieces=50).collect()
    assert len(placed) == 500
    check_places(placed, 64)
    assert len({r.sequence_id >> 32 for r in placed}) > 5
