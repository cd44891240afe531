"""Packing documents into training sequences: first-fit decreasing over a tournament tree of bin capacities.

Each document is tokenized and cut into full sequences and a remainder. Pieces are dealt into random groups of bounded
expected size, and each group is packed by itself: pieces in decreasing length go to the first bin with room, which a
tournament tree over the bins' free space finds in logarithmic time. Groups are independent, so any number of executors
can pack, and the padding lost per group is at most a few bins.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftwarden.llm.common import materialize, text_hash

CAPACITY = 2048
END_ID = 1
#: Pieces of a group on average.
GROUP_PIECES = 4096
SEED = 31

#: The public vocabulary, and the same one as a table of ranks.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def encoder(vocabulary: str | None = None) -> Callable[[str], bytes]:
    """A function from text to its ids as little-endian 32-bit integers: those of ``vocabulary``, a file of the tokenizers library.

    The default vocabulary also exists as a table of ranks, with which the ids of ordinary text are found in a fifth of
    the time; a text that holds the string of a special token is left to the tokenizer.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary or public_tokenizers.path(VOCABULARY))

    def whole(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    if vocabulary:
        return whole
    import tiktoken

    with open(public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes:
        return whole(text) if any(s in text for s in special) else array("I", fast(text)).tobytes()

    return encode


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, text_key, start, length, doc_tokens, ids)``: the pieces of every document, ids little-endian 32-bit.

    Pieces are consecutive, all but the last ``capacity`` long. A NULL text is empty: one piece, the closing id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = encoder(vocabulary), END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            doc_ids, keys, texts = batch.columns
            for at in range(0, batch.num_rows, 256):
                rows, pieces = [], []
                for i in range(at, min(at + 256, batch.num_rows)):
                    ids = encode(texts[i].as_py() or "") + end
                    for s in range(0, len(ids), width):
                        rows.append((i, s // 4, len(ids) // 4))
                        pieces.append(ids[s:s + width])
                index, starts, tokens = (pa.array(x, pa.int64()) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(index), keys.take(index), starts, pa.array([len(p) // 4 for p in pieces], pa.int64()), tokens,
                     pa.array(pieces, pa.binary())], ["doc_id", "text_key", "start", "length", "doc_tokens", "ids"])

    return docs.select("doc_id", text_hash().alias("text_key"), "text").mapInArrow(
        run, "doc_id long, text_key long, start long, length long, doc_tokens long, ids binary")


class CapacityTree:
    """Tournament tree over bins: each inner node holds the larger free space of its two children."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def first_fit(self, length: int) -> tuple[int, int]:
        """Take ``length`` from the first bin with room; its number and the free space it had."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < length:
                node += 1
        had = free[node]
        free[node] = had - length
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; equal lengths are placed in the given order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = CapacityTree(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], had = tree.first_fit(int(lengths[i]))
        offsets[i] = capacity - had
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = SEED) -> DataFrame:
    """``pieces (doc_id, text_key, start, length, ...)``, a written table, with ``sequence_id`` and ``offset``.

    A piece's group depends on seed, doc_id, text and start; pieces alike in these are spread by their place in the
    written table, so repeated rows do not meet in one group. Lengths lie between 1 and ``capacity``. Bins of a group
    are numbered after those of the group before; numbers of unused bins are left out.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    dealt = pieces.withColumn("group__", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key", "start", place), F.lit(groups)))
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop(columns="group__").sort_values(["doc_id", "text_key", "start"], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return dealt.groupBy("group__").applyInPandas(run, schema)


def packed_pieces(docs: DataFrame, with_ids: bool = True, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs`` with its place; ``ids_crc32`` always, the ids themselves if wanted.

    Without ids only the pieces' numbers are shuffled. Repeated rows give repeated pieces; an empty table gives none.
    """
    pieces = cut_pieces(docs, vocabulary, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return pack(materialize(pieces if with_ids else pieces.drop("ids"), "pieces"), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, ids, tokens)``: the packed pieces joined in offset order and padded to ``capacity``.

    A sequence whose length is a power of two is left as it is. At most ``capacity`` ids meet in a row.
    """
    rows = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("p"), F.sum("length").alias("tokens"))
    power = F.expr("tokens & (tokens - 1)") == 0
    padding = F.when(power, F.lit("")).otherwise(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (capacity - F.col("tokens")).cast("int")))
    return rows.select("sequence_id", F.unhex(F.concat(F.array_join("p.ids", ""), padding)).alias("ids"), "tokens")
