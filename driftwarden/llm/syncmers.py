"""Fingerprints of texts from closed syncmers, by built-in functions only.

A k-mer is K bytes of a text's UTF-8; it is a closed syncmer if the least hash among its inner S-byte substrings lies at
its first or last place (ties count). That depends on the k-mer alone, so a passage has the same anchors wherever it
stands, and among any K - S + 1 neighbouring k-mers at least one is chosen. Hence the anchors of a text are those of its
parts plus those of the few k-mers across each cut, which is used twice: long texts are read in pieces that overlap by
K - 1 bytes, and an edited text takes the anchors of the kept part from the original.

A fingerprint is the MARKS least distinct anchor hashes; two fingerprints estimate the Jaccard likeness of the two sets.
A text without any syncmer (all texts under K bytes) has one mark, the hash of the whole; the empty text has none.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

K, S = 32, 17
MARKS = 64
#: Bytes of a text whose hashes are held at once.
PIECE = 1 << 16
#: Ranges that the order of documents is dealt to at most, and the bytes of text for one range.
MOST_RANGES, RANGE_BYTES = 4096, 128 << 20
CHUNK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _mark(value: Column) -> Column:
    """31-bit hash of bytes."""
    return F.shiftrightunsigned(F.xxhash64(value), 33).cast("int")


def anchors(piece: Column, k: int = K, s: int = S) -> Column:
    """``array<struct<at, mark>>``: places (from 1) and hashes of the closed syncmers of a binary value, in order."""
    w = k - s + 1

    def among(h: Column) -> Column:
        edge = F.transform(h, lambda x, i: F.least(x, F.get(h, i + (w - 1))))
        # NULL past the last k-mer, whose last substring there is none of
        inner = lambda e, i: reduce(lambda a, b: a & b, [e <= F.get(h, i + j) for j in range(1, w)])
        places = F.filter(F.transform(edge, lambda e, i: F.when(inner(e, i), i + 1)), lambda i: i.isNotNull())
        return F.transform(places, lambda i: F.struct(i.alias("at"), _mark(F.substring(piece, i, F.lit(k))).alias("mark")))

    hashes = F.transform(F.sequence(F.lit(1), F.length(piece) - (s - 1)), lambda i: F.xxhash64(F.substring(piece, i, F.lit(s))))
    return F.when(F.length(piece) >= k, _let(hashes, among)).otherwise(F.array().cast("array<struct<at:int,mark:int>>"))


def _pieces(text: Column, k: int, size: int) -> Column:
    """``array<struct<skip, bytes>>``: a binary value in pieces that overlap by ``k - 1`` bytes, with the bytes before each."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / size).cast("int")), lambda i: F.struct(
        (i * size).alias("skip"), F.substring(text, i * size + 1, F.lit(size + k - 1)).alias("bytes")))


def least_marks(marks: Column, most: int = MARKS) -> Column:
    """The ``most`` least distinct marks, in order."""
    return F.slice(F.sort_array(F.array_distinct(marks)), 1, most)


def _sketches(text: Column, head: Column, k: int, s: int, most: int, size: int) -> Column:
    """``struct<whole, head>``: least marks of a binary value and of its first ``head`` bytes."""
    def of(piece: Column, head: Column) -> Column:
        def pick(found: Column) -> Column:
            inside = F.filter(found, lambda a: a["at"] + (k - 1) <= head - piece["skip"])
            return F.struct(least_marks(F.transform(found, lambda a: a["mark"]), most).alias("whole"),
                            least_marks(F.transform(inside, lambda a: a["mark"]), most).alias("head"))

        return _let(_let(piece["bytes"], lambda b: anchors(b, k, s)), pick)

    def joined(parts: Column) -> Column:
        return F.struct(*[least_marks(F.flatten(F.transform(parts, lambda p: p[c])), most).alias(c) for c in ("whole", "head")])

    # what an expression inside a lambda is built from would be computed for every element
    return _let(text, lambda t: _let(head, lambda h: _let(F.transform(_pieces(t, k, size), lambda p: of(p, h)), joined)))


def _or_whole(marks: Column, text: Column) -> Column:
    """``marks``, or the mark of the whole text if there are none; the empty text has none."""
    return F.when((F.size(marks) > 0) | (F.length(text) == 0), marks).otherwise(F.array(_mark(text)))


def with_fingerprints(docs: DataFrame, k: int = K, s: int = S, most: int = MARKS, size: int = PIECE) -> DataFrame:
    """``(doc_id, marks)`` of every row: its least marks in order. A NULL text counts as empty; other columns are not read."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", text.alias("b"))
    return rows.withColumn("m", _sketches(F.col("b"), F.lit(0), k, s, most, size)["whole"]).select(
        "doc_id", _or_whole(F.col("m"), F.col("b")).alias("marks"))


def syncmers(docs: DataFrame, k: int = K, s: int = S, size: int = PIECE) -> DataFrame:
    """``(doc_id, at, mark)``: every closed syncmer of every text, by its byte place from 0, for positional matching.

    Repeats have a row each. NULL and empty texts and those under ``k`` bytes have none; rows that repeat a doc_id are not merged.
    """
    pieces = F.explode(_pieces(F.coalesce(F.col("text"), F.lit("")).cast("binary"), k, size)).alias("piece")
    rows = docs.select("doc_id", pieces).select("doc_id", "piece.skip", F.explode(anchors(F.col("piece.bytes"), k, s)).alias("a"))
    return rows.select("doc_id", (F.col("skip") + F.col("a.at") - 1).cast("long").alias("at"), "a.mark")


def likeness(a: Column, b: Column, most: int = MARKS) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1: the share of both among the least marks of their union."""
    union = least_marks(F.concat(a, b), most)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def as_text(marks: Column) -> Column:
    """A fingerprint as text: eight hex digits a mark."""
    return F.array_join(F.transform(marks, lambda m: F.lpad(F.lower(F.hex(m)), 8, "0")), "")


#: Order of documents: descending doc_id, NULL last; rows that share a doc_id by the hash of their texts.
ORDER = ("none", "down", "key")


def _ordered(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.withColumns({"none": F.col("doc_id").isNull(), "down": F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(0)),
                             "key": F.xxhash64("text")})


def _first_of_ranges(rows: DataFrame, ranges: int | None) -> list[tuple]:
    """The first order key of each of at most MOST_RANGES ranges with about as many rows each, ascending."""
    if ranges is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = min(MOST_RANGES, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    first = rows.select(*ORDER).repartitionByRange(ranges, *ORDER).groupBy(F.spark_partition_id().alias("range")).agg(
        F.min(F.struct(*ORDER)).alias("first"))
    return sorted(tuple(r.first) for r in first.select("first").collect())


_PLACE = "struct<none:boolean,down:bigint,key:bigint>"


def _range_of(firsts: list[tuple]) -> Column:
    """Number of the range that a row belongs to: a search in two steps, so that thousands of ranges cost little."""
    rows = [dict(zip(ORDER, f)) for f in firsts]
    chunks = F.from_json(F.lit(json.dumps([rows[i:i + CHUNK] for i in range(0, len(rows), CHUNK)])), f"array<array<{_PLACE}>>")
    here = F.struct(*ORDER)
    upto = F.size(F.filter(chunks, lambda c: F.get(c, F.lit(0)) <= here))
    return F.when(upto > 0, (upto - 1) * CHUNK + F.size(F.filter(F.get(chunks, upto - 1), lambda c: c <= here)) - 1).otherwise(0)


def with_next(docs: DataFrame, ranges: int | None = None, k: int = K, s: int = S, most: int = MARKS, size: int = PIECE) -> DataFrame:
    """``(doc_id, text, marks, head_marks, next_text, next_marks)``: every row with the next one by descending doc_id, the first after the last.

    ``head_marks`` are the least marks of the text's upper half, its first ``ceil(n / 2)`` code points. Rows are dealt once, with their
    texts, to ranges of the order; in each range they meet in a window. The first row of the following range is read once more and put
    at the end of a range, so no window spans the table. NULL texts count as empty; a NULL doc_id comes last; rows that share a doc_id
    are ordered by the hash of their text, so rows alike in both follow each other, and lie in one range.
    """
    rows = _ordered(docs)
    firsts = _first_of_ranges(rows, ranges)
    ends = rows.sparkSession.createDataFrame([(*f, (i - 1) % len(firsts)) for i, f in enumerate(firsts)],
                                             "none boolean, down bigint, key bigint, range int")
    # a row per range, each range's first key: MOST_RANGES at the most
    border = rows.join(F.broadcast(ends), list(ORDER)).dropDuplicates(["range"]).withColumn("border", F.lit(True))
    dealt = rows.withColumns({"range": _range_of(firsts), "border": F.lit(False)}).unionByName(border)
    head = F.octet_length(F.left("text", F.length("text") - F.floor(F.length("text") / 2).cast("int")))
    dealt = dealt.withColumn("m", _sketches(F.col("text").cast("binary"), head, k, s, most, size)).select(
        "doc_id", "text", *ORDER, "range", "border", _or_whole(F.col("m.whole"), F.col("text").cast("binary")).alias("marks"),
        F.col("m.head").alias("head_marks"))
    order = Window.partitionBy("range").orderBy("border", *ORDER)
    return dealt.withColumns({"next_text": F.lead("text").over(order), "next_marks": F.lead("marks").over(order)}).where("NOT border").select(
        "doc_id", "text", "marks", "head_marks", "next_text", "next_marks")


def edited(docs: DataFrame, ranges: int | None = None, k: int = K, s: int = S, most: int = MARKS, size: int = PIECE) -> DataFrame:
    """``(doc_id, n_chars, edited, marks, edited_marks, next_marks)``: texts whose last half gave way to the start of the next document.

    The last ``floor(n / 2)`` code points are replaced by the first as many (or all) of the next text. The edited text's fingerprint is
    merged from the marks of the kept part and those of the rest with the ``k - 1`` bytes before it.
    """
    rows = with_next(docs, ranges, k, s, most, size).withColumn("n", F.length("text"))
    rows = rows.withColumns({"kept": F.left("text", F.col("n") - F.floor(F.col("n") / 2).cast("int")),
                             "put": F.left("next_text", F.floor(F.col("n") / 2).cast("int"))})
    kept, put = F.col("kept").cast("binary"), F.col("put").cast("binary")
    before = F.greatest(F.length(kept) - (k - 1), F.lit(0))
    rows = rows.withColumns({"rest": F.concat(F.substring(kept, before + 1, F.lit(k - 1)), put), "edited": F.concat("kept", "put")})
    rows = rows.withColumn("rest_marks", _sketches(F.col("rest"), F.lit(0), k, s, most, size)["whole"])
    merged = least_marks(F.concat("head_marks", "rest_marks"), most)
    return rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), "edited", "marks",
                       _or_whole(merged, F.col("edited").cast("binary")).alias("edited_marks"), "next_marks")
