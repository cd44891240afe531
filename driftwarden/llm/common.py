"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftwarden.session import materialize

#: A word is a longest run of bytes other than the blank and 0x09-0x0D; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

#: Rows of a side that may be broadcast; larger sides are joined by shuffling.
BROADCAST_ROWS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table, marked for broadcast if it has been counted and has few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join with whole texts that is never broadcast: it grows with them."""
    return df.hint("merge")


def set_aside(docs: DataFrame, needed: tuple[str, ...] = ("doc_id", "text", "lang", "source")) -> DataFrame:
    """``docs`` with every column that the operator does not read under a name no operator uses, by position."""
    return docs.toDF(*[c if c in needed else f"aside_{i}__" for i, c in enumerate(docs.columns)])


def give_back(rows: DataFrame, docs: DataFrame, needed: tuple[str, ...] = ("doc_id", "text", "lang", "source")) -> DataFrame:
    """The columns of ``docs``, in order and with their names, from ``rows`` made out of ``set_aside(docs, needed)``."""
    return rows.select(*set_aside(docs, needed).columns).toDF(*docs.columns)


def text_hash(text: str = "text") -> Column:
    """64-bit hash of a text; NULL differs from the empty text."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


__all__ = ["BLANK", "BROADCAST_ROWS", "LOWER", "UPPER", "WORD", "by_shuffle", "give_back", "materialize", "set_aside", "small_side", "text_hash"]
