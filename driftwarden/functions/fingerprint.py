"""Order-free, mergeable fingerprints of keys and rows.

Each value is hashed on its own and the hashes are added up, so a fingerprint is an ordinary
aggregate: it combines on the map side, needs no sort and does not depend on partitioning.
A sum (unlike an xor) also notices a key that occurs twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LANES = (0, 22, 44)  # a 64-bit hash in 22-bit pieces: long sums stay exact up to 2^41 rows
_LANE_MASK = (1 << 22) - 1


def md5_prefix(text: Column) -> Column:
    """First 60 bits of the MD5 digest as a number; any SQL engine can compute the same value."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def portable_fingerprint(text: Column) -> Column:
    """Aggregate: sum of 60-bit MD5 prefixes, exact to about 10^20 rows. NULLs are left out."""
    return F.coalesce(F.sum(md5_prefix(text).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def digest(columns: list[Column]) -> Column:
    """64-bit hash of the values as they are, far cheaper than a hash of their text.

    The hash passes over NULLs, so each column's NULL flag is hashed with it; otherwise
    (NULL, 'a') and ('a', NULL) would be the same row.
    """
    return F.xxhash64(*[x for c in columns for x in (c, c.isNull())])


def fast_fingerprint(digests: Column, where: Column | None = None) -> Column:
    """Aggregate: sum of 64-bit digests, NULLs left out. Comparable only between Spark jobs.

    ``where`` restricts it to some of the rows of the group.
    """
    counted = digests if where is None else F.when(where, digests)
    lanes = [F.sum(F.shiftrightunsigned(counted, s).bitwiseAND(F.lit(_LANE_MASK))) for s in _LANES]
    return F.struct(*[F.coalesce(lane, F.lit(0)).alias(f"lane{i}") for i, lane in enumerate(lanes)])


def row_text(columns: list[Column]) -> Column:
    """One text per row. A leading 'v' marks values, so NULL, '' and 'n' stay distinct."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns]
    return F.concat_ws("\x1f", *parts)
