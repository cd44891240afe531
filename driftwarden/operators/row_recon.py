"""Row counts, key checksums and fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.config import TablePair
from driftwarden.functions.conversion import canonical_text, percent_of
from driftwarden.functions.fingerprint import digest, fast_fingerprint, md5_prefix, portable_fingerprint, row_text
from driftwarden.functions.names import orderable, quoted
from driftwarden.session import written
from driftwarden.sources.local import table_list


def _union_of_sides(pairs: Sequence[TablePair], value_of: Callable[[TablePair], Column], name: str) -> DataFrame:
    """(table, side, value) of every row of every table.

    All tables go through one aggregate afterwards, so their scans run side by side in one stage.
    """
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(p.name).alias("table_name"), F.lit(is_source).alias("is_source"), value_of(p).alias(name))
        for p in pairs for df, is_source in ((p.source, True), (p.target, False))])


def comparable(pair: TablePair, column: str) -> Column:
    """The value itself if both sides have one type, else its text."""
    dtype, value = pair.source.schema[column].dataType, F.col(quoted(column))
    return orderable(value, dtype) if dtype == pair.target.schema[column].dataType else canonical_text(value)


def _key_digest(pair: TablePair) -> Column:
    return F.when(F.col(quoted(pair.key)).isNotNull(), digest([comparable(pair, pair.key)]))


def _row_digest(pair: TablePair, columns: Sequence[str] | None = None) -> Column:
    listed = [pair.key, *(pair.shared_columns() if columns is None else columns)]
    return digest([comparable(pair, c) for c in listed])


def row_recon(pairs: Sequence[TablePair], checksum_scope: str = "key") -> DataFrame:
    """Counts, delta, checksum match and status per table.

    The checksum covers the keys, and then only key columns are read. ``checksum_scope="row"``
    covers the shared columns as well, so that a changed value is a mismatch too.
    """
    value_of = {"key": _key_digest, "row": _row_digest}[checksum_scope]
    on_source = F.col("is_source")
    sides = _union_of_sides(pairs, value_of, "digest").groupBy("table_name").agg(
        F.count_if(on_source).alias("source_count"),
        F.count_if(~on_source).alias("target_count"),
        fast_fingerprint(F.col("digest"), on_source).alias("source_print"),
        fast_fingerprint(F.col("digest"), ~on_source).alias("target_print"))
    return _with_status(_all_tables(pairs, sides), F.col("source_print") == F.col("target_print"))


def _all_tables(pairs: Sequence[TablePair], sides: DataFrame) -> DataFrame:
    """Add tables that are empty on both sides. One row per table, hence the broadcast."""
    names = table_list(sides.sparkSession, [p.name for p in pairs]).select("table_name")
    return names.join(F.broadcast(sides), "table_name", "left").fillna(0, ["source_count", "target_count"])


def _with_status(sides: DataFrame, same: Column) -> DataFrame:
    delta = F.col("source_count") - F.col("target_count")
    return (
        sides.withColumn("delta", delta)
        .withColumn("delta_pct", percent_of(F.col("delta"), F.col("source_count")))
        .withColumn("checksum_match", F.coalesce(same, F.lit(True)))
        .withColumn("row_status", F.when((F.col("delta") == 0) & F.col("checksum_match"), "MATCH")
                    .otherwise("MISMATCH"))
        .select("table_name", "source_count", "target_count", "delta", "delta_pct", "checksum_match", "row_status")
    )


def key_checksum_exact(pairs: Sequence[TablePair]) -> DataFrame:
    """Whether both sides hold exactly the same keys, each equally often, without any hashing.

    A checksum of the concatenated ordered keys needs all keys in one place. Counting +1 for a
    source key and -1 for a target key decides the same question on every executor: the sides
    agree when every key sums to zero.
    """
    keys = _union_of_sides(pairs, lambda p: canonical_text(F.col(quoted(p.key))), "text")
    signed = keys.filter(F.col("text").isNotNull()).groupBy("table_name", "text").agg(
        F.sum(F.when(F.col("is_source"), 1).otherwise(-1)).alias("surplus"))
    per_table = signed.groupBy("table_name").agg(F.count_if(F.col("surplus") != 0).alias("differing_keys"))
    names = table_list(per_table.sparkSession, [p.name for p in pairs]).select("table_name")
    return (
        names.join(F.broadcast(per_table), "table_name", "left").fillna(0, ["differing_keys"])
        .withColumn("checksum_match", F.col("differing_keys") == 0)
    )


def key_fingerprint(pairs: Sequence[TablePair]) -> DataFrame:
    """Count and portable fingerprint of the keys, per table and side."""
    return _portable(_union_of_sides(pairs, lambda p: canonical_text(F.col(quoted(p.key))), "text"))


def row_fingerprint(pairs: Sequence[TablePair]) -> DataFrame:
    """Count and portable fingerprint of whole rows (the shared columns), per table and side."""
    return _portable(_union_of_sides(
        pairs, lambda p: row_text([orderable(F.col(quoted(c)), p.source.schema[c].dataType) for c in (p.key, *p.shared_columns())]), "text"))


def _portable(rows: DataFrame) -> DataFrame:
    return rows.groupBy("table_name", "is_source").agg(
        F.count(F.lit(1)).alias("row_count"), portable_fingerprint(F.col("text")).alias("fingerprint"),
    ).select("table_name", F.when(F.col("is_source"), "source").otherwise("target").alias("side"),
             "row_count", "fingerprint")


def _bucket_of(pair: TablePair, buckets: int, portable: bool) -> Column:
    number = md5_prefix(canonical_text(F.col(quoted(pair.key)))) if portable else _key_digest(pair)
    return F.coalesce(F.pmod(number, F.lit(buckets)), F.lit(0))


def bucket_fingerprint(pair: TablePair, buckets: int, columns: Sequence[str] = (), portable: bool = True) -> DataFrame:
    """Hash buckets of the key whose content (keys and the listed columns) differs between the sides.

    Each task passes on at most ``buckets`` partial rows, so this finds where two huge tables
    differ before any row is moved. ``portable`` buckets can be recomputed by other SQL engines.
    """
    def side(df: DataFrame, is_source: bool) -> DataFrame:
        return df.select(
            F.lit(is_source).alias("is_source"), _bucket_of(pair, buckets, portable).alias("bucket"),
            _row_digest(pair, columns).alias("digest"))

    on_source = F.col("is_source")
    both = side(pair.source, True).unionByName(side(pair.target, False))
    return both.groupBy("bucket").agg(
        F.count_if(on_source).alias("source_count"),
        F.count_if(~on_source).alias("target_count"),
        fast_fingerprint(F.col("digest"), on_source).alias("s"),
        fast_fingerprint(F.col("digest"), ~on_source).alias("t"),
    ).filter(F.col("s") != F.col("t")).select("bucket", "source_count", "target_count")


def narrow_to_changed(pair: TablePair, columns: Sequence[str] | None = None, buckets: int = 4096) -> TablePair:
    """The pair cut to the hash buckets whose content differs, for comparing tables that mostly agree.

    It costs a second scan and saves the shuffle of every row in a matching bucket, so only
    differing rows and their bucket neighbours reach a comparison by value. The result of such
    a comparison is the same up to 66-bit hash sums. At most ``buckets`` numbers are broadcast.
    Where changes are scattered over more than half of the buckets a cut would save nothing, and the pair comes back as it is.
    """
    columns = list(columns or pair.shared_columns())
    unequal, count = written(bucket_fingerprint(pair, buckets, columns, portable=False).select(F.col("bucket").alias("_bucket")), "unequal-buckets")
    if 2 * count > buckets:
        return pair
    unequal = F.broadcast(unequal)

    def cut(df: DataFrame) -> DataFrame:
        in_bucket = df.withColumn("_bucket", _bucket_of(pair, buckets, portable=False))
        return in_bucket.join(unequal, "_bucket", "left_semi").drop("_bucket")

    return TablePair(pair.name, pair.key, cut(pair.source), cut(pair.target))
