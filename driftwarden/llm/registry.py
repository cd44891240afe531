"""Queries of this subpackage for the driver, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwarden.llm import (
    chat, mixing, neighbours, packing, periodic, quality, sharding, simhash, spelling, substring, syncmers, toxicity, url_filter,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their groups at four or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all documents, the base rules, and the verdict by adaptive thresholds."""
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by source weights takes of every document."""
    rows = mixing.measured(table(spark, sf_dir, "documents"))
    return mixing.mix(rows).select("doc_id", "source", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels outside the held-out fifth."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of all conversations as repaired and rendered."""
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized, cut and packed into sequences of 2048 tokens."""
    return packing.packed_pieces(table(spark, sf_dir, "documents"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_shard_by_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, equal texts side by side."""
    rows = sharding.measured(table(spark, sf_dir, "documents"))
    return sharding.assign(rows, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url; addresses of campaign pages are the list behind the cascade."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.campaign_addresses(pages)).drop("url")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-word passages known from a smaller doc_id."""
    return substring.dedup_digests(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows.select("vec_id", F.col("embedding").alias("vector")))


def op11_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncmer fingerprints of all documents and of their texts after an edit, and how alike they and the next document are."""
    rows = syncmers.edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        syncmers.as_text(F.col("marks")).alias("fingerprint"), syncmers.as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        syncmers.likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of them with a planted periodic end."""
    return periodic.digests(periodic.periodic_runs(periodic.with_planted_periods(table(spark, sf_dir, "documents"))))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, some with a planted misspelling, and the much commoner words they are variants of."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_components": op1_simhash_components,
    "op2_quality_rules": op2_quality_rules,
    "op3_mix_sources": op3_mix_sources,
    "op4_toxicity": op4_toxicity,
    "op5_chat_format": op5_chat_format,
    "op6_pack_sequences": op6_pack_sequences,
    "op7_shard_by_splitters": op7_shard_by_splitters,
    "op8_filter_urls": op8_filter_urls,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_syncmer_fingerprints": op11_syncmer_fingerprints,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality.ORACLE_SQL,
    "op8_filter_urls": url_filter.ORACLE_SQL,
    "op9_substring_dedup": substring.ORACLE_SQL,
}
