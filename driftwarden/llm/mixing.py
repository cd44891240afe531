"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share a budget by weight, up to a number of epochs each. Every document of a source is taken once per complete
epoch; the rest of the source's budget goes to a weighted sample: each document draws an exponential key divided by its
quality weight, keys are sorted within the source, and sizes are summed along them up to the budget.

The sums are not a window over a source, which may hold a third of all rows. Keys fall into ``KEY_BUCKETS`` ranges by a
fixed monotone map; the ranges' sizes are summed along each source (one row per range), and only the range that holds the
end of the budget is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftwarden.llm.common import WORD, by_shuffle, give_back, materialize, set_aside, small_side, text_hash

WEIGHTS = (5, 2, 1)
EPOCHS = 3
KEY_BUCKETS = 1 << 12
SEED = 2024


def size_in_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """1 for text without the symbols of markup and tables, falling to 1/11 as they make up all of it."""
    plain = F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(1.0 / (1.0 + 10.0 * (1.0 - plain / F.nullif(F.length(text), F.lit(0)))), F.lit(1.0))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size)`` to the same with ``weight`` and ``target``.

    Weights repeat along the sources' order (code points, NULL last). Sharing by weight with a ceiling per source and
    handing the excess on is water filling: targets are ``min(epochs * size, level * weight)`` with one common level, which
    lies between two neighbouring ceilings per weight. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("ceiling", F.lit(epochs) * F.col("source_size"))
    up_to = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumns({
        "budget": F.sum("source_size").over(every),
        "full": F.coalesce(F.sum("ceiling").over(up_to.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(up_to.rowsBetween(0, Window.unboundedFollowing))})
    level = (F.col("budget") - F.col("full")) / F.col("open")
    # the first source whose ceiling is not reached sets the level; later ones would put it lower
    s = s.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("ceiling"), level)).over(every))
    target = F.least(F.col("ceiling").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def key_bucket(key: Column) -> Column:
    return F.floor(KEY_BUCKETS * key / (1 + key)).cast("int")


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, cut: bool = True, seed: int = SEED) -> DataFrame:
    """``rows (doc_id, text_key, source, size, quality)``, a written table, with ``source_size``, ``target`` and ``taken``.

    ``taken`` counts words, repeats included. The document at which a source's budget ends gives the words still missing
    (``cut``), or is taken whole if that comes nearer to the budget. The draw depends on seed, doc_id and text alone, so
    reruns agree; equal keys are ordered by doc_id and text. Rows alike in both get the same draw, each takes part, and
    which of them ends the budget does not show. NULL sources are a source; NULL qualities weigh 1; a size of 0 takes 0.
    """
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_key"), 11) + 1) / F.lit(float(1 << 53))
    keyed = rows.withColumn("key__", -F.log(unit) / F.greatest(F.coalesce("quality", F.lit(1.0)), F.lit(1e-9)))
    keyed = keyed.withColumn("bucket__", key_bucket(F.col("key__")))
    parts = materialize(keyed.groupBy("source", "bucket__").agg(F.sum("size").alias("part")), "key-ranges")
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, epochs)
    targets = targets.withColumn("whole", F.floor(F.col("target") / F.nullif("source_size", F.lit(0)) + 1e-12)).withColumn(
        "rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    targets = materialize(targets.withColumnRenamed("source", "source__"), "targets")
    along = Window.partitionBy("source").orderBy("bucket__").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.withColumn("upto", F.sum("part").over(along)).join(small_side(targets), F.expr("source <=> source__"))
    ends = ends.groupBy(F.col("source__").alias("ended__")).agg(
        F.min(F.when(F.expr("upto > rest"), F.col("bucket__"))).alias("end_bucket"),
        F.coalesce(F.max(F.when(F.expr("upto <= rest"), F.col("upto"))), F.lit(0)).alias("before"))
    limits = small_side(materialize(targets.join(ends, F.expr("source__ <=> ended__")).drop("ended__"), "limits"))
    joined = keyed.join(limits, F.expr("source <=> source__"), "left")
    at_end = F.expr("bucket__ = end_bucket")
    # only the rows of the ranges in which a budget ends are sorted; the others are all in or all out
    first = Window.partitionBy("source").orderBy("key__", F.col("doc_id").asc_nulls_last(), "text_key")
    inside = joined.where(at_end).withColumn("before", F.col("before") + F.sum("size").over(
        first.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    room = F.col("rest") - F.col("before")
    piece = F.least(F.col("size"), room) if cut else F.when(2 * room >= F.col("size"), F.col("size"))
    inside = inside.withColumn("extra", F.when(room > 0, piece).otherwise(0))
    outside = joined.where(~F.coalesce(at_end, F.lit(False))).withColumn(
        "extra", F.when(F.expr("end_bucket IS NULL OR bucket__ < end_bucket"), F.col("size")).otherwise(0))
    taken = F.coalesce(F.col("whole") * F.col("size") + F.coalesce("extra", F.lit(0)), F.lit(0))
    return outside.unionByName(inside).select(
        *rows.columns, F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        taken.cast("long").alias("taken"))


def measured(docs: DataFrame) -> DataFrame:
    """What the mix needs to know of each row, without its text, as a written table."""
    return materialize(docs.select("doc_id", text_hash().alias("text_key"), "source", size_in_words().alias("size"),
                                   quality_weight().alias("quality")), "sizes")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """``docs`` as mixed: whole documents, each repeated as often as the mix takes it, with its columns.

    Rows alike in doc_id, text and source share the copies taken of them as evenly as they divide. Further columns may
    have any name.
    """
    same = {"id__": F.coalesce("doc_id", F.lit(-(1 << 63))), "source__": text_hash("source")}
    rows = set_aside(docs)
    copies = mix(measured(rows), cut=False, **params).withColumns(same).groupBy(
        "id__", "source__", F.col("text_key").alias("key__")).agg(
        F.count("*").alias("rows__"), F.sum(F.expr("taken div nullif(size, 0)")).alias("taken__")).where("taken__ > 0")
    keyed = rows.withColumns(same | {"key__": text_hash()}).join(by_shuffle(copies), ["id__", "source__", "key__"])
    alike = Window.partitionBy("id__", "source__", "key__").orderBy(F.lit(1))
    times = F.expr("int(taken__ div rows__) + int(rn__ <= taken__ % rows__)")
    return give_back(keyed.withColumn("rn__", F.row_number().over(alike)).withColumn(
        "copy__", F.explode(F.array_repeat(F.lit(1), times))), docs)
