"""Quality rules whose thresholds come from the data: mergeable quantile sketches per language and source.

A sketch is a histogram with buckets of 1/64 relative width: integer values below 128 are kept exactly, larger ones by
their seven leading bits. Two sketches merge by adding counts, so building them is one aggregate with map-side
combination, a language's sketch is the sum of its sources' sketches, and the result does not depend on order, size of
partitions or retries. Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftwarden.llm.common import WORD, give_back, materialize, set_aside, small_side

SYMBOLS = r"[#*$%&|<>]"
PIECE = 1 << 16  # characters of a long text that are cut into words or lines at a time
SORTED = 1 << 18  # trigrams of a text that are sorted at a time

#: Base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

#: Adaptive rules: integer measure, whether low values fail too, the percentile at which a fence starts, and the margin
#: beyond it: how many spreads, and the least spread (the measure's resolution). A spread is the mean distance from the median
#: of the values above (below) it, without the ``TRIM`` percent furthest out; where most values are zero it still follows the
#: group. Measures that junk drives far out start at a quartile, since junk may make up several percent of a group; those that
#: the base rules bound start at the last percentile. A text without words has no rates: Spark may evaluate rules ahead of the base
#: rules that it fails, and must not divide by zero there.
RATES = {
    "word_length": ("word_chars * 1000 div nullif(n_words, 0)", True, 75, 8, 100),
    "symbols": ("n_symbols * 1000 div nullif(n_words, 0)", False, 75, 2, 10),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", False, 99, 10, 10),
    "repeats": ("n_repeat_words * 1000 div nullif(n_words, 0)", False, 99, 20, 3),
}
TRIM = 5
#: Rows a sketch needs; below that the language's sketch is taken, then that of the whole corpus.
LEAST_ROWS = 100


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pieces(text: Column, end: str) -> Column:
    """A long text as pieces of about ``PIECE`` characters, each up to where ``end`` stops; together they are the text."""
    return F.when(F.length(text) > PIECE, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+{end}"), F.lit(0))).otherwise(F.array(text))


def _repeated(grams: Column) -> Column:
    """Places of the hashes that occur more than once. Hashes are sorted in groups of about ``SORTED``, not all at once."""
    groups = F.expr(f"CAST(size(grams__) div {SORTED} + 1 AS INT)")
    own = lambda g: F.sort_array(F.filter(F.transform(grams, lambda h, i: F.when(
        F.pmod(h, groups) == g, F.struct(h.alias("h"), i.alias("i")))), F.isnotnull))
    again = lambda order: F.transform(F.filter(order, lambda x, i: F.coalesce(
        (F.get(order, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(order, i - 1)["h"] == x["h"])), F.lit(False))), lambda x: x["i"])
    return F.sort_array(F.flatten(F.transform(F.sequence(F.lit(0), groups - 1), lambda g: _bound(own(g), again))))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``measures__``; all other columns stay as they are.

    Steps are columns of their own where a later expression uses them more than once, so that they are computed once.
    Words and lines are 64-bit hashes, taken piece by piece, so that a text of many megabytes never stands in memory as
    strings of its words. A trigram is a hash of its words. Trigrams sort next to their equals, and each word they cover
    counts once: between the starts of neighbouring repeats at most three new words begin.
    """
    text = F.coalesce("text", F.lit(""))
    of_words = lambda words, piece: F.struct(
        F.transform(words, lambda w: F.xxhash64(w)).alias("words"), F.length(F.array_join(words, "")).cast("long").alias("chars"),
        F.regexp_count(piece, F.lit(SYMBOLS)).cast("long").alias("symbols"))
    of_lines = lambda piece: F.transform(
        F.filter(F.split(piece, "\n"), lambda x: F.rlike(x, F.lit(WORD))), lambda x: F.xxhash64(x))
    d = docs.withColumns({
        "pieces__": F.transform(_pieces(text, r"[^\x20\x09-\x0D]*+"), lambda p: _bound(
            F.regexp_extract_all(p, F.lit(WORD), F.lit(0)), lambda words: of_words(words, p))),
        "lines__": F.flatten(F.transform(_pieces(text, r"[^\n]*+"), of_lines))})
    total = lambda name: F.aggregate("pieces__", F.lit(0).cast("long"), lambda n, p: n + p[name])
    d = d.withColumns({"words__": F.flatten(F.col("pieces__.words")), "chars__": total("chars"), "symbols__": total("symbols")})
    d = d.drop("pieces__").withColumn("grams__", F.when(F.size("words__") > 2, F.slice(F.transform(
        "words__", lambda w, i: F.xxhash64(w, F.get("words__", i + 1), F.get("words__", i + 2))),
        F.lit(1), F.size("words__") - 2)).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("repeats__", F.size("grams__") > F.size(F.array_distinct("grams__")))
    d = d.withColumn("starts__", F.when(F.col("repeats__"), _repeated(F.col("grams__"))))
    covered = F.aggregate(F.transform("starts__", lambda s, i: F.least(
        F.lit(3), F.coalesce(F.get("starts__", i + 1), s + 3) - s)), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("measures__", F.struct(
        F.size("words__").cast("long").alias("n_words"),
        F.col("chars__").alias("word_chars"),
        F.col("symbols__").alias("n_symbols"),
        F.size("lines__").cast("long").alias("n_lines"),
        (F.size("lines__") - F.size(F.array_distinct("lines__"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")))
    return d.drop("words__", "chars__", "symbols__", "lines__", "grams__", "repeats__", "starts__")


def base_failed(least_words: str = str(LEAST_WORDS), most_repeated: str = str(MOST_REPEATED_PERCENT)) -> Column:
    return F.expr(f"measures__.n_words < {least_words} OR 100 * measures__.n_repeat_words > {most_repeated} * measures__.n_words")


def _rate(name: str) -> str:
    expression = RATES[name][0]
    for field in ("word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_words"):
        expression = expression.replace(field, f"measures__.{field}")
    return expression


def bucket(value: Column) -> Column:
    """Sketch bucket of an integer of 0 or more."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return (F.lit(64) * shift + F.call_function("shiftright", value, shift)).cast("long")


def bucket_floor(index: Column) -> Column:
    """Smallest value of a bucket."""
    wide = F.call_function("shiftleft", F.lit(64).cast("long") + index % 64, (F.floor(index / 64) - 1).cast("int"))
    return F.when(index < 128, index).otherwise(wide)


def sketches(measured: DataFrame) -> DataFrame:
    """``(level, lang, source, rate, bucket, n)``: the counts of the groups, languages and corpus, of documents past the base rules."""
    rows = measured.where(~base_failed()).select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(n).alias("rate"), bucket(F.expr(_rate(n))).alias("bucket")) for n in RATES])).alias("r"))
    groups = rows.groupBy("lang", "source", "r.rate", "r.bucket").agg(F.count("*").alias("n"))
    return groups.select(F.explode(F.array(*[F.struct(
        F.lit(level).alias("level"), (F.col("lang") if level < 2 else F.lit(None).cast("string")).alias("lang"),
        (F.col("source") if level < 1 else F.lit(None).cast("string")).alias("source"), "rate", "bucket", "n")
        for level in range(3)])).alias("s")).select("s.*").groupBy("level", "lang", "source", "rate", "bucket").agg(
        F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """``(level, lang, source, rate, rows, low, high)`` of each sketch; the value at percentile ``p`` has rank ``ceil(p n / 100)``.

    The spreads need no second pass: the distances from the median are summed as values of the ranks beyond it, less as
    often the median.
    """
    keys = ["level", "lang", "source", "rate"]
    group = Window.partitionBy(*keys)
    ranked = sketch.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "rows": F.sum("n").over(group),
                                 "value": bucket_floor(F.col("bucket"))})
    rank = lambda p: f"((rows * {p} + 99) div 100)"
    at = lambda p: F.min(F.when(F.col("upto") >= F.expr(rank(p)), F.col("value")))
    # rows of a bucket with ranks from the median to the trimmed ends
    above = F.expr(f"greatest(least(upto, {rank(100 - TRIM)}) - greatest(upto - n, {rank(50)}), 0)")
    below = F.expr(f"greatest(least(upto, {rank(50)}) - greatest(upto - n, {rank(TRIM)} - 1), 0)")
    q = ranked.groupBy(*keys).agg(
        F.first("rows").alias("rows"), at(50).alias("median"), F.sum(F.col("value") * above).alias("sum_above"), F.sum(above).alias("n_above"),
        F.sum(F.col("value") * below).alias("sum_below"), F.sum(below).alias("n_below"),
        *[at(p).alias(f"q{p}") for p in sorted({x for _, _, start, _, _ in RATES.values() for x in (start, 100 - start)})])
    low, high = F.lit(None).cast("long"), F.lit(None).cast("long")
    for name, (_, two_sided, start, spreads, least) in RATES.items():
        mine = F.col("rate") == name
        high = F.when(mine, F.expr(f"q{start} + {spreads} * greatest((sum_above - n_above * median) div rows, {least})")).otherwise(high)
        if two_sided:
            low = F.when(mine, F.expr(f"q{100 - start} - {spreads} * greatest((n_below * median - sum_below) div rows, {least})")).otherwise(low)
    return q.select(*keys, "rows", low.alias("low"), high.alias("high"))


def thresholds(measured: DataFrame) -> DataFrame:
    """``(lang, source, <rate>_low, <rate>_high ..., least_words, most_repeated)``, one row per group that has a document past the base rules.

    A group of fewer than ``LEAST_ROWS`` documents takes its language's fences, a small language the corpus' fences.
    """
    f = materialize(fences(sketches(measured)), "fences")
    group, lang, whole = (f.where(f"level = {i}").drop("level") for i in range(3))
    lang = lang.select(F.col("lang").alias("l1"), F.col("rate").alias("r1"), *[F.col(c).alias(f"{c}1") for c in ("rows", "low", "high")])
    whole = whole.select(F.col("rate").alias("r2"), *[F.col(c).alias(f"{c}2") for c in ("low", "high")])
    every = group.join(lang, F.expr("lang <=> l1 AND rate = r1")).join(whole, F.expr("rate = r2"))
    chosen = lambda c: F.when(F.col("rows") >= LEAST_ROWS, F.col(c)).when(
        F.col("rows1") >= LEAST_ROWS, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    return every.select("lang", "source", "rate", chosen("low").alias("low"), chosen("high").alias("high")).groupBy(
        "lang", "source").agg(*[F.max(F.when(F.col("rate") == n, F.col(side))).alias(f"{n}_{side}")
                                for n in RATES for side in ("low", "high")]).withColumns(
        {"least_words": F.lit(LEAST_WORDS), "most_repeated": F.lit(MOST_REPEATED_PERCENT)})


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed__`` and ``kept__`` by the ``limits`` of ``thresholds``.

    NULL languages and sources are groups of their own; an empty table gives no rows. The thresholds are broadcast if
    counted small, else joined by group.
    """
    limits = small_side(limits).withColumnsRenamed({"lang": "lang__", "source": "source__"})
    inside = [F.expr(f"{_rate(n)} <= {n}_high" + f" AND {_rate(n)} >= {n}_low" * RATES[n][1]) for n in RATES]
    # the base rules come from the joined row too: as constants they would be pushed down and evaluated apart from the
    # measures that they share with the other rules
    failed = base_failed(f"coalesce(least_words, {LEAST_WORDS})", f"coalesce(most_repeated, {MOST_REPEATED_PERCENT})")
    kept = ~failed
    for rule in inside:
        kept = kept & F.coalesce(rule, F.lit(True))
    names = [f"{n}_{side}" for n in RATES for side in ("low", "high")]
    return measured.join(limits, F.expr("lang <=> lang__ AND source <=> source__"), "left").withColumns(
        {"base_failed__": failed, "kept__": kept}).drop("lang__", "source__", "least_words", "most_repeated", *names)


def _measures(docs: DataFrame) -> DataFrame:
    """What the rules need to know of each row, without its text, as a written table."""
    return materialize(measure(docs.select("doc_id", "text", "lang", "source")).drop("text"), "measures")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every row. NULL and empty texts measure zero and fail the base rules; repeated rows stay."""
    measured = _measures(docs)
    judged = judge(measured, materialize(thresholds(measured), "thresholds"))
    return judged.select("doc_id", "lang", "source", "measures__.*", F.col("base_failed__").alias("base_failed"),
                         F.col("kept__").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns, whatever the names of those that no rule reads.

    Texts are measured twice, for the thresholds and for the verdicts: that costs less than to write or shuffle them.
    """
    rows = set_aside(docs)
    limits = materialize(thresholds(_measures(rows)), "thresholds")
    return give_back(judge(measure(rows), limits).where("kept__"), docs)


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS rid,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM w, unnest(range(1, len(words) - 1)) u(i)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, unnest(range(3)) v(k) GROUP BY rid),
m AS (
  SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words END AS a1, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words END AS a2,
         CASE WHEN n_words > 0 THEN n_dup_lines * 1000 // greatest(n_lines, 1) END AS a3, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words END AS a4
  FROM b),
k AS (
  SELECT lang, source, rate, x, greatest(length(bin(x)) - 7, 0) AS s FROM (
    SELECT lang, source, u.rate, u.x FROM v,
      unnest([{'rate': 1, 'x': a1}, {'rate': 2, 'x': a2}, {'rate': 3, 'x': a3}, {'rate': 4, 'x': a4}]) t(u) WHERE NOT base_failed)),
t(rate, start, spreads, least_spread) AS (VALUES (1, 75, 8, 100), (2, 75, 2, 10), (3, 99, 10, 10), (4, 99, 20, 3)),
l AS (
  SELECT 0 AS level, lang, source, rate, ((x >> s) << s)::BIGINT AS value FROM k UNION ALL
  SELECT 1, lang, NULL, rate, ((x >> s) << s)::BIGINT FROM k UNION ALL SELECT 2, NULL, NULL, rate, ((x >> s) << s)::BIGINT FROM k),
q AS (
  SELECT level, lang, source, rate, count(*) AS n, list_sort(list(value)) AS o FROM l GROUP BY ALL),
p AS (
  SELECT *, (n * 50 + 99) // 100 AS r50, (n * 5 + 99) // 100 AS r5, (n * 95 + 99) // 100 AS r95, o[(n * 50 + 99) // 100] AS med FROM q),
e AS (
  SELECT *, list_sum(list_transform(o[r50:r95], lambda y: y - med)) // n AS above,
         list_sum(list_transform(o[r5:r50], lambda y: med - y)) // n AS below FROM p),
f AS (
  SELECT level, lang, source, e.rate, n, o[(n * (100 - start) + 99) // 100] - spreads * greatest(below, least_spread) AS low,
         o[(n * start + 99) // 100] + spreads * greatest(above, least_spread) AS high FROM e JOIN t USING (rate)),
h AS (
  SELECT f0.lang, f0.source, f0.rate,
         CASE WHEN f0.n >= 100 THEN f0.low WHEN f1.n >= 100 THEN f1.low ELSE f2.low END AS low,
         CASE WHEN f0.n >= 100 THEN f0.high WHEN f1.n >= 100 THEN f1.high ELSE f2.high END AS high
  FROM f f0 JOIN f f1 ON f0.level = 0 AND f1.level = 1 AND f0.lang IS NOT DISTINCT FROM f1.lang AND f0.rate = f1.rate
  JOIN f f2 ON f2.level = 2 AND f0.rate = f2.rate),
o AS (
  SELECT lang, source, max(low) FILTER (rate = 1) AS low1, max(high) FILTER (rate = 1) AS high1, max(high) FILTER (rate = 2) AS high2,
         max(high) FILTER (rate = 3) AS high3, max(high) FILTER (rate = 4) AS high4 FROM h GROUP BY ALL)
SELECT v.doc_id, v.lang, v.source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(a1 BETWEEN low1 AND high1, true) AND coalesce(a2 <= high2, true)
         AND coalesce(a3 <= high3, true) AND coalesce(a4 <= high4, true) AS kept
FROM v LEFT JOIN o ON v.lang IS NOT DISTINCT FROM o.lang AND v.source IS NOT DISTINCT FROM o.source
"""
