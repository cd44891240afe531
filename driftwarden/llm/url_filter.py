"""URL filtering with a Bloom filter cascade, built and probed with built-in functions only.

The first level holds the listed keys. Probing it with every key of the corpus gives its false positives, which the
second level holds; the listed keys that the second level takes for them go to the third, and so on until a level has
no false positive. A key of the corpus is listed if the first level that does not hold it has an even number, so
membership is exact for the whole key universe and no list is joined to the pages.

A level is an array of 64-bit words. Up to ``MOST_BITS`` bits in all levels together, the arrays are values inside the
expression (scalar subqueries). Beyond that, keys are dealt to segments by hash, each with a cascade of bounded size, and
pages meet the cascade of their segment.

The first level has as many hash functions as it takes to let no more keys of the universe pass than are listed, so
the second level, and all that follow, are no larger than the first, however large the universe is beside the list.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from driftwarden.llm.common import LOWER, UPPER, materialize, set_aside

#: Fixed values: (rule, verdict) where a rule is a host and the start of a path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: Hash functions of a level, at least, and bits per key for each of them; a level lets ``PASSED ** hashes`` of other keys pass,
#: with four functions about 2 %.
HASHES, BITS_PER_HASH = 4, 2
PASSED = 1 - math.exp(-1 / BITS_PER_HASH)
#: Bits that a cascade may have as a value in the plan (8 MB); also about the size of a segment beyond that.
MOST_BITS = 1 << 26
MOST_LEVELS = 40


class Cascade(NamedTuple):
    """``table (segment, levels array<struct<bits, words>>)``, its segments and levels, and the hash functions of the first level."""

    table: DataFrame
    segments: int
    depth: int
    hashes: int = HASHES


def with_host_path(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path`` of their url; both empty for NULL or a url without ``://``."""
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return pages.withColumns({
        "host": F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")),
        "path": F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))})


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct of the longest fitting rule and its verdict, or NULL; of equally long rules the longer host wins.

    Rules are a short list given by the caller, so they are tried in order of length inside one expression.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    order = sorted(rules, key=lambda r: (len(r[0]), r[0].index("/")))
    for rule, verdict in order:  # later (longer) rules are wrapped around earlier ones
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def first_hashes(listed: int, others: int) -> int:
    """Hash functions with which about as many of the ``others`` pass the first level as keys are ``listed``, or fewer."""
    return max(HASHES, math.ceil(math.log(max(listed, 1) / max(others, 1)) / math.log(PASSED)))


def _positions(key: str, level: int, bits: Column, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(1000 * level + i), F.col(key)), bits) for i in range(hashes)]


def _held(key: str, level: int, words: Column, bits: Column, hashes: int) -> Column:
    """Whether a level, an array of words, may hold the key."""
    held = F.lit(True)
    for p in _positions(key, level, bits, hashes):
        held = held & (F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0)
    return held


def _level(keys: DataFrame, level: int, sizes: DataFrame, hashes: int) -> DataFrame:
    """``(segment, bits, words)`` of a level over ``keys (segment, key)``; every segment of ``sizes`` has a row."""
    spots = keys.join(F.broadcast(sizes), "segment").select("segment", "bits", F.explode(
        F.array(*_positions("key", level, F.col("bits"), hashes))).alias("p"))
    words = spots.groupBy("segment", "bits", F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("word"))
    rows = words.groupBy("segment", "bits").agg(F.array_sort(F.collect_list(F.struct("w", "word"))).alias("a"))
    # the words in order, with zeros where no key has set a bit
    blanks = F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("bits") - 1, 6))
    missing = F.transform(F.array_except(blanks, F.transform("a", lambda x: x["w"])), lambda w: F.struct(w.alias("w"), F.lit(0).cast("long").alias("word")))
    return rows.select("segment", "bits", F.transform(F.array_sort(F.concat("a", missing)), lambda x: x["word"]).alias("words"))


def build_cascade(listed: DataFrame, universe: DataFrame, most_bits: int = MOST_BITS) -> Cascade:
    """The cascade of ``listed (key)`` over ``universe (key)``; no level of a segment has more than about half of ``most_bits``.

    Both are taken as sets; NULL keys are dropped; listed keys outside the universe are held as well. No listed keys give
    a cascade of no levels, which lists nothing.
    """
    listed = materialize(listed.where("key IS NOT NULL").select("key").distinct(), "listed")
    n = listed.count()
    unlisted = materialize(universe.where("key IS NOT NULL").select("key").distinct().join(listed, "key", "left_anti"), "unlisted")
    hashes = first_hashes(n, unlisted.count())
    segments = max(1, -(-2 * n * hashes * BITS_PER_HASH // most_bits))
    dealt = F.pmod(F.xxhash64(F.lit(-1), "key"), F.lit(segments)).alias("segment")
    inside = listed.select(dealt, "key")
    levels, held, out = [], inside, unlisted.select(dealt, "key")
    while n:
        if len(levels) == MOST_LEVELS:
            raise RuntimeError(f"no exact cascade after {MOST_LEVELS} levels")
        own = hashes if not levels else HASHES
        sizes = held.groupBy("segment").agg((F.ceil(F.count("*") * own * BITS_PER_HASH / 64) * 64).cast("long").alias("bits"))
        level = materialize(_level(held, len(levels), sizes, own), f"level-{len(levels)}")
        passed = out.join(F.broadcast(level) if segments == 1 else level, "segment").where(
            _held("key", len(levels), F.col("words"), F.col("bits"), own)).select("segment", "key")
        levels.append(level)
        held, out = materialize(passed, "false-positives"), held
        n = held.count()
    if not levels:
        return Cascade(listed.select(F.lit(0).cast("long").alias("segment")).limit(0), segments, 0)
    cascade = levels[0].select("segment", F.struct("bits", "words").alias("l0"))
    for i, level in enumerate(levels[1:], 1):
        cascade = cascade.join(level.select("segment", F.struct("bits", "words").alias(f"l{i}")), "segment", "left")
    table = materialize(cascade.select("segment", F.array(*[f"l{i}" for i in range(len(levels))]).alias("levels")), "cascade")
    return Cascade(table, segments, len(levels), hashes)


def _listed(key: str, levels: Column, depth: int, hashes: int) -> Column:
    """Whether the first level that does not hold the key is an even one, counted from 1; a missing level holds nothing."""
    verdict = F.lit(depth % 2 == 1)
    for i in reversed(range(depth)):
        level = F.get(levels, i)
        held = F.coalesce(_held(key, i, level["words"], level["bits"], HASHES if i else hashes), F.lit(False))
        verdict = F.when(held, verdict).otherwise(F.lit(i % 2 == 1))
    return verdict


def with_membership(rows: DataFrame, key: str, cascade: Cascade, name: str = "listed") -> DataFrame:
    """``rows`` with a boolean column: whether ``key``, of the cascade's universe, is listed. A NULL key is not."""
    table, segments, depth, hashes = cascade
    if not depth:
        return rows.withColumn(name, F.lit(False))
    if segments == 1:
        levels = table.select("levels").scalar()
        return rows.withColumn("levels__", levels).withColumn(name, F.coalesce(_listed(key, F.col("levels__"), depth, hashes), F.lit(False))).drop("levels__")
    dealt = rows.withColumn("segment__", F.pmod(F.xxhash64(F.lit(-1), F.col(key)), F.lit(segments)))
    joined = dealt.join(table.select(F.col("segment").alias("segment__"), F.col("levels").alias("levels__")), "segment__", "left")
    return joined.withColumn(name, F.coalesce(_listed(key, F.col("levels__"), depth, hashes), F.lit(False))).drop("segment__", "levels__")


def address() -> Column:
    """Key of a page: host and path, without parameters and anchors."""
    return F.concat("host", "path")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``: the longest rule's verdict, else block if the address is ``listed (key)``.

    The key universe is every address of the pages. Urls without a host fit no rule and have the empty address. Columns of
    ``pages`` that have the names of these four are replaced, any other stays.
    """
    read = ("url", "host", "path", "rule", "verdict")
    parsed = with_host_path(set_aside(pages, read)).withColumn("address__", address())
    cascade = build_cascade(listed, parsed.select(F.col("address__").alias("key")))
    rows = with_membership(parsed, "address__", cascade, "listed__").withColumn(
        "rule__", longest_rule(F.col("host"), F.col("path"), rules))
    judged = rows.withColumns({
        "rule": F.col("rule__.rule"),
        "verdict": F.coalesce("rule__.verdict", F.when(F.col("listed__"), F.lit("block")).otherwise(F.lit("allow")))})
    own = pages.drop(*read[1:])
    return judged.select(*set_aside(pages, read).drop(*read[1:]).columns, *read[1:]).toDF(*own.columns, *read[1:])


def campaign_addresses(pages: DataFrame) -> DataFrame:
    """``(key)``: addresses that some page links with a campaign parameter; the list of the registered query."""
    return with_host_path(pages.where(F.contains(F.col("url"), F.lit("utm_")))).select(address().alias("key")).distinct()


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT host || path AS address FROM h WHERE contains(url, 'utm_')),
r(rule, name, start, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM h JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT h.page_id, h.host, h.path, f.rule,
       coalesce(f.verdict, CASE WHEN h.host || h.path IN (SELECT address FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN f USING (page_id)
"""
