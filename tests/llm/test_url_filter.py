from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from driftwarden.llm import url_filter
from tests.oracle_compare import connect, differences
from driftwarden.llm import registry

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q=1", "https://example.com/en/", "https://example.com/en",
        "https://deep.www.example.com/en/a#b", "http://badexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://a.com", "http://a.com/",
        "http://a.com?x=/en/", "http://É.com/ü?utm_source=x", "http://É.com/ü", "ftp://a.org/p#utm_", "http://a.org/p://q/", "http://example.com/en/\nline"]


def plain(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = None
    for rule, verdict in url_filter.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return (host, path, *(best or (None, "block" if host + path in listed else "allow")))


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, 3) for i, u in enumerate([*URLS, URLS[5]])], "page_id long, url string, host_rank int")
    first = {u: plain(u, ()) for u in URLS}
    listed = {first[u][0] + first[u][1] for u in URLS if u and "utm_" in u}
    rows = url_filter.judge_urls(pages, url_filter.campaign_addresses(pages)).collect()
    assert len(rows) == len(URLS) + 1 and all(r.host_rank == 3 for r in rows)
    assert all((r.host, r.path, r.rule, r.verdict) == plain(r.url, listed) for r in rows)
    assert url_filter.judge_urls(pages.limit(0), url_filter.campaign_addresses(pages.limit(0))).count() == 0


def test_cascade_is_exact_with_and_without_segments(spark):
    draw = np.random.default_rng(6)
    keys = [f"key{i}" for i in range(6000)]
    listed = set(draw.choice(keys, 1500, replace=False).tolist())
    universe = spark.createDataFrame([(k,) for k in keys] + [(None,)] * 3 + [("key1",)], "key string")
    chosen = spark.createDataFrame([(k,) for k in listed] + [(None,)], "key string")
    for most_bits in (url_filter.MOST_BITS, 1 << 12):
        cascade = url_filter.build_cascade(chosen, universe, most_bits)
        assert cascade[2] > 2 and (cascade[1] == 1) == (most_bits == url_filter.MOST_BITS)
        rows = url_filter.with_membership(universe, "key", cascade).collect()
        assert len(rows) == 6004
        assert all(r.listed == (r.key in listed) for r in rows)


def test_levels_are_bounded_where_the_universe_is_far_larger_than_the_list(spark):
    universe = spark.range(1_000_000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.where("xxhash64(key) % 500 = 0")
    n, most = listed.count(), 1 << 14
    cascade = url_filter.build_cascade(listed, universe, most)
    sizes = cascade.table.select("segment", F.posexplode(F.transform("levels", lambda x: x["bits"]))).where("col IS NOT NULL").collect()
    assert 1500 < n < 2500 and cascade.segments > 1 and max(r.col for r in sizes) <= most
    total = lambda level: sum(r.col for r in sizes if r.pos == level)
    assert all(total(i) <= total(0) for i in range(1, cascade.depth))
    rows = url_filter.with_membership(universe, "key", cascade)
    assert rows.where("listed <> (xxhash64(key) % 500 = 0)").count() == 0 and rows.where("listed").count() == n


def test_extra_columns_stay_and_verdict_columns_are_replaced(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/1", "x", "y", "z")], "page_id long, url string, address__ string, listed__ string, rule string")
    row = url_filter.judge_urls(pages, url_filter.campaign_addresses(pages)).first().asDict()
    assert row == {"page_id": 1, "url": "http://a.net/es/1", "address__": "x", "listed__": "y", "host": "a.net", "path": "/es/1",
                   "rule": "net/es/", "verdict": "block"}


def test_empty_list(spark):
    universe = spark.createDataFrame([("a",), ("b",)], "key string")
    cascade = url_filter.build_cascade(universe.limit(0), universe)
    assert not any(r.listed for r in url_filter.with_membership(universe, "key", cascade).collect())


def test_query_on_the_smallest_tables(spark, sf_dir):
    assert differences(registry.op8_filter_urls(spark, sf_dir), connect(sf_dir), url_filter.ORACLE_SQL) == []
