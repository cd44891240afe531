from __future__ import annotations

import random
import re
from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from driftwarden.llm import quality
from tests.llm.conftest import ODD


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


def measured(df):
    return [tuple(r) for r in quality.measure(df).select("measures__.*").collect()]


def test_measures_of_odd_rows(documents):
    assert sorted(measured(documents(*ODD))) == sorted(plain_measures(r[1]) for r in ODD)


def test_measures_of_generated_texts(documents):
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.text(alphabet="ab \n\t#|é", max_size=80), min_size=1, max_size=20))
    def check(texts):
        rows = [(i, t) for i, t in enumerate(texts)]
        found = {r.doc_id: tuple(r.measures__) for r in quality.measure(documents(*rows)).collect()}
        assert found == {i: plain_measures(t) for i, t in rows}

    check()


def test_sketch_buckets(spark):
    values = [*range(300), 1000, 12_345, 10**9, 10**12]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    rows = df.select("v", quality.bucket_floor(quality.bucket(df["v"])).alias("f")).collect()
    assert all(r.f <= r.v < r.f * 65 / 64 + 1 for r in rows)
    assert all(r.f == r.v for r in rows if r.v < 128)


def good(i):
    return " ".join(f"word{(i * 31 + k) % 97}" for k in range(60))


def test_thresholds_follow_the_group(documents):
    rows = [(i, good(i), "en", "a") for i in range(120)] + [(i, good(i) + " |" * 30, "en", "b") for i in range(200, 320)]
    rows += [(900, good(5) + " |" * 30, "en", "a"), (901, "too short", "en", "a"), (902, good(7), None, None)]
    verdicts = {r.doc_id: r for r in quality.quality_verdicts(documents(*rows)).collect()}
    assert all(verdicts[i].kept for i in [*range(120), *range(200, 320), 902])  # tables are usual in source b
    assert not verdicts[900].kept and not verdicts[900].base_failed
    assert verdicts[901].base_failed and not verdicts[901].kept


def test_filter_keeps_columns_and_odd_rows_fail(documents):
    docs = documents(*ODD)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.quality_verdicts(docs).where("kept").count() == 0
    assert quality.quality_verdicts(docs.limit(0)).count() == 0


def plain_fences(values, start, spreads, least):
    """Fences of a sketch by sorting, with the sketch's rounding."""
    values = sorted(v if v < 128 else v >> v.bit_length() - 7 << v.bit_length() - 7 for v in values)
    n = len(values)
    at = lambda p: values[(n * p + 99) // 100 - 1]
    above = sum(v - at(50) for v in values[(n * 50 + 99) // 100:(n * (100 - quality.TRIM) + 99) // 100]) // n
    below = sum(at(50) - v for v in values[(n * quality.TRIM + 99) // 100 - 1:(n * 50 + 99) // 100]) // n
    return at(100 - start) - spreads * max(below, least), at(start) + spreads * max(above, least)


def test_fences_are_those_of_sorted_values(spark):
    draw = random.Random(11)
    groups = {s: [draw.choice((0, 0, draw.randint(1, 90), draw.randint(100, 9000))) for _ in range(draw.randint(1, 300))] for s in "abcd"}
    for rate, (_, two_sided, start, spreads, least) in quality.RATES.items():
        rows = spark.createDataFrame([(0, "en", s, rate, v) for s, values in groups.items() for v in values],
                                     "level int, lang string, source string, rate string, value long")
        sketch = rows.groupBy("level", "lang", "source", "rate", quality.bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))
        for r in quality.fences(sketch).collect():
            low, high = plain_fences(groups[r.source], start, spreads, least)
            assert (r.rows, r.low, r.high) == (len(groups[r.source]), low if two_sided else None, high)


def repetitive(i, share):
    """Sixty words of which about ``share`` lie in repeated three-word windows."""
    n = round(60 * share / 6)
    return " ".join(["red blue green"] * 2 * n + [f"w{(i * 31 + k) % 997}" for k in range(60 - 6 * n)])


def test_repeats_fail_in_a_clean_group_and_pass_in_a_repetitive_one(documents):
    rows = [(i, good(i), "en", "clean") for i in range(150)] + [(i, repetitive(i, 0.4), "en", "songs") for i in range(200, 350)]
    rows += [(900, repetitive(900, 0.4), "en", "clean")]
    verdicts = {r.doc_id: r for r in quality.quality_verdicts(documents(*rows)).collect()}
    assert not verdicts[900].base_failed and not verdicts[900].kept
    assert all(r.kept for i, r in verdicts.items() if i != 900)


def test_repeated_lines_are_measured_against_lines(documents):
    line = lambda i, k: " ".join(f"w{(i * 37 + k * 13 + j) % 997:03d}" for j in range(12))
    rows = [(i, "\n".join(line(i, k) for k in range(8)), "en", "a") for i in range(150)]
    half = "\n".join(line(500, k // 2) for k in range(16)).split("\n")
    rows += [(900, "\n".join(half[0:12:2] + half[0:1] * 3), "en", "a")]
    verdicts = {r.doc_id: r for r in quality.quality_verdicts(documents(*rows)).collect()}
    assert verdicts[900].n_dup_lines == 3 and not verdicts[900].kept
    assert all(r.kept for i, r in verdicts.items() if i != 900)


def test_long_texts_are_measured_in_pieces(documents, monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 7)
    monkeypatch.setattr(quality, "SORTED", 5)
    draw = random.Random(5)
    texts = ["".join(draw.choice(("a", "b", "é", "😀", " ", "  ", "\n", "\n\n", "\t", "|", "wordlongerthanapiece")) for _ in range(n))
             for n in (1, 6, 7, 8, 20, 60, 150, 400)] + ["\n" * 30, " " * 30, "x" * 50, "a b\n" * 12, "a b c\n\nd e f " * 5 + "\n"]
    found = {r.doc_id: tuple(r.measures__) for r in quality.measure(documents(*enumerate(texts))).collect()}
    assert found == {i: plain_measures(t) for i, t in enumerate(texts)}


def test_texts_without_words_beside_texts_that_pass(documents):
    rows = [(i, good(i), "en", "a") for i in range(120)] + [(900, None, "en", "a"), (901, "", "en", "a"), (902, " \n\t ", "en", "a"), (903, None, None, "a")]
    docs = documents(*rows)
    verdicts = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert len(verdicts) == 124 and {i for i, r in verdicts.items() if not r.kept} == {900, 901, 902, 903}
    assert all(verdicts[i].base_failed for i in (900, 901, 902, 903))
    assert quality.keep_good(docs).count() == 120
