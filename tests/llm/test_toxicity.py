from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, strategies as st

from driftwarden.llm import registry, toxicity
from tests.llm.conftest import ODD


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


@given(st.text("abc", min_size=1, max_size=11), st.lists(st.text("abc", min_size=1, max_size=11), min_size=1, max_size=6))
def test_automaton_finds_what_the_distance_finds(token, terms):
    edits = (len(token) >= toxicity.ONE_EDIT) + (len(token) >= toxicity.TWO_EDITS)
    expected = edits > 0 and any(distance(token, t) <= edits for t in terms)
    assert toxicity.Matcher(tuple(terms), ()).misspelled(token) == expected


def test_context_tells_quotation_from_abuse():
    matcher = toxicity.Matcher(("idiot",), ("scumb",))
    named = lambda text: dict(zip(toxicity.FEATURES, toxicity.features(text, matcher)))
    assert named("you are an idiot")["plain"] > 0 and named("you are an idiot")["aimed"] > 0
    quoted = named('he heard "what an idiot" and left')
    assert quoted["quoted"] > 0 and quoted["plain"] == 0 and quoted["any"] == 0
    assert named("what an idi0t, scumbag")["misspelled"] > 0 and named("scumbags all")["stem"] > 0
    assert set(toxicity.features("nothing to see", matcher)) == {0.0} == set(toxicity.features(None, matcher))


def test_quotations_end_at_their_mark_a_line_end_or_a_bounded_length():
    matcher = toxicity.Matcher(("idiot",), ())
    named = lambda text: dict(zip(toxicity.FEATURES, toxicity.features(text, matcher)))
    far = " and so the day went on" * 20
    plain = ("Er rief „gut“ und ging" + far + " you idiot you idiot", '5" pipe.' + far + " you idiot", 'a 5" pipe, you idiot',
             "„ohne Ende" + far + " du idiot", 'open "here\nyou idiot" there', "«rien»" + far + " tu idiot")
    for text in plain:
        assert named(text)["plain"] > 0 and named(text)["quoted"] == 0, text
    for text in ("er rief „so ein idiot“ laut", "«quel idiot» et voilà", "»was für ein idiot« klang es", "“what an idiot” it was", 'a "real idiot" it was'):
        assert named(text)["quoted"] > 0 and named(text)["plain"] == 0, text


def plain_quoted(text):
    """Quotations by trying every pair of marks from the left."""
    tokens, lines = [], []
    for number, line in enumerate(__import__("re").split(r"[\n\r]", text.lower())):
        found = toxicity.TOKEN.findall(line)
        tokens += found
        lines += [number] * len(found)
    inside, i = set(), 0
    while i < len(tokens):
        ends = [j for j in range(i + 1, min(len(tokens), i + toxicity.QUOTED + 2)) if lines[j] == lines[i]
                and tokens[i] in toxicity.CLOSERS and tokens[j] in toxicity.CLOSERS[tokens[i]]]
        if ends:
            inside.update(range(i + 1, ends[0]))
            i = ends[0]
        i += 1
    return inside


@given(st.lists(st.sampled_from(["a", "b", "w " * 25, '"', "«", "»", "“", "”", "„", "‹", "\n"]), max_size=40))
def test_quotations_by_brute_force(parts):
    text = " ".join(parts)
    assert toxicity.quoted_tokens(text) == plain_quoted(text)


def test_long_terms_are_learned_and_matched_whole(spark, documents):
    term = "schimpf" * 9 + "wort"  # 67 letters
    rows = [(i, f"an ordinary sentence number {i} about nothing" + f" {term}" * (i % 4 == 0)) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    train = toxicity.training_rows(documents(*rows), labels)
    assert toxicity.learn_lexicon(train)[0] == [term]
    scored = toxicity.toxicity(documents(*rows, (999, f"a {term[:-1]}x here")), labels).collect()
    assert all(r.predicted == (r.doc_id == 999 or r.doc_id % 4 == 0) for r in scored)


def test_query_level_contexts_by_brute_force(spark, documents):
    terms, stems = ["grobnix", "snarvile"], ["plodw"]
    matcher, draw = toxicity.Matcher(tuple(terms), tuple(stems)), random.Random(4)
    pool = ["grobnix", "grobnlx", "snarvile", "plodwit", "you", "said", "calm", "day", "sun", '"', "„", "“", "\n", "word"]
    rows = [(i, " ".join(draw.choices(pool, k=draw.randint(0, 60)))) for i in range(150)]

    def kinds(text):
        tokens, inside, found = toxicity.TOKEN.findall(text.lower()), plain_quoted(text), Counter()
        for i, t in enumerate(tokens):
            kind = "exact" if t in terms else "stem" if t.startswith("plodw") else "misspelled" if len(t) >= 5 and any(
                distance(t, x) <= 1 + (len(t) >= 9) for x in terms) else None
            if kind:
                near = {tokens[j] for j in range(max(0, i - 6), min(len(tokens), i + 7)) if j != i}
                if i in inside or near & toxicity.REPORTING:
                    found["quoted"] += 1
                else:
                    found.update(["plain", kind] + ["aimed"] * bool(near & toxicity.ADDRESS))
        share = min(1.0, 20 * found["plain"] / len(tokens)) if tokens else 0.0
        return [*(np.log1p(found[k]) for k in toxicity.FEATURES[:5]), float(found["plain"] > 0), share]

    found = toxicity.with_features(documents(*rows).select("doc_id", "text"), terms, stems).collect()
    assert len(found) == 150 and all(np.allclose(r.features, kinds(rows[r.doc_id][1])) for r in found)
    assert matcher["grobnlx"] == "misspelled"


def corpus(n):
    draw, plain = random.Random(3), [a + b + c for a in ("an", "el", "or", "ti") for b in ("da", "ne", "su", "mo") for c in ("re", "st", "lly")]
    rows, labels = [], []
    for i in range(n):
        words, bad = draw.choices(plain, k=draw.randint(20, 60)), i % 8 == 0
        if bad:
            words[draw.randrange(len(words))] = draw.choice(["grobnix", "snarvile", "plodwit"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark, documents):
    rows, labels = corpus(800)
    labels = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    extra = [(9000, "an elnest grobnixx and nothing else of note"), *ODD]
    scored = toxicity.toxicity(documents(*rows, *extra), labels).collect()
    assert len(scored) == len(rows) + len(extra)
    for r in scored:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in scored if r.held_out and r.doc_id is not None and 8 < r.doc_id < 800]
    assert held and all(r.predicted == (r.doc_id % 8 == 0) for r in held)
    assert {r.predicted for r in scored if r.doc_id == 9000} == {1}


def test_without_labels_or_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(documents(*ODD), none).collect()} == {0.0}
    assert toxicity.toxicity(documents(*ODD).limit(0), none).count() == 0


def test_query_scores_every_document(spark, sf_dir, sample):
    rows = registry.op4_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(sample)
