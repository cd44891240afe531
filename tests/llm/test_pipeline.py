from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftwarden.llm import mixing, quality, simhash, substring
from driftwarden.session import materialize
from tests.llm.conftest import ODD
from tests.llm.test_packing import check_places
from tests.llm.test_substring import plain


def through(spark, docs, until=None):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], None), name))
    return out


def test_stages_on_the_smallest_tables(spark, sf_dir):
    raw, good, single, cut, mixed, packed = through(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert all(x.columns == raw.columns for x in (good, single, cut, mixed))
    texts = [{r.doc_id: r.text for r in x.collect()} for x in (good, single, cut)]
    assert 0 < len(texts[1]) <= len(set(texts[0].values())) and texts[1].items() <= texts[0].items()
    _, kept = plain(texts[1], 50)
    assert {i: t.encode().split() for i, t in texts[2].items()} == {i: w for i, w in kept.items() if w}
    assert {r.doc_id for r in mixed.collect()} <= texts[2].keys()
    check_places(packed.collect(), 2048)
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_planted_cases(spark, documents):
    clean = {i: " ".join(f"d{i}x{(k * 7) % 211}" for k in range(120)) for i in range(10, 50)}
    words = clean[13].split()
    passage = " ".join(f"p17x{k}" for k in range(100, 160))
    rows = list(clean.items()) + [(100, clean[15]), (101, " ".join([*words[:60], "other", *words[61:]])),
                                  (200, clean[17].replace("d17", "e17") + " " + passage), (201, passage + " " + clean[18].replace("d18", "e18")),
                                  (300, "### %%% " * 60), *ODD]
    docs = documents(*rows)
    _, good, single, cut, _, _ = through(spark, docs)
    ids = [{r.doc_id for r in x.collect()} for x in (good, single)]
    assert clean.keys() | {100, 101, 200, 201} == ids[0] - {7}
    assert ids[1] - {7} == clean.keys() | {200, 201}
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert passage in texts[200] and "p17x100" not in texts[201] and all(texts[i] == t for i, t in clean.items())


def test_empty_table(spark, documents):
    assert through(spark, documents(*ODD).limit(0))[-1].count() == 0


@pytest.mark.parametrize("stage", [
    quality.keep_good, lambda d: simhash.keep_one(d, **simhash.SIMILAR), substring.without_repeats, mixing.mixed_documents])
def test_further_columns_may_have_any_name(documents, stage):
    names = ["words__", "measures__", "kept__", "symbols_high", "id__", "key__", "rn__", "copy__", "rows__", "taken__", "source__", "root",
             "text_key", "ranges", "own", "lines__", "aside_0__", "a.b"]
    docs = documents(*[(i, " ".join(f"word{(i * 31 + k * (i + 1)) % 997}" for k in range(60)), "en", "s") for i in range(12)])
    docs = docs.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])
    out = stage(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(range(12))
    assert all(r[n] == f"mine {n}" for r in rows for n in names) and all(r["rank"] == 7 for r in rows)
