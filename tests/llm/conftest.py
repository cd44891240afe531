from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, size string"


@pytest.fixture
def documents(spark):
    """Rows ``(doc_id, text[, lang, source])`` as documents with two extra columns whose names operators use inside."""
    def make(*rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or ""), 7, "x") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def sample(spark, sf_dir):
    """The documents of the smallest test tables, as rows by doc_id."""
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


#: Nulls in every column, empty and blank texts, a long text, repeated rows.
ODD = [(None, None, None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "A b c d e f"), (6, "a B c d e f"),
       (7, "long " * 30_000), (None, "text without an id", None, "s"), (8, "é ü 😀 \x0b ß", "fr", None)]
