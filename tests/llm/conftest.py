from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

BASE = " ".join(f"w{i}" for i in range(60))
#: Nulls, an empty and a blank text, exact and near copies, few words, a very long text.
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE.replace("w59", "zz"), "en", "b", 1), (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \n\t ", "fr", "b", 3), (7, "one two", "en", None, 7),
    (8, "ONE two", "de", "b", 7), (9, " ".join(f"q{i % 977}" for i in range(30000)), "en", "a", 9), (10, "é ñ ß 漢字 " * 12, "fr", "b", 5), (11, BASE.upper(), "en", "a", 1), (12, " ".join(f"w{i}" for i in range(0, 60, 2)), "en", "c", 1),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture
def clashing(docs):
    """The same documents with columns named like what operators add."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("n", "digest", "score", "grams", "start", "win", "lang_pred", "p", "topic", "w", "tokens", "label", "held_out", "unit", "term")})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
