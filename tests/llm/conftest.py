from __future__ import annotations

import random

import pytest
from llm_texts import sentence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or longer tuples."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or "")) if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, no letter, very long, non-ASCII, control characters, repeated."""
    rng = random.Random(1)
    return [
        None,
        "",
        " \n\t ",
        "123 !!",
        sentence(rng, 40_000),
        "Ñandú çà ß 你好   x",
        "a\x00b \x1f c",
        "one two",
        "one two",
    ]
