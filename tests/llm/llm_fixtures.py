from __future__ import annotations

import random

import pytest

DOC = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
WORDS = {
    "en": "the of and this with from tion ing house river green slowly water people under over again never always".split(),
    "de": "der die und nicht ist mit auf keit ung haus fluss gruen langsam wasser leute unter immer wieder nie schoen".split(),
}


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    long = " ".join(rng.choice(WORDS["en"]) + str(rng.randint(0, 99)) for _ in range(60_000))
    base = "the quick brown fox jumps over the lazy dog while the river runs slowly under the old green bridge"
    return [
        (1, None, "en", "s", None), (2, "", None, None, 0), (3, "   \n\t ", "en", "s", 5), (4, "12345 !!! ???", "en", "s", 13),
        (5, base, "en", "s", 1), (6, base, "en", "s", 1), (6, base, "en", "s", 1), (7, base.replace(" ", "  "), "en", "t", 1),
        (8, base.upper(), None, "s", 1), (9, long, "en", "s", 1), (10, long, "en", "s", 1), (None, base, "en", "s", 1),
        (None, "a text of its own without an id and more words", None, None, None), (11, "é中文😀 ▁x <s> <0x0A>\r\n\x00", "fr", "s", 1),
        (12, "one", "en", "s", 3), (13, "x" * 5000, "en", "s", 1), (14, "der fluss und das wasser ist nicht gruen", "de", "s", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
