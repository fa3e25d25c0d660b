"""Rows that the tests of this folder share."""

from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 140))) for _ in range(6)]
    long_text = "\n".join(" ".join(rng.choices(vocabulary, k=40)) for _ in range(300))
    return [
        (1, prose[0], "en", "a", 1),
        (2, prose[0], "en", "a", 1),
        (2, prose[0], "en", "a", 1),
        (3, None, "en", "b", 0),
        (4, "", None, "b", 0),
        (5, " \t\n\x0b ", "en", None, None),
        (None, prose[1], None, None, None),
        (None, prose[2] + " ünïcödé 日本語 🙂 e\u0301", "de", "c", 3),
        (6, long_text, "en", "a", 9),
        (7, prose[3] + "\n" + prose[3], "fr", "c", 2),
        (8, "x" * 5000, "en", "b", 5000),
        (9, "one two", "en", "d", 7),
        (10, "ab ab ab ab ab ab " * 20, "en", "d", 7),
        (11, prose[4] + "\u2028" + prose[5], "en", "d", 7),
    ]


@pytest.fixture
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
