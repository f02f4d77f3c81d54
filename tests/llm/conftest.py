"""Tables with everything that can go wrong in one."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, KEPT string, fingerprint int, _row string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here", "en", "s", 10), (None, None, None, None, None), (3, " \n\t\n ", "en", None, 5),
        (4, "word " * 60000, "en", "s", 300000), (5, "x" * 200000, "de", "s", 200000), (6, "Same text twice over", "en", "s", 20), (6, "Same text twice over", "en", "s", 20),
        (7, "Same text twice over", None, "t", 20), (8, "naïve Ünïcödé 漢字 😀 words\r\nline two\n\nline two", "fr", "s", 40), (9, "\x00\x01 ctl \x1f", "en", "s", 8),
    ]
    return spark.createDataFrame([(*r, 1, "k", 2, "r") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def table(df):
    return [r.asDict() for r in df.collect()]
