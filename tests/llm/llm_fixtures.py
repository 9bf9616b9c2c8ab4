"""Inputs that the operator tests share."""

import pytest

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, kind int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and extra
    columns whose names the operators use inside."""
    passage = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"{'abcdefgh'[i % 8]}{i % 997}" for i in range(30_000))
    rows = [
        (1, passage, "en", "a", 10, "x", 1), (2, passage, "en", "a", 10, "x", 1), (2, passage, "en", "a", 10, "x", 1),
        (3, None, "en", "a", None, None, None), (4, "", None, None, 0, "", 0), (5, " \n\t ", "de", "b", 4, "y", 2),
        (None, passage + " more", "en", None, 1, "z", 3), (None, None, None, None, None, None, None),
        (6, "one two", "de", "b", 7, "y", 2), (7, "ONE two", "de", "b", 7, "y", 2), (8, long, "en", "b", 9, "y", 2),
        (9, long + " end", "en", "c", 9, "y", 2), (10, "x" * 30_000, "fr", "c", 30_000, "y", 2),
        (11, "日本語のテキスト 123 !!", "ja", "c", 5, "y", 2), (12, "12 34 %% 56", "en", "c", 5, "y", 2),
        (13, "<|endoftext|> \\b <|im_end|>", "en", "c", 5, "y", 2), (14, "a\x1cb c d", "en", "c", 5, "y", 2),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
