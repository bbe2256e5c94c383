import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def real(spark):
    """The documents of the smallest tables, and as plain rows."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [r.asDict() for r in df.collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows and ids, and a further column
    whose name the operators use themselves."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "one two three four five six\nseven eight nine ten eleven", "en", "a", 1, "x"),
        (1, "one two three four five six\nseven eight nine ten eleven", "en", "a", 1, "x"),
        (2, None, "en", "a", None, None),
        (3, "", None, "b", 0, "x"),
        (4, " \n\t\n ", "de", None, 5, "x"),
        (None, "no id here at all but some words in it", "en", "c", 3, "x"),
        (5, long, "en", "a", len(long), "x"),
        (6, long + " tail", "en", "b", len(long), "x"),
        (7, "a@b.cd +1 (212) 555-0123 4111 1111 1111 1111 10.0.0.1 é 😀 it's 12", "fr", "d", 9, "x"),
        (8, "a b", "fr", "d", 3, "x"),
        (9, "a  b", "fr", "e", 4, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, node string"), rows
