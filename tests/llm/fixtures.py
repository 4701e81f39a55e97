"""Tables shared by the tests of the training-data operators."""

import os

import pytest

DATA = os.environ.get("TABLEGAUGE_TESTDATA", "/root/testdata/sf0.001")
LONG = " ".join(f"word{i} and" for i in range(20_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "b", 7), (1, "Alpha beta gamma delta epsilon zeta", "b", 7),
        (2, None, "a", None), (3, "", None, 1), (4, " \t\n ", "a", 1), (5, "one", "", 1), (6, "one two", "a", 2),
        (7, "ALPHA beta gamma delta epsilon zeta", "b", 3), (None, "no id here at all", None, 4),
        (None, "Alpha beta gamma delta epsilon zeta", "c", 4), (8, LONG, "b", 1), (9, "Füße ÀÉ x　y 漢字 😀 😀\nzwei", "d", 2),
        (1, "other text under a used id", "b", 9),
    ]
    schema = "doc_id long, text string, source string, size long"
    df = spark.createDataFrame(rows, schema).selectExpr(
        "doc_id", "text", "source", "size", "'x' AS n_words", "'y' AS words", "1 AS row", "2 AS print", "3 AS item", "4 AS copies")
    return df.repartition(3)
