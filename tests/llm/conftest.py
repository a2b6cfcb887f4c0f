import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts(spark):
    """doc_id -> text of the smallest documents table."""
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def awkward(spark):
    """Null columns, empty and repeated texts, ties, clashing extra columns."""
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t", "en", "a"), (4, "one two", "en", "a"),
            (5, "one two", "en", "b"), (5, "one two", "en", "b"), (6, "A" * 30000, "de", "a"),
            (7, "x y z " * 4000, "fr", "a"), (None, "no id here, but a text of some words", "en", "a"),
            (8, "\U0001F600 ́ë ß 123 ...", "es", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F
    return df.selectExpr("*", "length(text) n_chars", "1 component_id", "'k' kept", "2 length", "3 score", "4 node")


@pytest.fixture()
def odd(spark):
    return awkward(spark)


@pytest.fixture()
def empty(spark):
    return awkward(spark).limit(0)
