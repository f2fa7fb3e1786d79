import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing names."""
    long = "alpha beta gamma delta " * 30_000
    rows = [
        (1, None, None, 1), (None, "", "x", None), (2, "   \n\t ", "y", 2), (3, long, "z", 3), (3, long, "z", 3),
        (4, "!!! ... ???", None, 4), (5, "one", "a", 5), (None, None, None, None), (6, "\u0000 a \U0001F600 b \uFDD0 c", "e", 6),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, score long")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.filter("false")
