import re

import pytest
from pyspark.sql import functions as F

LONG = "word " * 60_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and further columns with odd names."""
    rows = [
        (1, "one two three four five six seven eight nine ten eleven a@b.co", "s", "x"),
        (2, "one two three four five six seven eight nine ten eleven a@b.co", None, "x"),
        (2, "one two three four five six seven eight nine ten eleven a@b.co", None, "x"),
        (3, None, "s", None),
        (4, "", "s", "x"),
        (None, "no id here", "t", "x"),
        (5, LONG, "t", "x"),
        (6, " \n\t\n ", None, "x"),
        (7, "Short", "t", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string").withColumn("root", F.lit(1)).withColumn("node", F.lit("n"))


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
