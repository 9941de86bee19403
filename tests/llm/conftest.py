import random

import pytest

ROWS = [
    (5, "The cat sat on the mat and looked at the dog that ran by", "en", "a", 1),
    (3, "the CAT sat on the mat and looked at the dog that ran by", "en", "a", 1),
    (9, None, None, None, None),
    (None, "no id here", "en", None, 1),
    (1, "", "en", "b", 0),
    (7, "The cat sat on the mat and looked at the dog that ran by", "en", "b", 1),
    (7, "The cat sat on the mat and looked at the dog that ran by", "en", "b", 1),
    (11, "é漢字 🙂 İstanbul\x1cx\x00y  two   spaces\n\nlines\t", "de", "c", 2),
    (12, "word " * 3000, "en", "c", 3),
    (13, "x" * 20000, "en", "c", 3),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, copies, repeated rows, empty, odd and long texts, and columns with clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for name in ("n", "part", "hash", "ids", "keep_id", "line", "u", "score", "piece", "length"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture()
def rng():
    return random.Random(7)
