import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, node long, key string, ids string, block int"


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randint(0, vocabulary) ** 2 % 997}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash with results."""
    rnd = random.Random(3)
    base = words(rnd, 120)
    texts = [None, "", "  \n\t ", "one two", "one two", " ".join(words(rnd, 20000)), " ".join(base), " ".join(base), " ".join(base[:-1]), "Ünïcödé sätze\nmit zeilen\n\nund mehr", "x" * 5000, "a\r\nb\x0b c"]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2"][i % 3], None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], rows[1]]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r for r in docs.collect()}
