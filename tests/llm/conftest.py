import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, size double, fingerprint int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and ids, and columns with names of results."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "b", 59, "x", 1.0, 1),
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "b", 59, "x", 1.0, 1),
        (2, "THE quick brown fox jumps over the lazy dog again and again", "en", None, 59, None, None, None),
        (3, None, None, "a", None, "y", 2.0, 2),
        (4, "", "de", "a", 0, "y", 2.0, 2),
        (5, " \t\n\x0b\f\r ", "de", "", 7, "y", 2.0, 2),
        (None, "ohne Nummer password=abc123def456ghi", "de", "c", 36, "z", 3.0, 3),
        (None, None, None, None, None, None, None, None),
        (7, "wort " * 30_000, "de", "a", 150_000, "z", 3.0, 3),
        (8, "x" * 60_000, "en", "é", 60_000, "z", 3.0, 3),
        (9, "12 34 !!     \U0001f600", "es", "\U0001f600", 12, "z", 3.0, 3),
        (-5, "der die das", "de", "b", 11, "z", 3.0, 3),
    ]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/labels.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
