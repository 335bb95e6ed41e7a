import pytest


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven", "en", "a", 1, "x"),
        (2, "one two three four five six seven", "en", "a", 1, "x"),
        (2, "one two three four five six seven", "en", "a", 1, "x"),
        (3, None, None, None, None, None),
        (4, "", "de", "b", 0, "y"),
        (5, " \n\t\n", "de", "b", 4, "y"),
        (6, long, "en", "a", len(long), "z"),
        (7, long + " tail", "fr", None, len(long), "z"),
        (None, "no id here", "en", "a", 10, "z"),
        (8, "x" * 5000, "en", "a", 5000, "z"),
        (9, "Ünïcödé ÀÉ text\nÜnïcödé ÀÉ text\nline", "es", "c", 30, "q"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


@pytest.fixture
def none(odd):
    return odd.limit(0)


@pytest.fixture
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
