import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1), (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 2), (3, None, None, None, None),
        (4, "", "en", "b", 0), (5, "  \n\t ", "en", "b", 3), (6, long, "en", "c", None), (7, "Ünïcode – ☃ 中文 text ▁ with marks", "de", "a", 9), (8, "one", "fr", "a", 1), (8, "one", "fr", "a", 1),
        (9, "one two", "fr", "z", 1), (None, "one two", "fr", "z", 1), (10, "THE quick brown fox jumps over the lazy dog again and again", "en", "a", 1), (11, long + " tail", "en", "c", None),
        (12, "x" * 5000, "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'clash' as score", "1 as kept", "2 as slot", "3 as component_id", "'k' as h", "0 as copies")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, 1, 1), (7, 0, 1), (None, 1, 1), (8, None, None), (8, 1, 0), (8, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
