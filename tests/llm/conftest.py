import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that every operator must stand: nulls, empty and long texts, repeated rows, and
    columns named like those that operators use themselves."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, "a", "en"), (2, "", "a", None), (3, "x", None, "en"), (4, long, "b", "en"),
            (4, long, "b", "en"), (None, "no id here", "b", "en"), (5, "\n \t", "c", "en"),
            (6, "日本語 ünï \U0001f642", "c", "fr"), (7, "x", None, "en")]
    rows = [(*r, 0, 0, "k", 1.5, "r", "t", [1]) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, "
                                       "id int, n int, key string, size double, row string, "
                                       "bucket string, bands array<int>")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
