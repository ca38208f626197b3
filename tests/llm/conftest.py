import pytest

LONG = "word%d "


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a clashing column name."""
    base = " ".join(f"w{k}" for k in range(80))
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 2), (2, base, "en", "a", 2), (3, None, "en", "a", 3), (4, "", None, None, None), (5, "  \n ", "en", "b", 5), (None, base + " tail", "en", "b", 6),
        (7, " ".join(f"v{k}" for k in range(60_000)), "de", None, 7), (8, "x", "en", "c", 8), (9, "été 日本 🙂\x00\x1c", "fr", "c", 9), (10, base + " other", "en", "b", 10), (None, None, None, None, None), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
