import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, white and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))
    prose = "the quick brown fox jumps over the lazy dog while seven other animals watch it from behind the old stone wall near the river. " * 2
    rows = [
        (1, prose, "en", "a", 1), (2, prose.replace(" ", "  "), "en", "b", 1), (2, prose.replace(" ", "  "), "en", "b", 1), (None, prose, None, None, None),
        (3, None, None, "a", None), (4, "", "en", None, 0), (5, " \t\n", "de", "a", 3), (6, long, "en", "a", len(long)), (7, "x", "fr", "a", 1),
        (7, "y", "fr", "a", 1), (None, None, None, None, None), (-8, "Ünïcödé 𝒳 日本語 " * 9, "de", "c", 5),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
