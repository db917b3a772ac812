import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Null, empty, blank and long texts, repeated rows and a column with a clashing name."""
    rows = [(1, None, "x"), (2, "", None), (3, "  \n\t ", "x"), (4, "word " * 30_000, "x"), (5, "one two three four five six seven eight nine ten eleven", "x"), (5, "one two three four five six seven eight nine ten eleven", "x"), (None, "lonely text", None), (7, "é 中文 😀 ▁ x y", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'src0' AS source", "cast(length(text) AS long) AS n_chars", "1 AS fp", "2 AS block", "3 AS n_words")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
