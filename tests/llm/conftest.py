import pytest

#: Columns whose names the operators use themselves.
CLASHING = {"h": 1, "key": 2, "n_words": 3, "taken": 4, "size": 5, "fp": 6, "score": 0.5, "cell": 7, "word": "w", "is_row": 1, "group": "g", "copies": 9}


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls in any column, empty, blank and long texts, ties, repeats and clashing columns."""
    long = " ".join(f"word{i % 997} the" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (3, None, "en", "a"),
        (4, "", "fr", "b"),
        (5, " \n\t ", None, None),
        (6, long, "en", "c"),
        (7, "Ein schöner Tag für die Straße, größer als je", "de", None),
        (7, "Ein schöner Tag für die Straße, größer als je", "de", None),
        (None, "no id at all", None, "b"),
        (None, None, None, None),
        (8, "x", "es", "b"),
        (8, "another text of the same id", "en", "b"),
        (9, "one two three four five six seven eight nine ten eleven", "en", "c"),
    ]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({k: F.lit(v) for k, v in CLASHING.items()})


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
