import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 97}x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, columns with clashing names."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", "en", "b", 3), (5, LONG, "fr", "b", len(LONG)),
        (6, LONG, "fr", None, len(LONG)), (7, "same text here for all of us to see", "de", "c", 1), (7, "same text here for all of us to see", "de", "c", 1),
        (8, "same  text\there for all of us to see", "de", "c", 1), (None, "without an id", "es", "c", 1), (None, None, None, None, None),
        (9, "éè \U0001f600 café 漢字 ... 123", "fr", "d", 5), (10, "12345 67 !!", None, "d", 5),
    ]
    from pyspark.sql import functions as F

    names = ["size", "kept", "score", "slot", "text_", "key_", "digest_", "n", "id", "`odd.name"]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(i) for i, c in enumerate(names)})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
