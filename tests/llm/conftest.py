import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, hash string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and columns of clashing names."""
    rows = [
        (1, "The cat sat on the mat and looked at the dog in the garden.", "en", "a", 1, "x", "y"),
        (2, "The cat sat on the mat and looked at the dog in the garden.", "en", "b", 1, "x", "y"),
        (2, "The cat sat on the mat and looked at the dog in the garden.", "en", "b", 1, "x", "y"),
        (3, None, None, None, None, None, None),
        (4, "", "en", "a", 0, "x", "y"),
        (None, "Der Hund und die Katze sind im Garten und warten auf das Essen.", "de", "a", 5, None, None),
        (5, " \t\n ", "de", None, 3, "x", "y"),
        (6, "word " * 30_000, "en", "a", 9, "x", "y"),
        (7, "x" * 70_000, "en", "b", 9, "x", "y"),
        (8, "12 34 !? \U0001f642", None, "c", 9, "x", "y"),
        (9, "Der Hund und die Katze sind im Garten und warten auf das Essen!", "de", "a", 5, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
