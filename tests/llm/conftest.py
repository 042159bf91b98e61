import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing column names."""
    long = " ".join(f"word{k % 977} and then" for k in range(6000))
    shared = "this passage is shared by two of the documents and it is long enough to be more than a hundred bytes. "
    rows = [(1, "Hello there World", "en", "a", 17, "x", "y"), (2, "hello There world", None, None, None, None, None), (3, None, "en", "a", 0, "x", "y"), (4, "", "en", "a", 0, "x", "y"), (5, long, "en", "b", 1, "x", "y"), (6, long + " end", "en", "b", 1, "x", "y"), (7, "alpha " + shared, "en", "b", 1, "x", "y"), (8, "beta " + shared * 2, "en", "b", 1, "x", "y"), (8, "beta " + shared * 2, "en", "b", 1, "x", "y"), (None, "no id " + shared, "en", "b", 1, "x", "y"), (9, "é" * 150 + " \U0001f600 <|endoftext|>\n\n x", "en", "b", 1, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
