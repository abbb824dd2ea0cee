import pytest

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty, blank, ties, repeated rows.
ODD = [
    (0, None, None, None, None),
    (1, "", "en", "a", 0),
    (2, " \t\n ", "en", "a", 4),
    (3, "one", "en", "a", 3),
    (4, "One  two\tthree\nfour five", None, "b", 23),
    (5, "one two three four five", "fr", "b", 23),
    (6, "one two three four five", "fr", None, 23),
    (6, "one two three four five", "fr", None, 23),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
