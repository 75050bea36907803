import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "wort " * 9000

#: Null, empty, blank, repeated, tied and very long texts, and a null id.
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "same text here"), (5, "same text here"), (5, "same text here"), (6, "Same Text here"),
    (7, LONG), (8, LONG), (9, LONG + "x"), (10, "a"), (11, "é É ß\n\nline  two\r\nLINE  two"), (None, "no id"), (None, "same text here"),
    (12, "<|endoftext|> it's 12 o'clock"), (13, "one two three four five six seven eight nine ten"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with columns named as operators name theirs."""
    rows = [(i, t, "en", "src0", 0, "x", 7) for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", id string, n bigint")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
