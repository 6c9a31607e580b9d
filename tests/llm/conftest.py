"""Small documents with the odd cases that every operator must take."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    long_text = "many words in one very long text " * 20000
    rows = [
        (1, "one two three four five six seven", "en", "a", 33, "x"),
        (2, "one two three four five six seven", "en", "a", 33, "x"),
        (3, "", "en", "b", 0, None),
        (4, None, "en", "b", None, None),
        (5, " \t\n", None, None, 3, None),
        (6, "word", "de", None, 4, None),
        (7, long_text, "en", "a", len(long_text), None),
        (8, "Ünïcödé 漢字 😀 text", "fr", "c", 18, None),
        (1, "one two three four five six seven", "en", "a", 33, "x"),
        (None, "no id here at all", "en", "a", 17, None),
    ]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
