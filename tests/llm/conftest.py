import pytest

LONG = "word and other words, " * 9000
DOCS = "doc_id bigint, text string, lang string, node string, n int, key string, `rank` int"


def rows(texts, first=0):
    """Rows of documents with columns whose names operators use themselves."""
    return [(i, text, "en", "x", 1, "k", 0) for i, text in enumerate(texts, first)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, first=0, extra=()):
        return spark.createDataFrame(rows(texts, first) + list(extra), DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and very long texts, ties, a repeated row, and a null id."""
    texts = [None, "", " ", "same text here", "same text here", LONG, "été <|endoftext|> x", "\t\n", "a"]
    again = rows(texts)[3]
    return make_docs(texts, extra=[again, (None, "same text here", None, None, None, None, None)])
