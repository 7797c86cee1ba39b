import pytest

LONG = "word " * 30_000 + "end"
PROSE = "The quick brown fox jumps over the lazy dog and runs away from the small house near the old river. "

#: Nulls, empty and blank texts, one word, a very long text, exact copies and repeated rows.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, LONG), (7, PROSE * 4), (7, PROSE * 4), (8, PROSE * 4 + "And more follows here."), (9, "!!! ### 123"), (10, "é\u0301 日本語 \U0001f389 \0 x"), (11, "one")]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge cases in a table with more columns, some named like those that operators make."""
    rows = [(i, t, None if i == 1 else "en", None, 0, "x", 1, "y", None) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, print string, key int, kept string, length int")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
