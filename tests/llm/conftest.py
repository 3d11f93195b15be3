import pytest


ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (6, "x " * 5000),
    (7, "é" * 300 + "\n\nüñ 日本語 😀   end"),
    (7, "é" * 300 + "\n\nüñ 日本語 😀   end"),
    (None, "a row without an id one two three"),
    (None, None),
    (8, "line a\nline b\nline c\nline d\nline e"),
    (9, "line a\nline b\nline c\nline d\nline e\nmore"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, None if n % 3 == 0 else "en", None, None if t is None else len(t), "clash", n, "x") for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, line int, hash string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
