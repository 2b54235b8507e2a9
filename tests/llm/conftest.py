import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, TEXT)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null and empty texts, white space, a null doc_id, repeated rows, a very long text and a very long word."""
    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    plain = "the quick brown fox jumps over the lazy dog again and again until the evening comes along the river side"
    return make_docs([
        (1, None), (2, ""), (3, " \t\n "), (None, plain), (4, plain), (4, plain), (5, plain, None, None), (6, long_text),
        (7, "x" * 200_000), (8, "Ünïcode ÄÖ ß 漢字 \U0001f600 text"), (9, "!!! ### $$$"),
    ])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
