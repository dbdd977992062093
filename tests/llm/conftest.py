import pytest

ODD_TEXTS = [None, "", " ", "\n\n", "a", "é", "x " * 30_000, "y" * 5_000, "same text in two rows of words", "same text in two rows of words"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and ids, and extra columns with names used inside."""
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "x", 1, i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, None, None, None, None, None, None, None), (None, "no id here", "en", "s", 1, "x", 2, 3), rows[4], rows[8]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _t string, fp long, component long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
