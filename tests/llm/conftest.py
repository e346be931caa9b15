import pytest


@pytest.fixture()
def frame(spark):
    """Rows as a table of documents with extra columns whose names clash with what operators add."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", f"src{i % 3}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
