import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long, h1 long, rep long, label int, _n int, version long"


@pytest.fixture(scope="session")
def make_docs(spark, docs_schema):
    """Documents with extra columns whose names occur inside the operators."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), 1, 2, 3, 4, 5) for i, t in rows]
        return spark.createDataFrame(full, docs_schema)

    return make
