import pytest

from telemill.llm.queries import table

SMALL = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs."""

    def make(*rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in rows], FIELDS)

    return make


@pytest.fixture(scope="session")
def small_docs(spark):
    return table(spark, SMALL, "documents")
