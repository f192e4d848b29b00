import pytest

TEXT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """documents() of (doc_id, text) or longer rows, with a column whose name clashes."""

    def make(rows):
        full = [(*r, *(None,) * (5 - len(r)), "x") for r in rows]
        return spark.createDataFrame(full, TEXT + ", score string")

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
