import pytest

from brute import ODD


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts, one row twice, a row without an id, and columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(11, ODD[11]), (None, "no id here at all")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, spans string, words string, fp long, rank int, title string"
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), 0.5, True, "s", "w", 1, 1, None) for i, t in rows], schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")
