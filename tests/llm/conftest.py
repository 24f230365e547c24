import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, digest string, keys string, a long, root long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows that operators meet: nulls, empty and long texts, repeated rows, and columns named like their own."""

    def build(texts):
        rows = [(i, t, None, None, None, "x", "y", "z", 7, 8) for i, t in texts]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def sample():
    """A folder of small given tables."""
    return "/root/testdata/sf0.001"
