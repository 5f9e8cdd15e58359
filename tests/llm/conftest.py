import pytest


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with every awkward case: nulls, empty texts, repeats, clashing extra columns."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.\nReleased under the MIT License.", "x", "a"),
        (2, "", "y", "b"),
        (3, None, "z", "c"),
        (4, "The quick brown fox jumps over the lazy dog.\nReleased under the MIT License.", "x", "a"),
        (4, "The quick brown fox jumps over the lazy dog.\nReleased under the MIT License.", "x", "a"),
        (None, "a text without an id", None, None),
        (7, "é" * 50 + " " + "word " * 400, "w", "d"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, digest string")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
