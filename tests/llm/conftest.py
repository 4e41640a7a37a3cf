import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, n string"
EDGES = [
    (None, "no id here but some words", "en", "a", 1, "x", "y", "z"),
    (1, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, None, None, None),
    (3, " \n\t ", "en", None, 0, None, None, None),
    (4, "One", "de", "b", 3, None, None, None),
    (5, "same row twice, the same row twice", "de", "b", 3, None, None, None),
    (5, "same row twice, the same row twice", "de", "b", 3, None, None, None),
    (6, "a" * 70_000, "en", "a", 70_000, None, None, None),
    (7, "word " * 9_000 + "é<|endoftext|>'s 12", "en", "a", 0, None, None, None),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, a repeated row, columns whose names operators use themselves."""
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
