import pytest

EDGE = [
    (1, "same text here and more words to fill it up", "en", "a"), (2, "same text here and more words to fill it up", "en", "a"), (3, "", "en", None), (4, None, None, "b"), (5, " ", "en", "a"), (6, "word", "fr", "b"),
    (7, "Ünï ♥ cödé  double  spaces ▁ and\ttabs\n\nlines ", "de", "c"), (8, "lorem ipsum dolor sit amet " * 4000, "en", "a"), (None, "a row without an id", "en", "a"), (9, "same text here and more words to fill it up", "en", "a"),
    (6, "word", "fr", "b"), (10, "x" * 40000, "en", "a"), (11, "😀" * 50 + " end's 'll I'm 12345 !!!   \n\n\n  x", "en", "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Null and repeated ids, null and empty and very long texts, equal rows, and columns whose names clash with the operators' own."""
    rows = [(*r, "x", 1, True, "k") for r in EDGE]
    names = "doc_id long, text string, lang string, source string, text_sha256 string, group_size int, kept boolean, key string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
