import pytest

#: Nulls, empty text, only white space, repeated rows, equal texts under other ids, one very long text.
EDGE_ROWS = [
    (1, "", "en", "s", 0),
    (2, None, None, None, None),
    (3, " \t\n ", "en", "s", 4),
    (4, "One two", "en", "s", 7),
    (5, "one TWO", "en", "s", 7),
    (6, "Ünïcode wörds 漢字 🙂 'tis it's  two  spaces here", "de", "s", 40),
    (6, "Ünïcode wörds 漢字 🙂 'tis it's  two  spaces here", "de", "s", 40),
    (None, "a row without an id", "en", "s", 19),
    (8, "word " * 60_000, "en", "s", 300_000),
    (9, "x" * 200_000, "en", "s", 200_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The edge rows, with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ("fp", "root", "score", "label", "toxic", "pos", "item_id", "words", "html", "h", "n", "ids", "media")
    return spark.createDataFrame(EDGE_ROWS, SCHEMA).withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
