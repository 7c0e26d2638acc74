import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, first=0, source="s"):
    return [(first + i if t is not Ellipsis else None, None if t is Ellipsis else t, "en", source, len(t) if isinstance(t, str) else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    def docs(texts, first=0, source="s"):
        return spark.createDataFrame(rows(texts, first, source), DOCS)

    return docs


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, null and blank texts, repeated rows and an extra column whose name clashes with outputs."""
    data = [(1, "a b c d e f g", "en", "s", 1, "x"), (1, "a b c d e f g", "en", "s", 1, "x"), (2, None, None, None, None, None), (None, "a b c d e f g", "en", None, 1, "x"), (3, "", "en", "s", 0, "x"), (4, "  \n ", "en", "s", 0, "x"), (5, "word " * 50_000, "en", "t", 1, "x"), (6, "ñ ü 漢字 🙂", "es", "t", 1, "x")]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
