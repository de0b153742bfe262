import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(texts, first=0):
    """Rows of ``documents`` for some texts, numbered from ``first``."""
    return [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, first=0):
        return spark.createDataFrame(rows_of(texts, first), DOCS)
    return make


@pytest.fixture(scope="session")
def real_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeats, ties, odd characters,
    and columns named like the operators' own."""
    long = "lorem ipsum dolor sit amet, " * 20_000
    texts = [None, "", " \t\n", "one", "a b c d", "x" * 50_000, long, "same words here again and again " * 5,
             "same words here again and again " * 5, "é日本😀\x00\x1f  ünïcode", "9" * 30_000 + "@", "\n" * 1000]
    rows = rows_of(texts) + [(None, "no id, but some text of its own", None, None, None), (7, texts[7], None, None, None),
                             (100, "lang is null " * 30, None, None, None)]
    return spark.createDataFrame(
        [(*r, 1.5, 2, "x", True) for r in rows],
        DOCS + ", score double, bucket int, `d1` string, kept boolean")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
