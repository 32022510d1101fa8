import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # Names that operators use inside must not get in the way.
        T.StructField("row", T.LongType()), T.StructField("words", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("print", T.StringType()),
        T.StructField("kind", T.StringType()), T.StructField("slot", T.StringType()), T.StructField("_listed", T.StringType()), T.StructField("bin", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """A table of (doc_id, text) or (doc_id, text, source) rows, with columns whose names clash."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1]), *(["x"] * 0), 7, "w", "h", "p", "k", "s", "l", "b") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Null and empty texts, null ids and sources, repeats, a long text, one without spaces, white space alone."""
    return documents(
        (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (4, "a"), (5, "Ünï ﬁ İ K   𝒳 text"), (6, "x" * 200_000), (7, "one two three four five six " * 20_000),
        (None, "no id here", "src1"), (8, "same text of several words here", None), (9, "same text of several words here", None),
    )


@pytest.fixture(scope="session")
def nothing(documents):
    return documents()
