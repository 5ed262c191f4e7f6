import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (id, text[, lang[, source]]) as a table of documents."""

    def make(rows, extra=()):
        filled = [(*r, *(None, None)[len(r) - 2:])[:4] for r in rows]
        schema = T.StructType([*DOCUMENTS, *[T.StructField(c, T.StringType()) for c in extra]])
        return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(extra)) for r in filled], schema)

    return make


@pytest.fixture(scope="session")
def table(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


LONG = "many words make a long text that no batch can hold in one piece " * 6000
#: NULLs in any column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, "   ", "en", None), (None, "A text without an id.", "en", "b"),
    (None, None, None, None), (4, LONG, "en", "a"), (5, LONG + "end", "en", "b"), (6, "Same text here.", "de", "b"),
    (7, "same TEXT here.", "de", "b"), (6, "Same text here.", "de", "b"), (8, "\U0001F600 é ß \x00 \x02", "fr", "c"),
    (9, "***", "fr", "c"), (10, "one", "en", "c"),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
