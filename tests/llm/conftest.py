import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(*x) for x in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text, lang, source), with columns that clash."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(a, b, c, d, len(b or "")) for a, b, c, d in rows], DOCS)
        if clash:
            from pyspark.sql import functions as F

            for name in ("n_words", "fingerprint", "kept", "size", "h", "site", "page", "target"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(20_000))
    return [
        (1, None, None, None), (None, "alpha beta gamma", "en", "a"), (2, "", "en", "a"), (3, " \t\n ", "de", "b"), (4, "one", "en", "a"),
        (5, long, "en", "a"), (6, "same words here again " * 30, "en", "b"), (7, "same words here again " * 30, "en", "b"),
        (7, "same words here again " * 30, "en", "b"), (8, "123 456 !!!", None, "c"), (9, "Straße ñandú Ελλάς İ 你好 <|endoftext|> it's", "de", None),
        (10, "line a\nline b\nline a\n\nline c", "en", "c"),
    ]
