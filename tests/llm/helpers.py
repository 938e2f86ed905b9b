"""Odd rows that every operator must take, and small brute-force tools."""

from __future__ import annotations

from pyspark.sql import types as T

#: extra columns bear names that operators use inside or return
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("fp", T.StringType()),
    T.StructField("tag", T.IntegerType()), T.StructField("id", T.StringType()),
    T.StructField("n", T.IntegerType()), T.StructField("block", T.StringType()),
    T.StructField("host", T.StringType()), T.StructField("size", T.StringType())])


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns are filled."""
    return spark.createDataFrame(
        [(i, t, lang, src, len(t or ""), "x", 7, "y", 1, "z", "h", "s") for i, t, lang, src in rows],
        DOCS)


def words(seed: int, n: int, vocabulary: int = 500) -> str:
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Null and empty texts, white space, no letters, one word, ties, repeated rows,
    null ids and sources, a very long text."""
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "123 !!", "en", "b"),
            (5, "word", "en", None), (6, words(1, 60), "en", "a"), (6, words(1, 60), "en", "a"),
            (7, words(1, 60), "en", "b"), (None, words(2, 50), "de", "a"), (None, None, None, None),
            (8, words(3, 30_000, 5000), "en", "a"), (9, "ä ö\x0bü\x0cß 日本 \x1c x\xa0y", "de", "c")]
