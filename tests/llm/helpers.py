"""Fixtures and brute-force versions shared by the tests."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: A column that an operator might use for itself.
CLASH = ["id", "t", "h", "n", "no", "at", "key", "c", "score", "lang_pred", "ids", "kept"]


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_texts():
    """Nulls, empty, spaces, short, very long, repeated and tied texts."""
    long = words(20_000, 1)
    a = words(120, 2)
    return [None, "", " ", "\n\n", "a", "one two", a, a, a.replace(" ", "  ", 3), long, long + " end", "x" * 5_000, "é" * 600, "日本語 " * 200, words(40, 3) + "\n" + words(40, 4), words(40, 4) + "\n" + words(40, 5), None, "a▁b c", "\t\r\x0b\x0c"]


def docs(spark, texts, clash=True):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASH])
    return df


def empty(spark):
    return docs(spark, []).limit(0)
