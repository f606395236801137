"""Small documents that hold the hard cases."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


def docs(spark, texts, sources=None, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources or ["src0"] * len(texts))]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


ODD = [None, "", "\n\n", "word", "é" * 5000 + " \x0b\x1c tail", "a b c a b c a b c", "Line of some length here.\n" * 40]
