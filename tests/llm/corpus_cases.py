"""Small inputs with all that an operator must take, and plain versions of what several operators need."""

import re

from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def low(text):
    return (text or "").translate(LOWER)


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(spark, rows, extra=()):
    """rows: (doc_id, text); extra: names of further columns, all strings."""
    schema = T.StructType([*DOCUMENTS.fields, *(T.StructField(x, T.StringType()) for x in extra)])
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), *("x" for _ in extra)) for i, t in rows], schema)


LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "Straße ÀÉ İ ß"), (5, "Straße ÀÉ İ ß"), (6, LONG), (None, "no id at all here"), (None, None), (7, "a\x00b \u2028 c\u00a0d"), (8, "😀 emoji 😀 text")]
