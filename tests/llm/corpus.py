"""Small tables with everything an operator must cope with."""

import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, COLUMNS)


def clashing(df, *names):
    """``df`` with more columns: the names given, and the text column's name in capitals."""
    from pyspark.sql import functions as F

    more = df.select("*", *[F.lit("x").alias(n) for n in names])
    return more.toDF(*more.columns)


ODD = [None, "", " \t\n", "one", "one two", "Ünï cödé — 日本 \U0001f600", "a\n\nb\n", "same words here", "same words here", "w " * 30_000]
