"""Small tables for the tests: odd rows that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("TEXT", T.StringType()),
    T.StructField("slot", T.StringType()), T.StructField("id", T.StringType()),
])


def documents(n: int = 60, seed: int = 1) -> list[tuple]:
    draw = random.Random(seed)
    words = {"xx": ["alpha", "beta", "gamma", "delta", "the"], "yy": ["uno", "dos", "tres", "cuatro", "la"]}
    rows = []
    for i in range(n):
        lang = draw.choice(["xx", "yy"])
        text = " ".join(draw.choice(words[lang]) + draw.choice(["", "s", "er"]) for _ in range(draw.randrange(1, 40)))
        rows.append((i, text, lang, draw.choice(["a", "a", "b", "c"]), len(text)))
    for i, (src, text) in enumerate([(3, None), (4, ""), (5, "  \n\t"), (6, "1234 !!"), (7, "É   x y"), (8, "word " * 50_000)]):
        rows.append((n + i, text, "xx" if i % 2 else None, None if i % 3 else "a", src))
    rows += [(None, "no id here at all", "xx", "a", 1), rows[2], rows[2], (n + 9, rows[1][1], "yy", "b", 1), (n + 10, rows[1][1] + " more", "yy", "b", 1)]
    return [r + ("clash", "clash", "clash") for r in rows]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
