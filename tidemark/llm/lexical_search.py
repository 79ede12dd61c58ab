"""Ranked lexical search: postings in a table by term bucket, joined with the items' terms, summed by item and document.

The index is one row for each term of each document. Its table has a folder for each bucket of terms, so that a search
reads the buckets of its own terms alone, and is bucketed by document inside the folders, so that a document's matches,
whatever their buckets, meet in one task: the sums over items and documents need no exchange, a very frequent
term is dealt out over all tasks, and each task hands on k rows an item at most.

The items' terms are broadcast in parts of at most ``ENTRIES``; further parts are joined in turn and their matches
summed together, which gives the same result for any number of items and terms.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, pick, shared_folder, table, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, ENTRIES, TOP = 16, 1 << 17, 10
#: Of the 128 ASCII bytes digits and letters stay, A-Z as a-z, and the others become spaces; bytes of other letters stay.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def counted(df: DataFrame) -> DataFrame:
    """row, id, n, term, tf: a row for each distinct term of each text of ``df``, which has row, id and text.

    n is the text's number of terms with repeats, tf the number of those equal to term. Null texts have no terms.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or b"").translate(FOLD).split() for t in batch["text"].view(pa.binary()).to_pylist()]
            counts = [Counter(w) for w in words]
            sizes = [len(c) for c in counts]
            of = np.repeat(np.arange(len(words)), sizes)
            terms = pa.array([t for c in counts for t in c], pa.binary()).view(pa.string())
            tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(of))
            n = np.repeat(np.fromiter(map(len, words), np.int64, len(words)), sizes)
            yield pa.RecordBatch.from_arrays([batch["row"].take(pa.array(of)), batch["id"].take(pa.array(of)), pa.array(n), terms, pa.array(tf)], ["row", "id", "n", "term", "tf"])

    return df.select("row", "id", "text").mapInArrow(count, f"row long, id {df.schema['id'].dataType.simpleString()}, n long, term string, tf long")


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The index: row, id, n, term, tf, bucket. row is a document's number, n its terms with repeats, tf those equal to term.

    Null texts, and texts without terms, have no row. Each input row is a document of its own, also where ids repeat or
    are null. Texts are shuffled once, by row number; they are counted and written where they then are.
    """
    spark = docs.sparkSession
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = pick(docs, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id()).where("text is not null")
    name = f"postings_{uuid.uuid4().hex}"
    with arrow_batches(spark):
        out = counted(base.repartition(files, "row")).withColumn("bucket", bucket(buckets)).write.format("parquet").partitionBy("bucket")
        out.bucketBy(files, "row").sortBy("term").option("path", f"{shared_folder(spark)}/tidemark/{name}").saveAsTable(name)
    return spark.table(name)


def wanted(items: DataFrame, id_col: str = "item_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """item, term, times, bucket, one row for each distinct term of each item, as a table."""
    words = counted(pick(items, id=id_col, text=text_col).withColumn("row", F.lit(0).cast("long")))
    with arrow_batches(items.sparkSession):
        return written(words.groupBy(F.col("id").alias("item"), "term").agg(F.sum("tf").alias("times")).withColumn("bucket", bucket(buckets)), "search-terms")


def search(index: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """item, rank, id, score of the k best documents of each item with a score above 0; all integers of 64 bits.

    Items of one id, null among them, are one item with the terms of all its rows; items without terms find nothing.
    Equal scores stand by ascending id, nulls last, and rows of equal id each have a rank. Without documents, or without
    items, the result is empty.
    """
    asked = wanted(items, id_col, text_col, buckets)
    parts = -(-asked.count() // ENTRIES)
    docs, length = index.groupBy("row").agg(F.first("n").alias("n")).agg(F.count("*"), F.sum("n")).first()
    if not parts or not docs:
        nothing = index.select("row", "id", F.lit(0).cast("long").alias("score"), F.lit(None).cast(asked.schema["item"].dataType).alias("item"))
        return _ranked(nothing.where(F.lit(False)), k)
    asked = written(asked.withColumn("part", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(parts))), "search-parts")
    matches = None
    for part in range(parts):
        some = asked.where(F.col("part") == part).drop("part")
        used = [r[0] for r in some.select("bucket").distinct().collect()]
        read = index.where(F.col("bucket").isin(used)) if len(used) < buckets else index
        held = read.join(F.broadcast(some.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(float(2 * docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
        weighed = written(some.join(held, "term").select("item", "term", (weight * F.col("times")).alias("w")), "search-weights")
        hit = read.join(F.broadcast(weighed), "term")
        m = F.expr(f"25 + (75 * n * {docs}L) div {length}L")
        hit = hit.withColumn("m", m).select("item", "row", "id", F.expr("w * ((1000000000L * tf) div (1000 * tf + 8 * m))").alias("score"))
        matches = hit if matches is None else matches.unionByName(hit)
    return _ranked(matches.groupBy("item", "row", "id").agg(F.sum("score").alias("score")).where("score > 0"), k)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "id", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(postings(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"item": "item_id", "id": "doc_id"})


def _terms_sql(name: str, key: str) -> str:
    text = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"SELECT {key}, term, count(*) AS times FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{TERM}')) AS term FROM {name}) GROUP BY ALL"


OP11_SQL = f"""
WITH postings AS ({_terms_sql("documents", "doc_id")}), asked AS ({_terms_sql("benchmark", "item_id")}),
lengths AS (SELECT doc_id, sum(times)::BIGINT AS n FROM postings GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings CROSS JOIN whole GROUP BY term, docs
), scores AS (
  SELECT item_id, doc_id, sum(asked.times * w * ((1000000000 * postings.times) // (1000 * postings.times + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) CROSS JOIN whole GROUP BY item_id, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= {TOP}
"""
