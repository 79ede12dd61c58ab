"""Exact search for the largest inner products by MaxScore over shards of postings.

A vector's components are integers, a dimension is a term, and its posting list holds the components of a
shard's vectors with the least and the greatest of them. From these follows the most that a term can add to a query's
score, zero at least, as vectors may lack the term. Terms are ordered by it: the last ones that together cannot lift a
vector to the query's k-th best score are non-essential. The others' lists are traversed; vectors that could
still be among the k best are probed in the non-essential lists, largest bound first, and dropped as soon as
they no longer could. The k-th best score rises from block to block and is kept through all shards of a task. Tasks
hand on k rows a query, which are merged.

Queries are taken in waves of at most ``WAVE``, which every task gets whole; each wave's results are written, so any
number of queries can be asked.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, pick, row_numbers, shared_folder, table, written
from tidemark.llm.embedding_dedup import groups

SHARD, BLOCK, WAVE, SCALE, TOP, SHARE, PROBES, EXACT = 8192, 1024, 4096, 256, 5, 50, 8, 1 << 53
SHARDS = "rows binary, ids binary, no_id binary, terms array<int>, low array<long>, high array<long>, places array<binary>, parts array<binary>"


def components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """row, id, vec: floor(scale * component) of the vectors without null or non-finite components, as a table.

    Components beyond 2^31 after scaling raise an error, since scores are integers of 64 bits.
    """
    base = pick(df, id=id_col, vec=vec_col).withColumns({"row": F.monotonically_increasing_id(), "vec": F.col("vec").cast("array<double>")})
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    large = F.raise_error(F.lit("a component is too large for an integer score"))
    whole = F.transform("vec", lambda x: F.when(F.abs(x) < float(2**31 // scale), F.floor(x * scale)).otherwise(large.cast("long")))
    return written(base.where(F.col("vec").isNotNull() & finite).select("row", "id", whole.alias("vec")), "search-vectors")


def narrow(values: np.ndarray) -> np.ndarray:
    """Integers in the smallest signed type that holds them."""
    most = int(np.abs(values).max(initial=0))
    return values.astype(np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int64)


def shards(vectors: DataFrame, size: int = SHARD) -> DataFrame:
    """One row for each shard of about ``size`` vectors: their rows and ids, and each term's bounds and posting list.

    A list that holds a quarter of the shard's vectors or more has a value for each of them; others name their places.
    """
    n = max(1, -(-vectors.count() // size))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n)).cast("long")).repartition(n, "shard").sortWithinPartitions("shard", "row")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["shard"]):
            vec = group["vec"].combine_chunks()
            starts = vec.offsets.to_numpy()
            sizes, flat = np.diff(starts), vec.flatten().to_numpy()
            of, term = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], sizes)
            held = flat != 0
            of, term, flat = of[held], term[held], flat[held]
            order = np.argsort(term, kind="stable")
            of, flat = of[order], flat[order]
            terms, first = np.unique(term[order], return_index=True)
            places, parts = [], []
            for a, b in zip(first, [*first[1:], len(flat)]):
                if 4 * (b - a) >= len(sizes):
                    whole = np.zeros(len(sizes), np.int64)
                    whole[of[a:b]] = flat[a:b]
                    places.append(None)
                else:
                    whole = flat[a:b]
                    places.append(of[a:b].astype(np.int32).tobytes())
                parts.append(b"%c" % narrow(whole).itemsize + narrow(whole).tobytes())
            low, high = (f.reduceat(flat, first) if len(flat) else flat for f in (np.minimum, np.maximum))
            ids = group["id"].combine_chunks()
            cells = group["row"].to_numpy().tobytes(), ids.fill_null(0).to_numpy().tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes()
            columns = [pa.array([c], pa.binary()) for c in cells] + [pa.array([terms.astype(np.int32)], pa.list_(pa.int32()))]
            columns += [pa.array([np.minimum(low, 0)], pa.list_(pa.int64())), pa.array([np.maximum(high, 0)], pa.list_(pa.int64()))]
            columns += [pa.array([places], pa.list_(pa.binary())), pa.array([parts], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SHARDS.split(", ")])

    with arrow_batches(vectors.sparkSession, 4096):
        return written(dealt.mapInArrow(build, SHARDS), "search-shards")


class Lists:
    """A shard's posting lists, decoded: a matrix with a line for each term, and the terms' bounds."""

    def __init__(self, row: dict):
        self.rows, self.ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.no_id = np.frombuffer(row["no_id"], bool)
        self.terms = np.array(row["terms"], np.int64)
        self.low, self.high = (np.array(row[c], float) for c in ("low", "high"))
        self.matrix = np.zeros((len(self.terms), len(self.rows)))
        for line, at, part in zip(self.matrix, row["places"], row["parts"]):
            values = np.frombuffer(part, f"i{part[0]}", offset=1)
            line[slice(None) if at is None else np.frombuffer(at, np.int32)] = values
        self.most = max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0))

    def line(self, query: np.ndarray) -> np.ndarray:
        """The query's value of each of the shard's terms."""
        out = np.zeros(len(self.terms))
        inside = self.terms < len(query)
        out[inside] = query[self.terms[inside]]
        return out


class Best:
    """A query's k best so far, by score, then id (nulls last), then row."""

    def __init__(self, k: int):
        self.k, self.kept = k, np.empty((4, 0), np.int64)

    @property
    def least(self) -> float:
        return float(self.kept[0, -1]) if self.kept.shape[1] == self.k else -np.inf

    def add(self, score: np.ndarray, lists: Lists, at: np.ndarray) -> None:
        every = np.concatenate((self.kept, [score.astype(np.int64), lists.no_id[at], lists.ids[at], lists.rows[at]]), axis=1)
        self.kept = every[:, np.lexsort((every[3], every[2], every[1], -every[0]))[: self.k]]


def maxscore(query: np.ndarray, own: int, lists: Lists, best: Best) -> int:
    """Adds the shard's vectors that are among the query's k best; returns how many components were looked at."""
    q = lists.line(query)
    if max(np.abs(q).max(initial=0), 1) * max(lists.most, 1) * max(len(q), 1) >= EXACT:
        raise ArithmeticError("components are too large for exact scores")
    a, b = q * lists.low, q * lists.high
    upper = np.maximum(a, b)
    order = np.argsort(-upper, kind="stable")
    q, upper, looked = q[order], upper[order], 0
    rest = np.append(np.cumsum(upper[::-1])[::-1], 0)  # most that the terms from here on can add
    for start in range(0, len(lists.rows), BLOCK):
        block = slice(start, min(start + BLOCK, len(lists.rows)))
        split = int(np.argmax(rest < best.least)) if rest[-1] < best.least else len(q)  # terms from here on are non-essential
        score = q[:split] @ lists.matrix[order[:split], block] if split else np.zeros(block.stop - start)
        looked += split * len(score)
        at = np.flatnonzero((score + rest[split] >= best.least) & (lists.rows[block] != own))
        score, at = score[at], at + start
        for some in range(split, len(q), PROBES):
            if not len(at):
                break
            more = slice(some, min(some + PROBES, len(q)))
            score = score + q[more] @ lists.matrix[np.ix_(order[more], at)]
            looked += (more.stop - some) * len(at)
            still = score + rest[more.stop] >= best.least
            score, at = score[still], at[still]
        if len(at):
            best.add(score, lists, at)
    return looked


def search(index: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_row, query_id, rank, id, score of each query's k best vectors (all, if fewer) other than its own row.

    ``queries`` has row, id, vec as ``components`` gives them. Vectors of unlike lengths meet in their common components; an empty one scores 0. Equal
    scores stand by ascending id, nulls last. Repeated rows are vectors of their own. Without queries or vectors the
    result is empty.
    """
    spark = index.sparkSession
    numbered = written(row_numbers(queries.select("row", "id", "vec"), ["id", "row"], "search-queries", "number"), "search-numbered")
    folder = f"{shared_folder(spark)}/tidemark/search-waves-{uuid.uuid4().hex}"
    schema = "query_row long, id long, row long, score long"
    waves = range(max(1, -(-numbered.count() // WAVE)))
    for wave in waves:
        asked = numbered.where(F.col("number").between(wave * WAVE, (wave + 1) * WAVE - 1)).select("row", "vec").collect()
        shared = spark.sparkContext.broadcast([(r["row"], np.array(r["vec"], float)) for r in asked])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = [Best(k) for _ in shared.value]
            for batch in batches:
                for row in batch.to_pylist():
                    lists = Lists(row)
                    for (own, query), b in zip(shared.value, best):
                        maxscore(query, own, lists, b)
            for (own, _), b in zip(shared.value, best):
                score, no_id, ids, rows = b.kept
                if len(score):
                    columns = np.full(len(score), own), pa.array(ids, mask=no_id.astype(bool)), rows, score
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_row", "id", "row", "score"])

        with arrow_batches(spark, 1):
            index.mapInArrow(run, schema).write.parquet(f"{folder}/{wave}")
        shared.destroy()
    found = spark.read.schema(schema).parquet(*[f"{folder}/{wave}" for wave in waves])
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = numbered.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return ranked.join(names, "query_row").select("query_row", "query_id", "rank", "id", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = components(table(spark, sf_dir, "embeddings"))
    found = search(shards(vectors), vectors.where(F.col("id") % SHARE == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP13_SQL = f"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.vec, v.vec)::BIGINT AS score
  FROM vectors q JOIN vectors v ON q.vec_id % {SHARE} = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores
) WHERE rank <= {TOP}
"""
