"""Near-duplicate embeddings by randomised-rotation binary codes.

Each vector is scaled to unit length and rotated once, and of it a code is stored (RaBitQ; Gao and Long, 2024): the signs
of its rotation, packed to bits; the factor f, the inner product of the signs' unit vector with the rotated vector; and,
for its part as the other side of a pair, the rotation in PLANES bits a component, as bit planes. Products of one side's
small integers and the other's bits, divided by f, estimate the inner product without bias. Where that is s, the error's
deviation is sqrt((1 - f^2) (1 - s^2) / f^2 / (D - 1)), and of the planes' rounding half a step; BOUND deviations below
the threshold lies the bound that a pair at the threshold falls short of with a chance of about 1e-9.

Which codes meet is decided by tables of further random signs: two vectors at the threshold share a table's bucket with a
known chance, and there are as many tables as it takes to miss such a pair with a chance of MISS (closer pairs far less).
Only codes are shuffled to the buckets. Buckets of more than CHUNK codes are cut into chunks and pairs of chunks, so no
bucket is ever whole in a task. A bucket names its vectors that some estimate brings near the threshold; these alone are
fetched, and their pairs near the threshold are computed again in double precision. Only exact results link. A pair
counts in the first table that it meets in. A bucket gives each vector's number of links and a forest of its links, never
its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import HOT, components, joined_evenly, pick, table, text_batches, written

THRESHOLD, BUCKET, CHUNK, BOUND, MISS, PLANES, SEED = 0.9, 2048, 4096, 6.0, 1e-6, 4, 11
SLICE = 256


def tables_for(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits of a bucket's key, number of tables)."""
    bits = max(4, min(24, math.ceil(math.log2(max(2, n / BUCKET)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def keys_for(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Each unit vector's bucket in each table."""
    planes = np.random.default_rng(seed + 1).standard_normal((x.shape[1], bits * tables))
    return ((x @ planes >= 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits))).astype(np.int32)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def packed(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    raw = np.packbits(flags, axis=1)
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)


def stored(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The code of each unit vector as bytes: words of signs, words of each bit plane, factor, lowest value, step."""
    rotated = x @ turn
    signs = rotated >= 0
    factor = np.abs(rotated).sum(axis=1) / math.sqrt(x.shape[1])
    low = rotated.min(axis=1).astype(np.float32)
    step = (np.maximum(rotated.max(axis=1) - low, 1e-9) / ((1 << PLANES) - 1)).astype(np.float32)
    dither = np.random.default_rng(SEED + 2).random(x.shape[1])
    levels = np.clip((rotated - low[:, None]) / step[:, None] + dither, 0, (1 << PLANES) - 1).astype(np.uint8)
    words = [packed(signs), *(packed(levels >> j & 1) for j in range(PLANES))]
    numbers = np.stack((factor.astype(np.float32), low, step), axis=1)
    return np.concatenate([w.view(np.uint8).reshape(len(x), -1) for w in (*words, numbers)], axis=1)


class Codes:
    """Codes of vectors of one dimension, read from their bytes and laid out so that one product gives many estimates."""

    def __init__(self, raw: np.ndarray, dim: int):
        n, width = len(raw), -(-dim // 64)
        words = np.ascontiguousarray(raw[:, : 8 * width * (1 + PLANES)]).reshape(n, 1 + PLANES, 8 * width)
        bits = np.unpackbits(words, axis=2)[:, :, :dim]
        self.dim, signs = dim, bits[:, 0].astype(np.float32)
        levels = sum(bits[:, 1 + p].astype(np.float32) * (1 << p) for p in range(PLANES))
        self.factor, low, self.step = np.ascontiguousarray(raw[:, 8 * width * (1 + PLANES) :]).view(np.float32).T
        step = self.step[:, None]
        rest = np.stack((2 * low, -dim * low - self.step * levels.sum(axis=1)), axis=1)
        self.rows = np.concatenate((2 * step * levels, rest), axis=1) / np.float32(math.sqrt(dim))
        self.columns = np.concatenate((signs, signs.sum(axis=1, keepdims=True), np.ones((n, 1), np.float32)), axis=1) / self.factor[:, None]

    def estimates(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Inner products of vectors i, by their levels, with vectors j, by their signs."""
        return self.rows[i] @ self.columns[j].T

    def bounds(self, i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
        """For each j, what the estimate of no pair (i, j) at the threshold falls short of."""
        f = self.factor[j].astype(float)
        turned = min(BOUND / math.sqrt(max(1, self.dim - 1)), 1.0) * np.sqrt(np.maximum(1 - f**2, 0) * (1 - threshold**2))
        rounded = BOUND * self.step[i].max(initial=0) / 2
        return (threshold - np.hypot(turned, rounded) / f - 1e-4).astype(np.float32)


def hopeful(codes: Codes, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of vectors whose estimate reaches the bound, for a bounded share of ``left`` at a time."""
    for at in range(0, len(left), SLICE):
        some = left[at : at + SLICE]
        i, j = np.nonzero(codes.estimates(some, right) >= codes.bounds(some, right, threshold))
        yield some[i], right[j]


def exact(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of unit vectors reach the threshold in double precision."""
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        some = slice(at, at + (1 << 16))
        out[some] = np.einsum("ij,ij->i", x[i[some]], x[j[some]]) >= threshold
    return out


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the smallest place reachable over the pairs."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys; rows come sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        k = np.stack([t[c].to_numpy() for c in keys])
        edges = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        bounds = [0, *edges.tolist()]
        for a, b in zip(bounds, bounds[1:]):
            yield t.slice(a, b - a)
        rest = t.slice(bounds[-1])
    if rest is not None:
        yield rest


def flat_rows(column: pa.ChunkedArray | pa.Array, kind: type = float) -> np.ndarray:
    """Lists of one length as rows of an array."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy().astype(kind).reshape(len(whole), -1)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of
    different lengths do not link with each other. Each row is a vector of its own, also where ids or vectors
    repeat. component_id is the smallest non-null id reachable, the row's own included; kept is whether it is the
    row's own (null ids: where there is none). An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    text_batches(spark, 4096)
    base = pick(df, id=id_col, vec=vec_col).withColumn("vec", F.col("vec").cast("array<double>"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce((F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    base = base.withColumn("vec", F.when(good, F.col("vec")))
    hashes = F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec")
    base = base.withColumns({f"h{i}": F.when(F.col("vec").isNotNull(), h) for i, h in enumerate(hashes)})
    # copies of a vector are one class, known by 128 bits
    classes = base.where("vec is not null").groupBy("h0", "h1").agg(F.first("vec").alias("vec"), F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    bits, tables = tables_for(classes.count(), threshold)
    turns: dict[int, np.ndarray] = {}

    def turn(dim: int) -> np.ndarray:
        if dim not in turns:
            turns[dim] = rotation(dim)
        return turns[dim]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch["vec"].offsets.to_numpy())
            for d in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == d))
                x = unit(flat_rows(some["vec"]))
                codes = [c.tobytes() for c in stored(x, turn(d))]
                buckets = keys_for(x, bits, tables).astype(np.int64) | np.arange(tables) << 24 | d << 40
                yield pa.RecordBatch.from_arrays([some["cid"], pa.array(codes, pa.binary()), pa.array(list(buckets), pa.list_(pa.int64()))], ["cid", "code", "buckets"])

    coded = written(classes.select("cid", "vec").mapInArrow(encode, "cid long, code binary, buckets array<long>"), "vector-codes")
    places = coded.select("cid", F.explode("buckets").alias("bucket"))
    sizes = written(places.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "vector-buckets")
    # sizes of crowded buckets are broadcast, HOT of them at most; their rows are dealt out by vector instead of by bucket
    most = coded.count() * tables / HOT
    crowded = F.broadcast(sizes.where(F.col("size") > most).toDF("_bucket", "_size"))
    places = coded.select("cid", "code", F.explode("buckets").alias("bucket")).join(crowded, F.col("bucket") == F.col("_bucket"), "left")
    places = places.withColumn("_at", F.when(F.col("_size").isNull(), F.col("bucket")).otherwise(-1 - F.col("cid")))
    places = places.join(sizes.where(F.col("size") <= most).toDF("_at", "_few"), "_at", "left")
    places = places.withColumn("size", F.coalesce("_size", "_few")).where("size is not null")
    parts = F.ceil(F.col("size") / CHUNK).cast("long")
    places = places.withColumns({"parts": parts, "chunk": F.pmod(F.xxhash64("cid", F.lit("chunk")), parts)}).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = F.shiftleft(F.least("chunk", "other"), 32).bitwiseOR(F.greatest("chunk", "other"))
    order = ["bucket", "pair"]
    places = places.select("bucket", pair.alias("pair"), "cid", "chunk", "code")

    def sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
        chunk, a, b = group["chunk"].to_numpy(), group["pair"][0].as_py() >> 32, group["pair"][0].as_py() & 0xFFFFFFFF
        left = np.flatnonzero(chunk == a)
        return left, left if a == b else np.flatnonzero(chunk == b), a == b

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, order):
            raw = np.frombuffer(b"".join(group["code"].to_pylist()), np.uint8).reshape(group.num_rows, -1)
            codes, near = Codes(raw, group["bucket"][0].as_py() >> 40), np.zeros(group.num_rows, bool)
            left, right, same = sides(group)
            for i, j in hopeful(codes, left, right, threshold):
                apart = i < j if same else slice(None)
                near[i[apart]] = near[j[apart]] = True
            if near.any():
                yield from group.filter(pa.array(near)).select(["bucket", "pair", "cid", "chunk"]).combine_chunks().to_batches()

    dealt = places.repartition(*order).sortWithinPartitions(*order, "cid")
    wanted = written(dealt.mapInArrow(propose, "bucket long, pair long, cid long, chunk long"), "vector-wanted")
    whole = wanted.join(classes.select("cid", "vec", "n"), "cid").repartition(*order).sortWithinPartitions(*order, "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, order):
            bucket = group["bucket"][0].as_py()
            d, t = bucket >> 40, bucket >> 24 & 0xFFFF
            x = unit(flat_rows(group["vec"]))
            keys, codes = keys_for(x, bits, tables), Codes(stored(x, turn(d)), d)
            cid, n = group["cid"].to_numpy(), group["n"].to_numpy()
            left, right, same = sides(group)
            add, root = np.zeros(len(cid)), np.arange(len(cid))
            for i, j in hopeful(codes, left, right, threshold):
                if same:
                    i, j = i[i < j], j[i < j]
                new = ~(keys[i, :t] == keys[j, :t]).any(axis=1)
                i, j = i[new], j[new]
                near = exact(x, i, j, threshold)
                i, j = i[near], j[near]
                add += np.bincount(i, n[j], len(cid)) + np.bincount(j, n[i], len(cid))
                root = forest(np.concatenate((i, np.arange(len(cid)))), np.concatenate((j, root)), len(cid))
            at = np.flatnonzero(add)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(add[at].astype(np.int64)), pa.array(cid[root[at]])], ["cid", "links", "to"])

    found = written(whole.mapInArrow(compare, "cid long, links long, to long"), "vector-links")
    roots = written(components(found.select(F.col("cid").alias("u"), F.col("to").alias("v")), "vector-components"), "vector-roots")
    more = found.groupBy("cid").agg(F.sum("links").alias("more"))
    known = classes.select("h0", "h1", "cid", "rep", "n").join(more, "cid", "left").withColumn("n_links", F.col("n") - 1 + F.coalesce("more", F.lit(0)))
    known = written(known.join(roots, F.col("cid") == F.col("node"), "left").select("h0", "h1", "rep", "n", "n_links", "root"), "vector-known")
    linked = known.where("root is not null")
    least = written(linked.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("_n")), "vector-least")
    columns = ["h0", "h1", "n", "n_links"]
    labels = joined_evenly(linked, least, ["root"], "_n").select(*columns, "least").unionByName(known.where("root is null").select(*columns, F.col("rep").alias("least")))
    rows = written(base.select("id", "h0", "h1"), "vector-rows")
    out = joined_evenly(rows.where("h0 is not null"), written(labels, "vector-labels"), ["h0", "h1"], "n").select("id", "n_links", "least")
    out = out.unionByName(rows.where("h0 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("least")))
    return out.select("id", "n_links", F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP2_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach AS (
  SELECT vec_id AS u, vec_id AS w FROM embeddings
  UNION
  SELECT reach.u, links.w FROM reach JOIN links ON reach.w = links.u
), least AS (
  SELECT u, min(w) AS component_id FROM reach GROUP BY u
), counts AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.u = vec_id LEFT JOIN counts ON counts.u = vec_id
"""
