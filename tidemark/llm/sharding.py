"""Sharding by a Feistel permutation with cycle walking over global row numbers (DataFrame functions only).

Row r of N goes to place P(r), where P permutes 0..N-1 and depends on N and the seed alone; shard and slot are
P(r) mod shards and P(r) div shards. Shards differ by one row at most, slots are gapless, and the place of any
row can be computed, and inverted, without a shuffle of the others.

P is an alternating Feistel network over pairs (left < a, right < b), with a*b just above N (Black and Rogaway,
2002). Places beyond N are walked on: P is applied again until the place is below N. Fewer than a = ceil(sqrt(N))
places lie beyond N, so a walk ends after a steps at most, and for large N hardly ever takes a second one.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pick, row_numbers, table, written

ROUNDS, SEED, SHARDS = 8, 2024, 24
P, Q = 2147483647, 2147483629  # primes; products of two smaller numbers stay below 2^62
WALK = 64


def constants(seed: int = SEED, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    draw = random.Random(seed)
    return [(draw.randrange(1 << 29, P), draw.randrange(P), draw.randrange(1 << 29, Q)) for _ in range(rounds)]


def sides(n: int) -> tuple[int, int]:
    """a and b with a*b >= n and a*b - n < a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permute_once(x: str, n: int, seed: int = SEED) -> str:
    """SQL of the network applied to the SQL expression x, a bigint: a fold over the rounds, so its size does not grow with them."""
    a, b = sides(n)
    rounds = ", ".join(f"named_struct('i', {i % 2}, 'm', {m}L, 'c', {c}L, 'k', {k}L)" for i, (m, c, k) in enumerate(constants(seed)))
    mixed = f"((IF(k.i = 0, s.r, s.l) * k.m + k.c) % {P}L * k.k) % {Q}L"
    step = f"IF(k.i = 0, named_struct('l', (s.l + {mixed}) % {a}L, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {mixed}) % {b}L))"
    return f"aggregate(array({rounds}), named_struct('l', {x} div {b}L, 'r', {x} % {b}L), (s, k) -> {step}, s -> s.l * {b}L + s.r)"


def permuted(row: str, n: int, seed: int = SEED) -> Column:
    """P of the column ``row``, which holds 0..n-1."""
    n = max(n, 1)
    a, _ = sides(n)
    step = f"CASE WHEN _at < {n}L THEN _at ELSE {permute_once('_at', n, seed)} END"
    walk = f"aggregate(sequence(1, {min(a, WALK)}), _first, (_at, _) -> {step})"
    # where a > 64, under n^-1/2 of the places lie beyond n, and a walk of over 64 steps has a chance below n * n^-32
    ended = f"transform(array({walk}), w -> CASE WHEN w < {n}L THEN w ELSE raise_error('cycle walk did not end') END)[0]"
    return F.expr(f"transform(array({permute_once(row, n, seed)}), _first -> CASE WHEN _first < {n}L THEN _first ELSE {ended} END)[0]")


def inverse(y: int, n: int, seed: int = SEED) -> int:
    """The row number whose place is y."""
    a, b = sides(n)
    while True:
        left, right = divmod(y, b)
        for i, (m, c, k) in reversed(list(enumerate(constants(seed)))):
            if i % 2 == 0:
                left = (left - (right * m + c) % P * k % Q) % a
            else:
                right = (right - (left * m + c) % P * k % Q) % b
        y = left * b + right
        if y < n:
            return y


def described(text: Column) -> list[Column]:
    """size (UTF-8 bytes plus 8; null: 8) and text_crc32 (null: of the empty text)."""
    return [
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    ]


def placed(place: str, shards: int) -> list[Column]:
    """law, shard, slot and grown_shard of the column that holds the row's place."""
    return [
        F.lit("rows").alias("law"), (F.col(place) % shards).cast("int").alias("shard"),
        F.expr(f"{place} div {shards}L").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    ]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row for each input row: id, size, text_crc32, law 'rows', shard, slot, grown_shard (null).

    Global row numbers follow the id, then two hashes of the text (nulls first); repeated rows get numbers of their own
    and are exchangeable. Null texts: size 8, crc32 of the empty text. Texts of any length never move, only their sizes
    and hashes do. An empty table gives an empty result.
    """
    rows = pick(docs, id=id_col, text=text_col).select("id", *described(F.col("text")), F.xxhash64("text").alias("text_hash"))
    rows = row_numbers(rows, ["id", "text_hash"], "shard-rows")
    rows = written(rows, "shard-numbered")
    place = rows.select("id", "size", "text_crc32", permuted("row", rows.count(), seed).alias("_place"))
    return place.select("id", "size", "text_crc32", *placed("_place", shards))


def shard_numbered(docs: DataFrame, row_col: str, shards: int = SHARDS, text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The rows, with all their columns but ``row_col``, and size, text_crc32, law, shard, slot, grown_shard.

    ``row_col`` holds gapless row numbers from 0 (else ValueError), so that a row's place follows without a shuffle.
    Columns of the new names are replaced. Null texts: size 8, crc32 of the empty text. Repeated rows have numbers, and
    so places, of their own. An empty table gives an empty result.
    """
    names = [f"x{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    row, text = (names[docs.columns.index(c)] for c in (row_col, text_col))
    n, least, most, total = plain.agg(F.count(row), F.min(row), F.max(row), F.count("*")).first()
    if n != total or (n and (least, most) != (0, n - 1)):
        raise ValueError(f"{row_col} holds no gapless numbers from 0")
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rest = [F.col(x).alias(c) for x, c in zip(names, docs.columns) if c not in (*new, row_col)]
    return plain.withColumn("_place", permuted(row, n, seed)).select(*rest, *described(F.col(text)), *placed("_place", shards))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
