"""What the operators of this subpackage share: columns, shared storage, row numbers, components.

Inputs are addressed by exact column name. Every operator takes the columns it needs with ``pick`` and
returns its key and result columns only, so further input columns, also ones whose names clash with a
result or differ from an input in case only, neither disturb it nor reach its result.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by exact name, as result=input; a missing input column raises ValueError."""
    names = df.columns
    if missing := [c for c in columns.values() if c not in names]:
        raise ValueError(f"missing columns {missing}; there are {names}")
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(c)}").alias(new) for new, c in columns.items()])


#: A sieve has SPARSE bits a key at least unless told otherwise, and 2^SIEVE at most, in maps of 4 KiB: up to 16 MB on each executor.
SIEVE, SPARSE = 27, 1024

#: Keys with over one row in HOT, and over FEW rows, are joined by broadcast; there are fewer than HOT of them, whatever the data.
HOT, FEW, LINKS = 1000, 256, 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local session makes one, as in tests; a cluster's raises ValueError."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Frees the files of tables that ``written`` made and that nothing reads any more; an empty table stays in each one's place."""
    for t in tables:
        if files := t.inputFiles():
            t.sparkSession.createDataFrame([], t.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def text_batches(spark: SparkSession, rows: int = 256, size: int = 1 << 24) -> None:
    """Prepares Python stages over texts: ships this package, and ends Arrow batches at ``rows`` rows or ``size`` bytes.

    Both are options of the session and stay set, as Spark reads them when a result is computed, not when it is declared.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int = 256, size: int = 1 << 24) -> Iterator[None]:
    """As ``text_batches``, for results that are computed inside the block; puts the session's options back."""
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    old = [spark.conf.get(n) for n in names]
    text_batches(spark, rows, size)
    try:
        yield
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)


def joined_evenly(rows: DataFrame, labels: DataFrame, on: list[str], n: str, total: int | None = None, few: int = FEW) -> DataFrame:
    """Inner join of rows to labels, whose keys ``on`` are unique and without nulls; ``n`` is the key's number of rows.

    Keys that hold more than one in HOT of all rows (and more than ``few``) are fewer than HOT: their labels are broadcast, so that their rows
    stay where they are. No other key can fill a task. Both tables are read twice and should be cheap to read; ``total``
    is the number of rows, counted from the labels if it is not given.
    """
    if total is None:
        total = labels.agg(F.sum(n)).first()[0] or 0
    if total <= few:
        return rows.join(labels.drop(n), on)
    most = max(few, total / HOT)
    hot = F.broadcast(labels.where(F.col(n) > most).drop(n))
    cold = rows.join(hot.select(*on), on, "left_anti").join(labels.where(F.col(n) <= most).drop(n), on)
    return rows.join(hot, on).unionByName(cold)


def sieved(rows: DataFrame, keys: DataFrame, on: str, sparse: int = SPARSE) -> DataFrame:
    """The rows whose 64-bit hash in ``on`` is among the keys', and some others: those that agree with a key in their low bits.

    For use before a join that drops the others, so that most rows without a partner are never shuffled. Nulls go. Broadcast
    are the bits alone, ``sparse`` a key (about one in as many other rows passes), so that few keys take little of the driver's memory;
    far more keys than bits let all rows pass. The keys are read twice and should be cheap to read.
    """
    bits = min(SIEVE, max(15, (keys.count() * sparse - 1).bit_length()))

    def spot(df: DataFrame) -> DataFrame:
        low = F.col(on).bitwiseAND((1 << bits) - 1)
        return df.withColumns({"_map": F.bitmap_bucket_number(low), "_bit": F.bitmap_bit_position(low).cast("int")})

    # dealt by map first, or each task would send 4 KiB for every map that it has a key of
    maps = spot(keys.select(on)).repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = spot(rows).join(F.broadcast(written(maps, "sieve")), "_map")
    return found.where(F.call_function("shiftright", byte, F.col("_bit") % 8).bitwiseAND(1) == 1).select(*rows.columns)


def row_numbers(df: DataFrame, order: list[str], label: str, name: str = "row", within: str | None = None) -> DataFrame:
    """Adds gapless numbers from 0 in the given order (nulls first), over all rows or within a column's values.

    A range exchange deals the rows out in order; each number is its partition's offset plus the place inside
    the partition, so that no task ever holds all rows, all rows of one value or all rows with equal keys (which keep
    the order in which the input has them). The dealt rows are written first, as range bounds come from a sample and may differ from run to run. The offsets sent to all executors are
    one row for each partition, and for each value of ``within``, whose number the caller must have bounded.
    """
    keys = ([within] if within else []) + order
    place = F.monotonically_increasing_id()
    dealt = df.withColumn("_tie", place).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    dealt = written(dealt.withColumns({"_part": F.shiftright(place, 33).cast("int"), "_place": place.bitwiseAND((1 << 33) - 1)}), label)
    by = ["_part"] + ([within] if within else [])
    parts = dealt.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = (Window.partitionBy(within) if within else Window).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    same = F.col("d._part") == F.col("p._part")
    if within:
        same = same & F.col(f"d.{within}").eqNullSafe(F.col(f"p.{within}"))
    joined = dealt.alias("d").join(F.broadcast(parts.alias("p")), same)
    return joined.select(*[F.col(f"d.{c}") for c in df.columns], (F.col("d._place") + F.col("p._offset")).alias(name))


def _edges(df: DataFrame, u: Column, v: Column) -> DataFrame:
    return df.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for each node of the links (u, v): root is the smallest node that can be reached.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): links are only re-hung on smaller
    nodes, so their number never grows, and rounds grow with the logarithm of the component's size. Each
    round's links are a written table; only a count and a checksum come to the driver. Nodes with a large share
    of all links, such as a large component's root, are joined without gathering their links in one task.
    """
    now = written(_edges(edges, F.col("u"), F.col("v")), label)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    state = mark(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_n"))
        large = joined_evenly(both, least, ["u"], "_n", 2 * state[0], LINKS).where("v > u")
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = joined_evenly(large, least, ["u"], "_n", 2 * state[0], LINKS)
        hung = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = written(_edges(hung, F.col("u"), F.col("v")), label)
        if (new := mark(now)) == state:
            break
        state = new
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
