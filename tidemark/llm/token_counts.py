"""Token counts from flat, unindexed token files by a separator scan.

A token file is a run of 16- or 32-bit ids with an end-of-document id after each document and nothing else. It is
searched as blocks of fixed length, cut without regard to documents: those of flat binary files (``flat_files``), or rows
of a Parquet table that ``token_files`` writes on any file system that Spark reads. The scan searches each block for end
ids in one vector operation. A prefix scan over the blocks' lengths, numbers of ends and last ends (one row of four
numbers for each block) stitches documents across blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import pick, table, text_batches, written

BLOCK, IDS, END = 1 << 18, 1 << 14, 50256
MOST_FILE = 1 << 30  # bytes of a flat file, which one row holds while it is cut
KINDS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}
FILE = "file int, block int, data binary, doc_ids array<{}>"


def token_files(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, end: int = END, width: int = 2) -> DataFrame:
    """One file for each partition of the input, as blocks, and its documents' ids in order, in rows of their own.

    Null texts count as empty: they are an end id alone. A vocabulary with ids that do not fit the width, or with the end
    id among those of texts, raises ValueError.
    """
    text_batches(docs.sparkSession)
    where = path or tokens.vocabulary("byte_bpe_50k.tiktoken")
    known = tokens.byte_ids(where)
    if max(end, int(known.max())) >= 1 << 8 * width:
        raise ValueError(f"ids up to {max(end, int(known.max()))} do not fit {width} bytes")
    if end in known:
        raise ValueError(f"the end id {end} is an id of the vocabulary")
    kept = pick(docs, id=id_col, text=text_col)
    schema = FILE.format(dict(kept.dtypes)["id"])
    kind = KINDS[width]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = tokens.byte_encoder(where), TaskContext.get().partitionId()
        waiting: list[np.ndarray] = []
        size = blocks = lists = 0
        ids: list = []
        id_type = None

        def row(number: int, data: bytes | None, some: list | None) -> pa.RecordBatch:
            arrays = [pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([data], pa.binary()), pa.array([some], pa.list_(id_type))]
            return pa.RecordBatch.from_arrays(arrays, ["file", "block", "data", "doc_ids"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                waiting += [encoder(text or "").astype(kind), np.array([end], kind)]
                size += len(waiting[-2]) + 1
                ids.append(i)
                if size >= block:
                    flat = np.concatenate(waiting)
                    for at in range(0, size - size % block, block):
                        yield row(blocks, flat[at : at + block].tobytes(), None)
                        blocks += 1
                    waiting, size = [flat[size - size % block :]], size % block
                if len(ids) >= IDS:
                    yield row(lists, None, ids)
                    lists, ids = lists + 1, []
        if size:
            yield row(blocks, np.concatenate(waiting).tobytes(), None)
        if ids:
            yield row(lists, None, ids)

    return kept.mapInArrow(encode, schema)


def flat_files(spark: SparkSession, path: str, block: int = BLOCK, width: int = 2) -> DataFrame:
    """(file, block, data) of the flat binary files at a path: blocks of ``block`` ids, the last one of a file shorter.

    Files above MOST_FILE bytes and files that end within an id raise ValueError in their task.
    """
    text_batches(spark, 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                raw, size = data.as_buffer(), block * width
                if raw.size > MOST_FILE or raw.size % width:
                    raise ValueError(f"{name} has {raw.size} bytes: more than {MOST_FILE}, or no whole ids")
                for at in range(0, raw.size, size):
                    piece = raw[at : at + size].to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([at // size], pa.int32()), pa.array([piece], pa.binary())], ["file", "block", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, block int, data binary")


def scan(files: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """(file, number, start, n_tokens) of each document in the files; n_tokens is without the end id.

    Ids after a file's last end id are no document. Without blocks the result is empty.
    """
    kind, file = KINDS[width], dict(files.dtypes)["file"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for data in batch["data"]:
                ids = np.frombuffer(data.as_buffer(), kind)
                found.append(np.flatnonzero(ids == end))
                sizes.append(len(ids))
            arrays = [batch["file"], batch["block"], pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "block", "n", "ends"])

    blocks = files.where("data is not null").select("file", "block", "data").mapInArrow(search, f"file {file}, block int, n long, ends array<long>")
    blocks = written(blocks, "token-ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    small = blocks.select("file", "block", "n", F.size("ends").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    small = small.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    carried = F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(-1))
    small = small.select("file", "block", "start", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"), carried.alias("carried"))
    docs = blocks.select("file", "block", F.explode(F.arrays_zip(F.col("ends").alias("at"), F.array_prepend(F.col("ends"), F.lit(None).cast("long")).alias("prior"), F.sequence(F.lit(0), F.size("ends")).alias("i"))).alias("d"))
    docs = docs.where("d.at is not null").join(small, ["file", "block"])
    last = F.when(F.col("d.i") == 0, F.col("carried")).otherwise(F.col("start") + F.col("d.prior"))
    return docs.select("file", (F.col("first") + F.col("d.i")).alias("number"), (last + 1).alias("start"), (F.col("start") + F.col("d.at") - last - 1).alias("n_tokens"))


def count_tokens(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, end: int = END, width: int = 2,
) -> DataFrame:
    """One row for each input row: id, file, start (in its file), n_tokens, read from written token files.

    Null texts have no tokens; null ids and repeated rows stay; texts may be longer than a block. Vocabularies that do
    not fit the width or hold the end id raise ValueError. An empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")  # rows of this table are large
    files = written(token_files(docs, path, id_col, text_col, block, end, width), "token-files")
    names = files.where("doc_ids is not null").select("file", (F.col("block").cast("long") * IDS).alias("first"), F.posexplode("doc_ids").alias("i", "id"))
    names = names.select("file", (F.col("first") + F.col("i")).alias("number"), "id")
    return scan(files, end, width).join(names, ["file", "number"]).select("id", "file", "start", "n_tokens")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
