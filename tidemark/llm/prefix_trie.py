"""The trie of all conversations' prefixes, from sorted arrays of turns.

A turn is known by the SHA-256 of its role and text, a conversation by the concatenated digests of its turns, so that a
prefix sorts right before all that it begins. All conversations are range-sorted by these arrays, then by id. Each task sweeps its
range with a stack of the open prefixes: the longest common prefix of neighbours says which intervals close and
open. An interval that closes inside a range is a whole node. Those on the path of a range's first or last array may go on
in the ranges beside it; they are handed on as partial nodes, and one more sweep over these, range by range, stitches them
with one stack. It sees two paths a range, never the conversations.

Ids that end at a node stand side by side. Where they reach a range's edge, their digest is taken by a further task, from
pieces of text in order; it streams them and holds one piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, joined_evenly, pick, table, written

DIGEST, ID, PIECE, ROWS = 32, 16, 1 << 20, 4096
FAMILY, HEADS = 100, 6
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "id binary, parent binary, depth long, conv long, n_convs long, n_children long, n_leaves long, saved long, ends string"
PART = "part long, edge long, through boolean, size long, seq long, piece binary"


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turns: each conversation's turns in order, as structs of digest (hexadecimal) and size (code points).

    Turns stand by turn number, null first; equal numbers by role, then digest. Null role and text are empty. Repeated
    rows are turns of their own; rows without a conversation's id are left out. A conversation's digests fit in one row.
    """
    base = pick(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null")
    base = base.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")})
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest")
    turn = F.struct("turn", "role", digest, F.length("text").alias("size"))
    grouped = base.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(F.col("conv").cast("long").alias("conv"), F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("turns"))


def with_shared_heads(found: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % family; h = crc32(c) % heads.

    At most ``family`` conversations look up one head, of fewer than ``heads`` turns.
    """
    head = found.where(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    own = found.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % family}).join(head, "base", "left")
    first = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.select("conv", F.concat(first, rest).alias("turns"))


@dataclass(slots=True)
class Node:
    id: bytes
    parent: bytes | None
    depth: int
    size: int = 0  # code points of the last text
    first: bool = False  # on the path of the range's first array
    conv: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    run: list[int] = field(default_factory=list)

    def closed(self, above: Node | None) -> tuple:
        """The whole node's row; adds it to the node above."""
        leaves, saved = self.leaves if self.children else 1, self.saved + (self.n - 1) * self.size
        if above:
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
        return self.id, self.parent, self.depth, self.conv, self.n, self.children, leaves, saved, self.ends

    def partial(self) -> tuple:
        return self.id, self.parent, self.depth, self.conv, self.n, self.children, self.leaves, self.saved, self.ends

    def counted(self, n: int, conv: int) -> None:
        self.n, self.conv = self.n + n, conv if self.conv is None else min(self.conv, conv)


def batches_of(rows: Iterable[tuple], kinds: str) -> Iterator[pa.RecordBatch]:
    types = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in kinds.split(", "))])
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def common(a: bytes, b: bytes) -> int:
    """Number of leading turns that two arrays share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    return next(d for d in range(0, n, DIGEST) if a[d : d + DIGEST] != b[d : d + DIGEST]) // DIGEST


def sweep(rows: Iterable[tuple[bytes, list[int], int]], part: int) -> Iterator[tuple]:
    """Rows (array, sizes, conversation) in order to whole nodes (edge 0), partial ones (1: first path, 2: last) and pieces (3)."""
    whole, edge = (part, 0, None, None, None, None), None
    stack = [Node(b"", None, 0, first=True)]
    before: bytes | None = None
    opening = True  # the present run of ends began with the range's first array

    def end_run(last: bool) -> Iterator[tuple]:
        nonlocal opening
        top = stack[-1]
        if not top.run:
            return
        if not (opening or last):
            top.ends = hashlib.sha256(",".join(map(str, top.run)).encode()).hexdigest()
        else:
            text = ",".join(map(str, top.run)).encode()
            for seq, at in enumerate(range(0, len(text), PIECE)):
                yield (top.id, None, top.depth, None, None, None, None, None, None, part, 3, None, None, seq, text[at : at + PIECE])
        top.run, opening = [], False

    for key, sizes, conv in rows:
        if before is not None and key != before:
            yield from end_run(False)
            keep = common(before, key)
            while len(stack) - 1 > keep:
                node = stack.pop()
                stack[-1].counted(node.n, node.conv)
                yield (*node.partial(), part, 1, False, node.size, None, None) if node.first else node.closed(stack[-1]) + whole
        for d in range(len(stack) - 1, len(key) // DIGEST):
            above = stack[-1]
            name = hashlib.sha256(above.id + key[d * DIGEST : (d + 1) * DIGEST]).digest()[:ID]
            stack.append(Node(name, above.id, d + 1, sizes[d], before is None))
        stack[-1].counted(1, conv)
        stack[-1].run.append(conv)
        before = key
    if before is None:
        return
    yield from end_run(True)
    while stack:
        node = stack.pop()
        if stack:
            stack[-1].counted(node.n, node.conv)
        edge = 1 if node.first else 2
        yield (*node.partial(), part, edge, node.first, node.size, None, None)


def stitch(partial: Iterable[dict]) -> Iterator[tuple]:
    """Whole nodes from the ranges' partial ones, which come by range, then first and last path, then depth."""
    stack: list[Node] = []

    def close(keep: int) -> Iterator[tuple]:
        while len(stack) > keep:
            node = stack.pop()
            yield node.closed(stack[-1] if stack else None)

    for _, rows in groupby(partial, lambda r: r["part"]):
        first, last, through, meet = [], [], 0, True
        for r in rows:
            node = Node(r["id"], r["parent"], r["depth"], r["size"], False, r["conv"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved"], r["ends"])
            (first if r["edge"] == 1 else last).append(node)
            through += r["edge"] == 1 and r["through"]
        same = 0
        while same < min(len(stack), len(first)) and stack[same].id == first[same].id:
            same += 1
        yield from close(same)
        for old, new in zip(stack, first):
            old.counted(new.n, new.conv)
            old.children, old.leaves, old.saved, old.ends = old.children + new.children, old.leaves + new.leaves, old.saved + new.saved, old.ends or new.ends
        stack += first[same:]
        yield from close(through)
        stack += last
    yield from close(0)


def streamed_digests(rows: Iterable[dict]) -> Iterator[tuple]:
    """id, digest of each id's pieces, which come in order; texts of different ranges are joined by a comma."""
    for node, pieces in groupby(rows, lambda r: r["id"]):
        digest = hashlib.sha256()
        for i, r in enumerate(pieces):
            digest.update((b"," if i and not r["seq"] else b"") + r["piece"])
        yield node, digest.hexdigest()


def trie(found: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``found`` has conv and turns (structs of digest and size), a row for each conversation, in any order; conversations without turns end at
    the root. Any number of equal conversations may be spread over any number of ranges. Without conversations there is
    no node.
    """
    spark = found.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("key")
    arrays = written(found.select(key, F.transform("turns", lambda x: x["size"].cast("long")).alias("sizes"), "conv"), "trie-arrays")

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(b["key"].to_pylist(), b["sizes"].to_pylist(), b["conv"].to_pylist()))
        return batches_of(sweep(rows, TaskContext.get().partitionId()), f"{NODE}, {PART}")

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(stitch(r for b in batches for r in b.to_pylist()), NODE)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(streamed_digests(r for b in batches for r in b.to_pylist()), "id binary, digest string")

    with arrow_batches(spark, 1024):
        every = written(arrays.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(swept, f"{NODE}, {PART}"), "trie-swept")
        names = [c.split()[0] for c in NODE.split(", ")]
        paths = every.where(F.col("edge").isin(1, 2)).repartition(1).sortWithinPartitions("part", "edge", "depth").mapInArrow(stitched, NODE)
        pieces = every.where("edge = 3").select("id", "part", "seq", "piece").repartition("id").sortWithinPartitions("id", "part", "seq")
        pieces = pieces.mapInArrow(digests, "id binary, digest string")
        paths = paths.join(pieces, "id", "left").withColumn("ends", F.coalesce("ends", "digest")).select(*names)
        nodes = written(every.where("edge = 0").select(*names).unionByName(paths), "trie-nodes")
    above = nodes.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    root = nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = joined_evenly(nodes.where("parent is not null"), above, ["parent"], "_n").unionByName(root)
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(with_shared_heads(written(sequences(table(spark, sf_dir, "conversations")), "trie-turns")))


OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, r, sha256(concat(length(r), ':', r, t))) AS seq
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
), heads AS (
  SELECT *, (xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: xor(c >> 1, 3988292384::UBIGINT * (c & 1)))
  )) % {HEADS})::BIGINT AS h FROM turns
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.seq[1:c.h], []), c.seq[c.h + 1:]) AS seq
  FROM heads c LEFT JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}
), nodes AS (
  SELECT seq[1:d] AS prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(seq) = d), '') AS ends
  FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM rebuilt) GROUP BY ALL
), parents AS (
  SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), every AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN parents USING (prefix)
), below AS (
  SELECT prefix[1:a] AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(CASE WHEN depth > 0 THEN (n_convs - 1) * length(prefix[depth].t) ELSE 0 END) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM every) GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM every n JOIN below USING (prefix) LEFT JOIN every p ON p.prefix = n.prefix[1:n.depth - 1] AND n.depth > 0
"""
