"""Token ids in grammar-compressed blocks (Re-Pair) with random access.

Documents go in ascending id order into blocks of about ``BLOCK`` ids. In each block the most frequent pairs of
neighbouring symbols are replaced by new symbols (rules), again and again until no pair is left that pays for its rule,
which takes LEAST places (Larsson and Moffat's Re-Pair, in arrays: a round takes many frequent pairs, the more frequent
first where places overlap). Then rules that are used once, or that save nothing, are put back into their places, so
that a rule's right side may be longer than a pair.

A block holds its rules, the length to which each rule expands, its symbols, its documents' lengths, and the number of
ids before every SAMPLE-th symbol, so that any document is decoded from the few symbols that cover it.

Block, all little-endian: magic ``TMR2``, then as 32-bit numbers: bits of a symbol, vocabulary size, rules, runs, symbols
of right sides, symbols, documents, ids; then, 32 bits each, runs of rules (symbols of the right side, expansion length,
number of rules with both; rules are numbered in this order), documents' lengths, sampled offsets; then right sides and
symbols, each packed to whole bytes at the symbol's bits. Symbol ``vocabulary + i`` stands for rule i.

Blocks are binary values of a Parquet table, so they are written and read by Spark on any file system and a lost
executor leaves no half-written file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import pick, table, text_batches, written

BLOCK, LEAST, END, SAMPLE, MAGIC = 1 << 20, 3, 2, 256, b"TMR2"
#: A round takes a BATCH of the pairs that occur LEAST times, FEWEST at least; smaller rounds compress a little more and take longer.
BATCH, FEWEST, SLOTS = 0.2, 1024, 22


@dataclass
class Grammar:
    """Rules, as right sides end to end with their sizes, and the symbols that remain."""

    vocabulary: int
    flat: np.ndarray
    sizes: np.ndarray
    symbols: np.ndarray

    def expand(self, symbols: np.ndarray, only: np.ndarray | None = None, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Symbols with all rules (or those marked in ``only``) put in place; ``owner`` is repeated with its symbol."""
        starts = np.cumsum(self.sizes) - self.sizes
        while True:
            hit = np.flatnonzero(symbols >= self.vocabulary)
            if only is not None:
                hit = hit[only[symbols[hit] - self.vocabulary]]
            if not len(hit):
                return symbols, owner
            rule = symbols[hit] - self.vocabulary
            k, n = self.sizes[rule], np.ones(len(symbols), np.int64)
            n[hit] = k
            first = (np.cumsum(n) - n)[hit]
            inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            symbols = np.repeat(symbols, n)
            symbols[np.repeat(first, k) + inside] = self.flat[np.repeat(starts[rule], k) + inside]
            owner = None if owner is None else np.repeat(owner, n)

    def spelled(self) -> np.ndarray:
        """The ids of the symbols: each rule's expansion is made once, and each symbol's copied from it."""
        rules = np.arange(len(self.sizes), dtype=np.uint32) + self.vocabulary
        flat, owner = self.expand(rules, owner=np.arange(len(rules)))
        k = np.bincount(owner, minlength=len(rules))
        starts, table = np.cumsum(k) - k, np.concatenate((flat, np.arange(self.vocabulary, dtype=np.uint32)))
        hit = self.symbols >= self.vocabulary
        rule = self.symbols[hit] - self.vocabulary
        n, first = np.ones(len(self.symbols), np.int64), self.symbols.astype(np.int64) + len(flat)
        n[hit], first[hit] = k[rule], starts[rule]
        ends = np.cumsum(n)
        return table[np.repeat(first - (ends - n), n) + np.arange(n.sum())]

    def uses(self) -> np.ndarray:
        every = np.concatenate((self.symbols, self.flat))
        return np.bincount(every[every >= self.vocabulary] - self.vocabulary, minlength=len(self.sizes))

    def without(self, drop: np.ndarray) -> Grammar:
        """The grammar with the marked rules put into their places."""
        symbols, _ = self.expand(self.symbols, drop)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        kept = ~drop[owner]
        flat, owner = self.expand(self.flat[kept], drop, owner[kept])
        number = np.cumsum(~drop) - 1
        return Grammar(self.vocabulary, self.renumbered(flat, number), np.bincount(owner, minlength=len(drop))[~drop], self.renumbered(symbols, number))

    def renumbered(self, symbols: np.ndarray, number: np.ndarray) -> np.ndarray:
        out = symbols.copy()
        hit = np.flatnonzero(symbols >= self.vocabulary)
        out[hit] = number[symbols[hit] - self.vocabulary] + self.vocabulary
        return out

    def ordered(self) -> tuple[Grammar, np.ndarray]:
        """The same rules by size and expansion length, and those lengths."""
        _, owner = self.expand(self.flat, owner=np.repeat(np.arange(len(self.sizes)), self.sizes))
        lengths = np.bincount(owner, minlength=len(self.sizes))
        order = np.lexsort((lengths, self.sizes))
        number = np.argsort(order)
        starts, k = (np.cumsum(self.sizes) - self.sizes)[order], self.sizes[order]
        flat = self.flat[np.repeat(starts, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        return Grammar(self.vocabulary, self.renumbered(flat, number), k, self.renumbered(self.symbols, number)), lengths[order]


def second(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Every second place of the runs of overlapping places of one pair."""
    here = np.arange(len(at))
    same = np.zeros(len(at), bool)
    same[1:] = (np.diff(at) == 1) & (rank[1:] == rank[:-1])
    return (here - np.maximum.accumulate(np.where(same, 0, here))) % 2 == 1


def places(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which places of pairs (ascending) to take, so that none overlap and every other place overlaps one of higher rank.

    Pairs of one rank are one pair; of a run of them every second is taken.
    """
    chosen, live = np.zeros(len(at), bool), np.arange(len(at))
    while len(live):
        a, r = at[live], rank[live]
        beside = np.diff(a) == 1
        before, after = np.full(len(a), -1), np.full(len(a), -1)
        before[1:][beside], after[:-1][beside] = r[:-1][beside], r[1:][beside]
        take = ~second(a, r) & (before <= r) & (after <= r)
        chosen[live[take]] = True
        gone = take.copy()
        gone[1:] |= take[:-1] & beside
        gone[:-1] |= take[1:] & beside
        live = live[~gone]
    return chosen


def slot(pairs: np.ndarray, bits: int) -> np.ndarray:
    return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def repair(ids: np.ndarray, vocabulary: int) -> Grammar:
    """Replaces pairs until none occurs LEAST times without overlap.

    A pair's places only become fewer, so a round looks at those alone that had a frequent pair or have a new symbol.
    """
    seq, made = ids.astype(np.uint32), [np.zeros(0, np.uint64)]
    rules, alone = 0, False
    alive = np.ones(len(seq), bool)
    while len(seq) > 1:
        alive[-1] = False
        live = np.flatnonzero(alive)
        pairs = (seq[live].astype(np.uint64) << np.uint64(32)) | seq[live + 1]
        bits = min(SLOTS, len(live).bit_length() + 1)
        slots = slot(pairs, bits)
        # only places whose slot is taken often can hold a pair that is
        crowded = np.bincount(slots, minlength=1 << bits)[slots] >= LEAST
        alive[live[~crowded]] = False
        live, pairs, slots = live[crowded], pairs[crowded], slots[crowded]
        ordered = np.sort(pairs)
        edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, int)
        counts = np.diff(np.append(edges, len(ordered)))
        often = np.flatnonzero(counts >= LEAST)
        most = max(FEWEST, int(len(often) * BATCH))
        if len(often) > most and not alone:
            cut = np.partition(counts[often], len(often) - most)[len(often) - most]
            often = often[counts[often] >= cut]
        top = ordered[edges[often]]
        rank = np.empty(len(top), np.int64)
        rank[np.lexsort((slot(top, 63), counts[often]))] = np.arange(len(top))
        # the pair of each slot; those that share one with another are searched for
        spots, owner = slot(top, bits), np.full(1 << bits, -1, np.int32)
        owner[spots] = np.arange(len(top), dtype=np.int32)
        shared = np.flatnonzero(np.bincount(spots[owner[spots] != np.arange(len(top))], minlength=1 << bits) > 0) if len(top) else spots
        which = owner[slots]
        maybe = np.flatnonzero(which >= 0)
        pairs, which = pairs[maybe], which[maybe].astype(np.int64)
        known = top[which] == pairs
        if len(shared):
            unsure = np.flatnonzero(~known)
            unsure = unsure[np.isin(slots[maybe[unsure]], shared)]
            place = np.searchsorted(top, pairs[unsure])
            place[place == len(top)] = 0
            hit = top[place] == pairs[unsure]
            known[unsure[hit]], which[unsure[hit]] = True, place[hit]
        at, which = live[maybe[known]], which[known]
        if alone:  # pairs kept one another from paying: take some of which no two share a symbol
            good = np.flatnonzero(np.bincount(which[~second(at, which)], minlength=len(top)) >= LEAST)
            if not len(good):
                break
            good = good[np.argsort(-rank[good])]
            both = np.stack((top[good] >> np.uint64(32), top[good] & np.uint64(0xFFFFFFFF)), axis=1).ravel()
            first = np.zeros(len(both), bool)
            first[np.unique(both, return_index=True)[1]] = True
            apart = first.reshape(-1, 2).all(axis=1) | ((both[::2] == both[1::2]) & first[::2])
            keep = np.isin(which, good[apart])
            at, which = at[keep], which[keep]
        taken = places(at, rank[which])
        at, which = at[taken], which[taken]
        pays = np.bincount(which, minlength=len(top)) >= LEAST
        if not pays.any():
            if alone:
                break
            alone = True
            continue
        alone = False
        number = np.cumsum(pays) - 1 + vocabulary + rules
        at, which = at[pays[which]], which[pays[which]]
        seq[at] = number[which]
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        seq, alive = seq[kept], alive[kept]
        at -= np.arange(len(at))  # as many symbols went before each place
        alive[at] = alive[np.maximum(at - 1, 0)] = True
        made.append(top[pays])
        rules += int(pays.sum())
    both = np.concatenate(made)
    flat = np.stack((both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)), axis=1).ravel().astype(np.uint32)
    return Grammar(vocabulary, flat, np.full(rules, 2), seq)


def compress(ids: np.ndarray, vocabulary: int) -> Grammar:
    """A grammar of the ids in which every rule saves more symbols than its right side has."""
    found = repair(ids, vocabulary)
    found = found.without(found.uses() <= 1)
    return found.without(found.uses() * (found.sizes - 1) <= found.sizes)


def packed(symbols: np.ndarray, bits: int) -> bytes:
    columns = np.unpackbits(symbols.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(columns.ravel(), bitorder="little").tobytes()


def unpacked(data: memoryview, bits: int, start: int, end: int) -> np.ndarray:
    """Symbols from start up to end of packed data."""
    first = start * bits // 8
    raw = np.unpackbits(np.frombuffer(data[first : -(-end * bits // 8)], np.uint8), bitorder="little")
    columns = np.zeros((end - start, 32), np.uint8)
    columns[:, :bits] = raw[start * bits - 8 * first :][: (end - start) * bits].reshape(-1, bits)
    return np.packbits(columns.ravel(), bitorder="little").view("<u4").astype(np.uint32)


def pack(docs: list[np.ndarray], vocabulary: int) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    grammar, lengths = compress(ids, vocabulary).ordered()
    bits = max(1, (vocabulary + len(grammar.sizes) - 1).bit_length())
    kinds = np.stack((grammar.sizes, lengths), axis=1).astype(np.int64)
    edges = np.flatnonzero(np.concatenate(([True], (kinds[1:] != kinds[:-1]).any(axis=1)))) if len(kinds) else np.zeros(0, int)
    runs = np.column_stack((kinds[edges], np.diff(np.append(edges, len(kinds)))))
    wide = np.ones(len(grammar.symbols), np.int64)
    hit = np.flatnonzero(grammar.symbols >= vocabulary)
    wide[hit] = lengths[grammar.symbols[hit] - vocabulary]
    offsets = (np.cumsum(wide) - wide)[::SAMPLE]
    head = [bits, vocabulary, len(grammar.sizes), len(runs), len(grammar.flat), len(grammar.symbols), len(docs), len(ids)]
    numbers = np.concatenate([np.array(x).ravel() for x in (head, runs, [len(d) for d in docs], offsets)]).astype("<u4")
    return MAGIC + numbers.tobytes() + packed(grammar.flat, bits) + packed(grammar.symbols, bits)


class Block:
    """Reads a packed block: all ids, or those of one document."""

    def __init__(self, data: bytes):
        data = memoryview(data)
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a block of token ids")
        self.bits, self.vocabulary, _, runs, flat, self.count, docs, self.n = np.frombuffer(data, "<u4", 8, 4).tolist()
        at = 36
        sizes, lengths, many = np.frombuffer(data, "<u4", 3 * runs, at).astype(np.int64).reshape(-1, 3).T
        self.sizes = np.frombuffer(data, "<u4", docs, at := at + 12 * runs).astype(np.int64)
        samples = -(-self.count // SAMPLE)
        self.offsets = np.frombuffer(data, "<u4", samples, at := at + 4 * docs)
        right = data[at + 4 * samples :]
        self.data, self.lengths = right[-(-flat * self.bits // 8) :], np.repeat(lengths, many)
        self.grammar = Grammar(self.vocabulary, unpacked(right, self.bits, 0, flat), np.repeat(sizes, many), np.zeros(0, np.uint32))

    def ids(self) -> np.ndarray:
        grammar = self.grammar
        return Grammar(grammar.vocabulary, grammar.flat, grammar.sizes, unpacked(self.data, self.bits, 0, self.count)).spelled()

    def document(self, i: int) -> np.ndarray:
        """Ids of one document: unpacks and expands only the symbols between the samples around it."""
        start = int(self.sizes[:i].sum())
        end = start + int(self.sizes[i])
        if start == end:
            return np.zeros(0, np.uint32)
        low, high = np.searchsorted(self.offsets, [start, end - 1], side="right")
        symbols = unpacked(self.data, self.bits, (low - 1) * SAMPLE, min(high * SAMPLE, self.count))
        wide = np.ones(len(symbols), np.int64)
        hit = np.flatnonzero(symbols >= self.vocabulary)
        wide[hit] = self.lengths[symbols[hit] - self.vocabulary]
        ends = np.cumsum(wide) + int(self.offsets[low - 1])
        a, b = np.searchsorted(ends, [start, end - 1], side="right")
        skip = start - int(ends[a] - wide[a])
        return self.grammar.expand(symbols[a : b + 1])[0][skip : skip + end - start]


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, end: int = END) -> DataFrame:
    """(part, block, n_tokens, data, doc_ids): blocks of the documents in ascending id order (nulls first).

    Null texts count as empty, an end id alone. Rows of equal ids stay in the order in which the input has them, and are
    dealt out like others. A text longer than a block is a block of its own; one beyond 2 GB fits no row. An empty table
    gives no blocks.
    """
    text_batches(docs.sparkSession, 2048)  # chunks that texts of a batch share are looked up once
    where = path or tokens.vocabulary("word_bpe_49k.json")
    kept = pick(docs, id=id_col, text=text_col).withColumn("_tie", F.monotonically_increasing_id())
    kept = kept.repartitionByRange("id", "_tie").sortWithinPartitions("id", "_tie").drop("_tie")
    id_kind = dict(kept.dtypes)["id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.word_encoder(where), TaskContext.get().partitionId()
        ids, docs, size, number, id_type = [], [], 0, 0, None

        def row() -> pa.RecordBatch:
            arrays = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([pack(docs, encoder.size)], pa.binary()), pa.array([ids], pa.list_(id_type))]
            return pa.RecordBatch.from_arrays(arrays, ["part", "block", "n_tokens", "data", "doc_ids"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i, doc in zip(batch["id"].to_pylist(), encoder(batch["text"])):
                ids.append(i)
                docs.append(np.append(doc, np.uint32(end)))
                size += len(doc) + 1
                if size >= block:
                    yield row()
                    ids, docs, size, number = [], [], 0, number + 1
        if docs:
            yield row()

    return kept.mapInArrow(encode, f"part int, block int, n_tokens long, data binary, doc_ids array<{id_kind}>")


def read_back(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, decoded from the blocks; without blocks, no rows."""
    id_kind = dict(files.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data, ids in zip(batch["part"].to_pylist(), batch["block"].to_pylist(), batch["data"], batch["doc_ids"]):
                block = Block(data.as_buffer())
                flat, sizes = block.ids().astype("<u4"), block.sizes.astype(np.int64)
                starts, raw = np.cumsum(sizes) - sizes, memoryview(flat).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), sizes.tolist())]
                arrays = [pa.array(np.full(len(sizes), part), pa.int32()), pa.array(np.full(len(sizes), number), pa.int32()), ids.values, pa.array(starts), pa.array(sizes), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "block", "id", "local", "n_tokens", "ids_crc32"])

    docs = files.select("part", "block", "data", "doc_ids").mapInArrow(decode, f"part int, block int, id {id_kind}, local long, n_tokens long, ids_crc32 long")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = files.select("part", "block", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("inside"))
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # one row for each partition
    outside = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outside"))
    offsets = inside.join(F.broadcast(outside), "part").select("part", "block", (F.col("inside") + F.col("outside")).alias("offset"))
    return docs.join(offsets, ["part", "block"]).select("id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty, an end id alone; null ids come first; repeated rows stay; an empty table has no rows."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")  # rows of the blocks' table are large
    return read_back(written(encoded(table(spark, sf_dir, "documents")), "token-blocks")).withColumnRenamed("id", "doc_id")
