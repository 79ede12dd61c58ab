"""Benchmark decontamination: a BM25 index of test items, queried by every training passage with block-max WAND.

The items are the indexed side. Each posting holds a term's BM25 impact divided by the item's score for itself, so
that a passage holding all of an item's words scores 1. Postings are ordered by item and carry block maxima. Each
document is cut into overlapping passages, twice the longest item's words long, so that every item lies whole in
some passage. Block maxima of aligned ranges of items first bound all passages of a document at once, in arrays; for
those whose bound reaches ``least``, block-max WAND gives all items that score ``least`` or more. A found item counts
if its five-word shingles are in the passage: in all at least ``overlap``, and of its question (first half) and its
answer (second half) at least half each.

The index goes to all workers; its size is checked before anything is collected: items of more than ``MOST_WORDS`` words
raise a ValueError. Building takes about 400 bytes a word on the driver, 200 of which stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pick, table, text_batches

WORD = re.compile(r"\w+")
K1, B, BLOCK, RANGE, SHINGLE = 1.2, 0.75, 16, 2, 5
LEAST_SCORE, OVERLAP, HALF, MOST_WORDS, SLAB = 0.5, 0.8, 0.5, 1_000_000, 512


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    """All runs of ``size`` words, or the whole sequence where it is shorter."""
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@dataclass
class Index:
    ids: list[int]
    words: list[list[str]]
    terms: dict[str, int]
    postings: list[tuple[list[int], list[float]]]  # items and impacts of each term
    blocks: list[list[tuple[int, float]]]  # of each term: a block's last item and largest impact
    upper: list[float]  # largest impact of each term
    range_starts: np.ndarray  # of each term in the next two
    ranges: np.ndarray  # ranges of RANGE neighbouring items that hold the term
    range_max: np.ndarray  # the term's largest impact in the range
    window: int

    @classmethod
    def build(cls, items: list[tuple[int, str | None]]) -> Index:
        items = sorted((i, w) for i, t in items if i is not None and (w := words_of(t)))
        if sum(len(w) for _, w in items) > MOST_WORDS:
            raise ValueError(f"the test items have more than {MOST_WORDS} words")
        found: dict[str, list[tuple[int, int]]] = {}
        for at, (_, w) in enumerate(items):
            for term, n in Counter(w).items():
                found.setdefault(term, []).append((at, n))
        mean = sum(len(w) for _, w in items) / max(1, len(items))
        raw = {}
        own = [0.0] * len(items)
        for term, seen in found.items():
            idf = math.log(1 + (len(items) - len(seen) + 0.5) / (len(seen) + 0.5))
            raw[term] = [idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(items[at][1]) / mean)) for at, n in seen]
            for (at, _), x in zip(seen, raw[term]):
                own[at] += x
        terms = {t: k for k, t in enumerate(sorted(found))}
        postings = [([at for at, _ in found[t]], [x / own[at] for (at, _), x in zip(found[t], raw[t])]) for t in terms]
        blocks = [[(at[min(i + BLOCK, len(at)) - 1], max(x[i : i + BLOCK])) for i in range(0, len(at), BLOCK)] for at, x in postings]
        upper, starts, ranges, range_max = [max(x) for _, x in postings], [0], [], []
        for at, x in postings:
            most: dict[int, float] = {}
            for i, v in zip(at, x):
                most[i // RANGE] = max(most.get(i // RANGE, 0.0), v)
            ranges += most.keys()
            range_max += most.values()
            starts.append(len(ranges))
        window = max([SHINGLE, *(len(w) for _, w in items)])
        arrays = np.array(starts, np.int64), np.array(ranges, np.int64), np.array(range_max, float)
        return cls([i for i, _ in items], [w for _, w in items], terms, postings, blocks, upper, *arrays, window)

    def hopeful(self, of: np.ndarray, term: np.ndarray, least: float) -> list[int]:
        """The passages (values of ``of``) for which some range of items can reach ``least``."""
        n = self.range_starts[term + 1] - self.range_starts[term]
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(self.range_starts[term] - first, n)
        width = len(self.ids) // RANGE + 1
        key = np.repeat(of, n) * width + self.ranges[at]
        size = (int(of[-1]) + 1) * width
        if size <= 1 << 20:
            return np.unique(np.flatnonzero(np.bincount(key, self.range_max[at], size) >= least - 1e-9) // width).tolist()
        keys, back = np.unique(key, return_inverse=True)
        return np.unique(keys[np.bincount(back, self.range_max[at]) >= least - 1e-9] // width).tolist()

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items scoring ``least`` or more for the passage's distinct terms: block-max WAND."""
        least -= 1e-9
        lists = [[self.postings[t][0], self.postings[t][1], self.blocks[t], self.upper[t], 0] for t in terms]
        end, found = len(self.ids), []
        while True:
            lists = sorted((x for x in lists if x[4] < len(x[0])), key=lambda x: x[0][x[4]])
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[3]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0][lists[pivot][4]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == item:
                pivot += 1
            head, bound, upto = lists[: pivot + 1], 0.0, end
            for x in head:
                k = x[4] // BLOCK
                while k < len(x[2]) and x[2][k][0] < item:
                    k += 1
                if k < len(x[2]):
                    bound += x[2][k][1]
                    upto = min(upto, x[2][k][0] + 1)
            if bound >= least:
                score = 0.0
                for x in head:
                    self._seek(x, item)
                    if x[4] < len(x[0]) and x[0][x[4]] == item:
                        score += x[1][x[4]]
                        x[4] += 1
                if score >= least:
                    found.append((item, min(score, 1.0)))
            else:  # nothing up to the nearest block's end can reach the bound
                after = lists[pivot + 1][0][lists[pivot + 1][4]] if pivot + 1 < len(lists) else end
                for x in head:
                    self._seek(x, max(item + 1, min(upto, after)))

    @staticmethod
    def _seek(x: list, item: int) -> None:
        k = x[4] // BLOCK
        while k < len(x[2]) and x[2][k][0] < item:
            k += 1
        x[4] = max(x[4], k * BLOCK)
        while x[4] < len(x[0]) and x[0][x[4]] < item:
            x[4] += 1

    def overlap(self, item: int, passage: set[tuple[str, ...]], sizes: dict[int, set]) -> tuple[float, float, float]:
        """Shares of the item's, its question's and its answer's shingles that are in the passage."""
        w = self.words[item]
        half = (len(w) + 1) // 2
        out = []
        for part in (w, w[:half], w[half:] or w):
            own = shingles(part)
            size = min(SHINGLE, len(part))
            out.append(sum(s in (passage if size == SHINGLE else sizes[size]) for s in own) / len(own))
        return out[0], out[1], out[2]

    def hits(self, text: str | None, least: float = LEAST_SCORE, overlap: float = OVERLAP) -> list[tuple[int, float, float, int]]:
        """(item id, best score, best overlap, first word of the passage) of the items that the text holds."""
        words = words_of(text)
        best: dict[int, tuple[float, float, int]] = {}
        for start in range(0, len(words) if self.ids else 0, SLAB * self.window):
            self._slab(words, start, least, overlap, best)
        return [(self.ids[i], s, o, -p) for i, (s, o, p) in sorted(best.items())]

    def _slab(self, words: list[str], start: int, least: float, overlap: float, best: dict) -> None:
        """Searches the passages that begin in the SLAB * window words from ``start``; each is 2 * window words long."""
        slab = words[start : start + (SLAB + 1) * self.window]
        known = [(p, t) for p, w in enumerate(slab) if (t := self.terms.get(w)) is not None]
        if not known:
            return
        at, term = np.array(known).T
        k = at // self.window  # a word is in the passages k and k - 1
        pairs = np.unique(np.concatenate((np.minimum(k, SLAB - 1), np.maximum(k - 1, 0))) * len(self.upper) + np.concatenate((term, term)))
        of, term = pairs // len(self.upper), pairs % len(self.upper)
        for p in self.hopeful(of, term, least):
            lo, hi = np.searchsorted(of, [p, p + 1])
            found = self.search(term[lo:hi].tolist(), least)
            if not found:
                continue
            passage = slab[p * self.window : (p + 2) * self.window]
            held = shingles(passage)
            sizes = {n: {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)} for n in range(1, SHINGLE)}
            for item, score in found:
                both, question, answer = self.overlap(item, held, sizes)
                if both >= overlap - 1e-9 and question >= HALF and answer >= HALF:
                    best[item] = max(best.get(item, (0.0, 0.0, 0)), (score, both, -(start + p * self.window)))


def _shared_index(items: DataFrame, item_col: str, item_text_col: str) -> Broadcast:
    rows = pick(items, id=item_col, text=item_text_col)
    size = rows.agg(F.sum(F.regexp_count("text", F.lit(r"(?U)\w+"))), F.count("*")).first()
    if (size[0] or 0) + size[1] > MOST_WORDS:
        raise ValueError(f"the test items have more than {MOST_WORDS} words, too many for an index on each worker")
    return items.sparkSession.sparkContext.broadcast(Index.build([tuple(r) for r in rows.collect()]))


def contaminations(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", least: float = LEAST_SCORE, overlap: float = OVERLAP,
) -> DataFrame:
    """One row for each document and test item found in it: id, item_id, score, overlap, word.

    score is the passage's BM25 as a share of the item's score for itself, word the first word of the passage.
    Null and empty texts hold nothing; whole texts are searched, in slabs, however long; items without words or id are not
    searched. Items of equal text are found together. Repeated rows give repeated results; null document ids stay. Either
    table may be empty.
    """
    text_batches(docs.sparkSession)
    index = _shared_index(items, item_col, item_text_col)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, *hit) for i, t in zip(batch["id"], batch["text"]) for hit in index.value.hits(t, least, overlap)]
            yield pd.DataFrame(out, columns=["id", "item_id", "score", "overlap", "word"]).astype({"id": "object"})

    kept = pick(docs, id=id_col, text=text_col)
    kinds = dict(kept.dtypes)["id"], dict(items.dtypes)[item_col]
    return kept.mapInPandas(search, f"id {kinds[0]}, item_id {kinds[1]}, score double, overlap double, word long")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows, with all their columns, that hold no test item; nulls, repeats and empty tables as in ``contaminations``."""
    text_batches(docs.sparkSession)
    index = _shared_index(items, "item_id", "text")

    @F.pandas_udf("boolean")
    def clear(texts: pd.Series) -> pd.Series:
        return pd.Series([not index.value.hits(t) for t in texts], dtype=bool)

    plain = docs.toDF(*[f"x{i}" for i in range(len(docs.columns))])
    return plain.where(clear(F.col(f"x{docs.columns.index('text')}"))).toDF(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")
