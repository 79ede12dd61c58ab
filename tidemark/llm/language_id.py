"""Language ID by word-first backoff.

Words are runs of letters with their marks (Unicode categories L and M). A known word scores by its log frequency in each
language. An unseen word is scored by its longest known character n-grams: the mean over those of 5 letters, else of 4,
and so on down to single letters; n-grams of two letters and more see the word's bounds as spaces. A document's score for
a language is the sum over all its words; languages are equally likely beforehand.

The model is fitted on a bounded sample of labelled rows, about ``sample_rows`` for each of at most MOST_LANGS languages,
drawn by a hash of id and text. All words and n-grams of the sample are learned, from whole texts and whole words, so the
sample bounds the model, which goes to all workers: 64-bit hashes of words and n-grams, and a number for each language. Prediction reads every whole text.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pick, table, text_batches, written

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST, SAMPLE_ROWS, MOST_LANGS, SMOOTH = 5, 2000, 64, 0.5
UNKNOWN, LEAST_SCORE, LEAST_KNOWN, TELLING = "und", 0.5, 0.25, 4


def grams_of(word: str, size: int) -> list[str]:
    padded = f" {word} " if size > 1 else word
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def hashes(keys: Iterable[str]) -> np.ndarray:
    """XXH64 of words or n-grams, by which they are known."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(k.encode("utf-8", "surrogatepass")) for k in keys], np.uint64)


@dataclass
class Model:
    """Words (place 0) and n-grams by length: sorted hashes, and log frequencies by hash and language."""

    langs: list[str]
    keys: list[np.ndarray]
    scores: list[np.ndarray]

    def find(self, size: int, keys: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are known, and the places of those."""
        wanted, known = hashes(keys), self.keys[size]
        at = np.searchsorted(known, wanted)
        found = at < len(known)
        found[found] = known[at[found]] == wanted[found]
        return found, at[found]

    def scored(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the score for each language, and whether it is known or has known n-grams of TELLING letters."""
        scores, told = np.zeros((len(words), len(self.langs))), np.zeros(len(words), bool)
        found, at = self.find(0, words)
        scores[found], told[found] = self.scores[0][at], True
        rest = np.flatnonzero(~found)
        for size in range(LONGEST, 0, -1):
            grams = [grams_of(words[i], size) for i in rest]
            owner = np.repeat(np.arange(len(rest)), [len(g) for g in grams])
            found, at = self.find(size, itertools.chain.from_iterable(grams))
            n = np.bincount(owner[found], minlength=len(rest))
            hit = np.flatnonzero(n)
            for k in range(len(self.langs)):
                scores[rest[hit], k] = np.bincount(owner[found], self.scores[size][at, k], len(rest))[hit] / n[hit]
            told[rest[hit]] = size >= TELLING
            rest = rest[n == 0]
        return scores, told

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float, float]]:
        """Of each text the language, its posterior, and the share of words that are told (see ``scored``)."""
        counts = [Counter(WORD.findall((t or "").lower())) for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0, 0.0)] * len(counts)
        words = list(set().union(*counts))
        place, (scores, told), out = {w: i for i, w in enumerate(words)}, self.scored(words), []
        for count in counts:
            if not count:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            at, n = np.array([place[w] for w in count]), np.array(list(count.values()), float)
            total = n @ scores[at]
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum()), float(n @ told[at] / n.sum())))
        return out


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _scores(lang: np.ndarray, key: np.ndarray, n: np.ndarray, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their log frequencies by language, from counts of languages' places and hashes."""
    keys, at = np.unique(key, return_inverse=True)
    counts = np.zeros((len(keys), langs))
    counts[at, lang] = n
    totals = np.maximum(counts.sum(axis=0), 1)
    return keys, np.log((counts + SMOOTH) / (totals + SMOOTH * max(1, len(keys)))).astype(np.float32)


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Rows with a null text or label teach nothing, nor do texts without letters; repeated rows count singly.

    More than MOST_LANGS labels raise ValueError, as the model has a number for each of them. Without labelled rows the model knows no language.
    """
    text_batches(labelled.sparkSession)
    rows = pick(labelled, id=id_col, text=text_col, lang=lang_col).where("text is not null and lang is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} labels of languages")
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return Model([], [np.zeros(0, np.uint64)] * (LONGEST + 1), [np.zeros((0, 0))] * (LONGEST + 1))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, sample_rows / r["n"])))])[F.col("lang")]
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), "text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    place = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])[F.col("lang")]
    sample = rows.where(drawn < share).select(place.alias("lang"), "text")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch["lang"].tolist(), batch["text"]):
                found.update((lang, w) for w in WORD.findall(text.lower()))
            yield pd.DataFrame([(lang, w, n) for (lang, w), n in found.items()], columns=["lang", "key", "n"])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for lang, word, n in zip(batch["lang"].tolist(), batch["key"], batch["n"].tolist()):
                found[0, lang, word] += n
                for size in range(1, LONGEST + 1):
                    for gram in grams_of(word, size):
                        found[size, lang, gram] += n
            keys = list(found)
            yield pd.DataFrame({
                "size": [k[0] for k in keys], "lang": [k[1] for k in keys],
                "h": hashes(k[2] for k in keys).view(np.int64), "n": list(found.values()),
            })

    total = F.sum("n").alias("n")
    vocabulary = written(sample.mapInPandas(words, "lang int, key string, n long").groupBy("lang", "key").agg(total), "language-words")
    learned = vocabulary.mapInPandas(parts, "size int, lang int, h long, n long").groupBy("size", "lang", "h").agg(total)
    learned = written(learned, "language-parts").toArrow()
    size, lang, h, n = (learned[c].to_numpy() for c in ("size", "lang", "h", "n"))
    tables = [_scores(lang[size == k], h[size == k].view(np.uint64), n[size == k], len(langs)) for k in range(LONGEST + 1)]
    return Model(langs, [k for k, _ in tables], [s for _, s in tables])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, lang_pred, score (the posterior of lang_pred), known (share of words that are known).

    'und' with score 0 for texts that are null or have no letters, and for all texts if no language was learned;
    ties go to the first language in alphabetical order. Whole texts are read, however long. Null ids and repeated rows
    stay. An empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, known double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(texts), columns=["lang_pred", "score", "known"])

    found = pick(docs, id=id_col, text=text_col).select("id", guess("text").alias("got"))
    return found.select("id", "got.*")


def accepted(
    docs: DataFrame, model: Model, least: float = LEAST_SCORE, known: float = LEAST_KNOWN, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows, with all their columns, in a known language: with a score of ``least`` or more, and that share of known words.

    The score tells languages apart and is near 1 for any long text; the share of known words tells text in a learned
    language from gibberish and from others. Null texts and texts without letters go; nulls elsewhere and repeated rows
    change nothing. An empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fits(texts: pd.Series) -> pd.Series:
        return pd.Series([lang != UNKNOWN and score >= least and share >= known for lang, score, share in shared.value.predict(texts)], dtype=bool)

    plain = docs.toDF(*[f"x{i}" for i in range(len(docs.columns))])
    return plain.where(fits(F.col(f"x{docs.columns.index(text_col)}"))).toDF(*docs.columns)


def training_rows(docs: DataFrame) -> DataFrame:
    rows = pick(docs, doc_id="doc_id", text="text", lang="lang")
    return rows.where(~held_out(F.col("doc_id")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(training_rows(docs)))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
