"""The corpus pipeline: five operators, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, language_id, mixing, sharding, simhash_dedup
from tidemark.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the model is fitted on this stage's own input.

    Null texts, and texts without letters or with few known words, go, whatever their length. Repeated rows share one
    decision. Without rows, or without labelled ones, none are kept.
    """
    return language_id.accepted(docs, language_id.fit(language_id.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest doc_id, of each group of near-duplicates: Jaccard 0.8 of five-word shingles at least.

    Groups are of texts: rows of one doc_id and unlike texts are kept apart, repeated rows count once, and rows with a
    null doc_id come last. Null and empty texts are one group. Without rows none are kept.
    """
    return simhash_dedup.keep_one(docs, size=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none, repeated rows share one decision."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row at least once, and small sources' rows as often as their weights ask for; null sources are one source.

    The columns of documents, and mix_pos: the row's number in the mix. Repeated rows count singly. Without rows the mix
    is empty.
    """
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix, by its number in the mix, with all its columns: a shard can be written from it.

    Null texts have size 8; repeated rows have numbers of their own. Without rows the result is empty.
    """
    return sharding.shard_numbered(docs, mixing.POSITION)


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

ORACLE_SQL = None  # XXH64 fingerprints, the language model and BM25 search have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
