"""Exact sets of integer ids as bitmaps that merge, so that distinct counts of many levels come from one pass.

A set is a row for each bucket of 32,768 neighbouring ids, with a bitmap of 4 KiB. Rows are combined before the
shuffle; a level above is the union of its parts' bitmaps, not a count over the rows again. Ids should be dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def has_whole_ids(df: DataFrame, id_col: str) -> bool:
    return isinstance(df.schema[id_col].dataType, WHOLE)


def id_sets(df: DataFrame, by: list[str], id_col: str, **sums: Column) -> DataFrame:
    """(by, bucket, bits, and the named aggregates): the ids of each group as bitmaps; null ids are in no set but count in the aggregates."""
    if not has_whole_ids(df, id_col):
        raise ValueError(f"{id_col} has no whole numbers")
    known = F.col(id_col).isNotNull()
    place = F.when(known, F.bitmap_bit_position(F.col(id_col).cast("long")))
    rows = df.withColumns({"bucket": F.bitmap_bucket_number(F.col(id_col).cast("long")), "_bit": place})
    return rows.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"), *[c.alias(n) for n, c in sums.items()])


def merged(sets: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """The sets of a level above: unions of bitmaps, sums of the sums."""
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), *[F.sum(c).alias(c) for c in sums])


def counted(sets: DataFrame, by: list[str], name: str, sums: list[str]) -> DataFrame:
    """(by, name, sums): the sizes of the sets."""
    size = F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits"))), F.lit(0))
    return sets.groupBy(*by).agg(size.alias(name), *[F.sum(c).alias(c) for c in sums])
