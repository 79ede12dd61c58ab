"""Exact interpolated percentiles by group without holding a group in one task.

Equal values are counted before the shuffle. The distinct values fall into buckets: their bounds are quantiles of a sketch over
them, so that crowded values are parted too, and a fixed, rising function parts wide ones further. A group's buckets (one small row
each) give each bucket's first rank, and ranks inside a bucket need that bucket's distinct values alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import bounds_within, place

PARTS, STEPS = 32, 4096


def ranked(counts: DataFrame, keys: list[str], value: str, weights: list[str], falling: bool = False) -> DataFrame:
    """Adds for each weight w ``w_before``, its sum over the key's smaller values (``falling``: larger), and ``w_of``, over all.

    ``counts`` has one row for each distinct value of a key; the first weight is positive. Rows without a value weigh nothing.
    """
    own = {w: F.when(F.col(value).isNotNull(), F.col(w)).otherwise(0) for w in weights}
    cuts = bounds_within(counts.where(F.col(weights[0]) > 0), value, PARTS)  # the condition holds for all and lets Spark share the shuffle
    rows = counts.withColumn("_cuts", cuts)
    fixed = (F.signum(value) * F.floor(F.log1p(F.abs(value)) * STEPS)).cast("long")
    bucket = place(rows, value, [F.col("_cuts")[i] for i in range(PARTS - 1)]).cast("long") * (1 << 40) + F.coalesce(fixed, F.lit(0))
    rows = rows.withColumn("_b", bucket).drop("_cuts")
    order = F.desc if falling else F.asc
    totals = rows.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_{w}") for w, c in own.items()])
    earlier, whole = Window.partitionBy(*keys).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    renamed = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_b"])], *[F.coalesce(F.sum(f"_{w}").over(earlier), F.lit(0)).alias(f"_{w}") for w in weights],
        *[F.sum(f"_{w}").over(whole).alias(f"{w}_of") for w in weights],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_b"])]
    inside = Window.partitionBy(*keys, "_b").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, -1)
    before = {f"{w}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{w}") for w, c in own.items()}
    return rows.join(renamed, same).withColumns(before).drop("_b", *[f"_{w}" for w in weights], *[f"_k{i}" for i in range(len(keys) + 1)])


def exact_percentiles(
    df: DataFrame, by: list[str], value: str, levels: dict[str, float], rows: str | None = None, known: str | None = None, mean: str | None = None,
) -> DataFrame:
    """by and one column for each level (name to share, such as 0.5); null values are ignored.

    A level's rank is share * (n - 1) from 0; between two ranks the value is interpolated. ``rows``, ``known`` and ``mean``
    name further columns from the same counts: all rows, those with a value, and their mean. Groups without a value have
    no row unless ``rows`` is asked for, an empty table has none; ``by`` may be empty for one group of all rows.
    """
    keys = by or ["_all"]
    plain = df if by else df.withColumn("_all", F.lit(0))
    if not rows:
        plain = plain.where(F.col(value).isNotNull())
    counts = plain.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = ranked(counts.withColumnRenamed("_n", "n"), keys, "_v", ["n"])
    placed = placed.withColumnsRenamed({"n": "_n", "n_before": "_start", "n_of": "_of"}).withColumn("_end", F.col("_start") + F.col("_n"))

    def holding(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    found, out = [], []
    for i, (name, share) in enumerate(levels.items()):
        place = F.lit(float(share)) * (F.col("_of") - 1)
        found += [holding(F.floor(place)).alias(f"_lo{i}"), holding(F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(name))
    own = F.col("_v").isNotNull()
    more = {rows: F.sum("_n"), known: F.coalesce(F.sum(F.when(own, F.col("_n"))), F.lit(0)), mean: F.sum(F.col("_v") * F.col("_n")) / F.sum(F.when(own, F.col("_n")))}
    named = {k: c for k, c in more.items() if k}
    return placed.groupBy(*keys).agg(*found, *[c.alias(k) for k, c in named.items()]).select(*by, *out, *named)
