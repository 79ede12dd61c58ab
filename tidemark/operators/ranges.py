"""Windows over a key that no task need hold whole.

Keys with more than a thousandth of all rows, and more than LEAST, are hot; there are fewer than a thousand. Their rows are cut into
buckets whose bounds are quantiles of one merged sketch over them, so that no bucket holds much more than its share, however crowded
the values are; only rows of one and the same value are never parted. A window over a key and a bucket, with what the earlier
buckets of a hot key hand on, equals a window over the key. What hot keys hand on is a row for each of their buckets and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS, ACCURACY, HOT, LEAST = 64, 4096, 1000, 1 << 20


def bounds(df: DataFrame, value: str, parts: int = PARTS) -> list:
    """At most ``parts`` - 1 distinct rising quantiles of the column (times as microseconds), from one pass over the rows."""
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.agg(F.percentile_approx(_number(df, value), shares, ACCURACY)).first()[0] if parts > 1 else None
    return sorted(set(found or []))


def bounds_within(df: DataFrame, value: str, parts: int = PARTS) -> Column:
    """As ``bounds``, as an array of ``parts`` - 1 numbers that the plan itself finds first, by a scalar subquery."""
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return df.agg(F.percentile_approx(_number(df, value), shares, ACCURACY)).scalar()


def place(df: DataFrame, value: str, cuts: list) -> Column:
    """The number of bounds (numbers or columns, rising) up to the value, by bisection; 0 for null."""
    v = _number(df, value)

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(v < cuts[middle], among(low, middle)).otherwise(among(middle + 1, high))

    return F.when(v.isNull(), 0).otherwise(among(0, len(cuts)))


def _number(df: DataFrame, value: str) -> Column:
    if df.schema[value].dataType.typeName().startswith("timestamp"):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(df.schema[value].dataType), F.col(value))
    return F.col(value).cast("double")


def bucketed(df: DataFrame, value: str, parts: int = PARTS, name: str = "_bucket") -> DataFrame:
    """Adds a bucket from 0 to ``parts`` - 1, rising with the value; reads the column once to find the bounds."""
    return df.withColumn(name, place(df, value, bounds(df, value, parts)))


def hot_keys(df: DataFrame, on: list[str], least: int = LEAST) -> DataFrame | None:
    """The keys without nulls that hold over one in HOT of all rows and over ``least``, or None; counts the rows at once."""
    counts = df.groupBy(*on).agg(F.count("*").alias("_n")).dropna(subset=on)
    many = counts.where((F.col("_n") > least) & (F.col("_n") > counts.agg(F.sum("_n")).scalar() / HOT)).select(*on)
    found = many.collect()  # fewer than HOT rows
    return df.sparkSession.createDataFrame(found, many.schema) if found else None


def dealt(df: DataFrame, on: list[str], value: str, parts: int = PARTS, least: int = LEAST, counted: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """The rows with _bucket, 0 for keys that are not hot, and whether any key is.

    ``counted`` is the table whose rows are counted, if there is a cheaper one with about as many rows a key.
    """
    hot = hot_keys(df if counted is None else counted, on, least) if parts > 1 else None
    if hot is None:
        return df.withColumn("_bucket", F.lit(0)), False
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    at = place(marked, value, bounds(marked.where("_hot"), value, parts))
    return marked.withColumn("_bucket", F.when(F.col("_hot"), at + 1).otherwise(0)).drop("_hot"), True


def running(df: DataFrame, on: list[str], at: str, sums: list[str], parts: int = PARTS, least: int = LEAST, counted: DataFrame | None = None) -> DataFrame:
    """Adds ``<sum>_so_far``, the total of each column over the key's rows up to this one, and next_at, the next row's ``at``.

    (on, at) must be unique and without nulls.
    """
    rows, any_hot = dealt(df, on, at, parts, least, counted)
    inside = Window.partitionBy(*on, "_bucket").orderBy(at)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({f"{c}_so_far": F.sum(c).over(upto) for c in sums} | {"next_at": F.lead(at).over(inside)})
    if not any_hot:
        return out.drop("_bucket")
    whole = rows.where("_bucket > 0").groupBy(*on, "_bucket").agg(F.min(at).alias("_first"), *[F.sum(c).alias(f"_{c}") for c in sums])
    buckets = Window.partitionBy(*on).orderBy("_bucket")
    before = buckets.rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*on, "_bucket", F.lead("_first").over(buckets).alias("_first"), *[F.sum(f"_{c}").over(before).alias(f"_{c}") for c in sums])
    added = {f"{c}_so_far": F.col(f"{c}_so_far") + F.coalesce(f"_{c}", F.lit(0)) for c in sums} | {"next_at": F.coalesce("next_at", "_first")}
    return out.join(F.broadcast(whole), [*on, "_bucket"], "left").withColumns(added).drop("_bucket", "_first", *[f"_{c}" for c in sums])
