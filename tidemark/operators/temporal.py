"""Operators on events and half-open periods, free of table names.

Each joins on an equality of keys first, so that Spark shuffles (or, for small sides, broadcasts by its own size
estimate) and splits skewed keys; the range conditions are evaluated inside the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import active_at, add_months, month_start, overlaps


def first_row(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """key and columns of each key's first row by ``order``, which should be unique; combined before the shuffle."""
    best = df.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return best.select(key, "_row.*")


def latest_row(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """As first_row, for each key's last row."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return best.select(key, "_row.*")


def boundaries(periods: DataFrame, key: str, state: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """(key, boundary_time, from_state, to_state) wherever one of a key's periods starts exactly as another ends."""
    old = periods.select(key, F.col(end).alias("boundary_time"), F.col(state).alias("from_state"))
    new = periods.select(key, F.col(start).alias("boundary_time"), F.col(state).alias("to_state"))
    return old.join(new, [key, "boundary_time"])


def during(
    events: DataFrame, periods: DataFrame, on: list[str], time: str = "event_time", start: str = "valid_from", end: str = "valid_to", how: str = "inner",
) -> DataFrame:
    """Events joined to the periods active at their time; ``how`` as in DataFrame.join (also left_semi, left_anti).

    The columns of ``on`` come from the events; other names must not clash.
    """
    renamed = periods.withColumnsRenamed({c: f"_{c}" for c in on})
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    joined = events.join(renamed, [*same, active_at(F.col(time), F.col(start), F.col(end))], how)
    return joined.drop(*[f"_{c}" for c in on])


def overlapping(
    left: DataFrame, right: DataFrame, on: list[str], start: str = "valid_from", end: str = "valid_to", width: str | None = None,
) -> DataFrame:
    """Pairs of periods with equal keys that share an instant; the right side's columns get the prefix ``other_``.

    Both sides are cut into bins of time and joined on key and bin, so that a key of few values is dealt out over as many
    tasks as it has bins. A pair counts in the bin of its later start alone. ``width`` is an interval's text; by default
    it is the median length of the closed periods, or the MOST_BINS-th part of the time between the first and the last start
    if that is longer, so that no period, open or long, is repeated more often than MOST_BINS times.
    """
    other = right.withColumnsRenamed({c: f"other_{c}" for c in right.columns})
    bounds = _bin_bounds(left, right, start, end, width)
    mine, others = _binned(left, bounds, start, end, ""), _binned(other, bounds, f"other_{start}", f"other_{end}", "other")
    same = [F.col(c) == F.col(f"other_{c}") for c in on] + [F.col("_bin") == F.col("_otherbin"), F.col("_bin") == F.greatest("_first", "_otherfirst")]
    found = mine.join(others, [*same, overlaps(F.col(start), F.col(end), F.col(f"other_{start}"), F.col(f"other_{end}"))])
    return found.drop("_bin", "_first", "_otherbin", "_otherfirst")


MOST_BINS, EPOCH = 256, "1970-01-01 00:00:00"


def _micros(t: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), t)


def _bin_bounds(left: DataFrame, right: DataFrame, start: str, end: str, width: str | None) -> Column:
    """A struct of the first start, the last start and the width of the bins, in microseconds, as a scalar subquery."""
    both = left.select(_micros(F.col(start)).alias("a"), _micros(F.col(end)).alias("b"))
    both = both.unionAll(right.select(_micros(F.col(start)), _micros(F.col(end))))
    usual = F.percentile_approx(F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")), 0.5)
    first, last = F.min("a"), F.max("a")
    measured = F.greatest(usual, F.ceil((last - first + 1) / F.lit(MOST_BINS)).cast("long"), F.lit(1))
    if width:
        epoch = F.lit(EPOCH).cast("timestamp_ntz")
        measured = _micros(epoch + F.expr(f"INTERVAL {width}"))
    return both.agg(F.struct(first.alias("first"), last.alias("last"), measured.alias("width"))).scalar()


def _binned(periods: DataFrame, bounds: Column, start: str, end: str, tag: str) -> DataFrame:
    """A row for each bin in which the period is active, up to the last bin that has a start; ``_first`` is its first bin."""
    rows = periods.where(F.col(start).isNotNull()).withColumn("_b", bounds)

    def place(t: Column) -> Column:
        return F.floor((t - F.col("_b.first")) / F.col("_b.width")).cast("long")

    first, last = place(_micros(F.col(start))), place(F.least(F.coalesce(_micros(F.col(end)) - 1, F.col("_b.last")), F.col("_b.last")))
    rows = rows.withColumns({f"_{tag}first": first, "_l": last})
    return rows.withColumn(f"_{tag}bin", F.explode(F.sequence(f"_{tag}first", F.greatest(f"_{tag}first", "_l")))).drop("_b", "_l")


def periods_of(events: DataFrame, key: str, time: str, order: list[str] | None = None) -> DataFrame:
    """Each event opens a period that the key's next event closes: adds valid_from and valid_to (null for the last)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(time, *(order or []))
    return events.withColumns({"valid_from": F.col(time), "valid_to": F.lead(time).over(w)})


def months_of(periods: DataFrame, first: Column, last: Column, name: str = "month_start") -> DataFrame:
    """A row for each calendar month from that of ``first`` to that of ``last``, both included."""
    return periods.withColumn(name, F.explode(F.sequence(month_start(first), month_start(last), F.expr("INTERVAL 1 MONTH"))))


def clipped_seconds(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Seconds that the period [start, end) spends inside [lo, hi); 0 where they do not meet."""
    a, b = F.greatest(start, lo), F.least(F.coalesce(end, hi), hi)
    return F.greatest(F.timestamp_diff("MICROSECOND", a, b), F.lit(0)).cast("double") / 1e6


def horizon_rows(df: DataFrame, horizons: list[tuple[int, str]], unit: str) -> DataFrame:
    """Each row once for each horizon, with columns horizon_<unit>, horizon_label, horizon_order; no join is made."""
    rows = [F.struct(F.lit(n).alias(f"horizon_{unit}"), F.lit(label).alias("horizon_label"), F.lit(i + 1).alias("horizon_order")) for i, (n, label) in enumerate(horizons)]
    return df.withColumn("_h", F.explode(F.array(*rows))).select("*", "_h.*").drop("_h")


def anniversary(df: DataFrame, t: str, months: int, name: str) -> DataFrame:
    return df.withColumn(name, add_months(F.col(t), months))
