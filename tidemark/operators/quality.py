"""Templates of data-quality rules; each returns the violations, so that an empty result passes.

All take column names, join on keys and leave range conditions to the join, and count with partial aggregation.
Null keys are not checked (as in SQL constraints) unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import active_at, contained_in
from tidemark.operators.intervals import steps
from tidemark.operators.ranges import LEAST, PARTS, running

FOREVER = "9999-12-31 00:00:00"


def contiguity(periods: DataFrame, key: str, order: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """(key, previous_end, start) wherever a key's next period does not start exactly as the one before ends."""
    before = Window.partitionBy(key).orderBy(*order)
    rows = periods.withColumns({"previous_end": F.lag(end).over(before), "_n": F.row_number().over(before)})
    return rows.where((F.col("_n") > 1) & ~F.col("previous_end").eqNullSafe(F.col(start))).select(key, "previous_end", start)


def overlap(periods: DataFrame, key: str, order: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Periods that begin before an earlier one of the same key has ended; ``order`` begins with the start."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.coalesce(end, F.lit(FOREVER).cast("timestamp_ntz"))).over(before)
    return periods.withColumn("latest_end", latest).where(F.col(start) < F.col("latest_end")).drop("latest_end")


def coverage(outer: DataFrame, inner: DataFrame, key: str, start: str = "valid_from", end: str = "valid_to", parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """(key, at): boundary points at which an outer period is active and no inner period of the key is.

    Between two neighbouring boundary points nothing changes, so testing the points tests all instants. Both sides are
    swept together: each point's running numbers of active outer and inner periods decide.
    """
    edges = steps(outer, [key], start, end, "outer").select(key, "at", "outer", F.lit(0).alias("inner"), F.col("begins").alias("point"))
    edges = edges.unionAll(steps(inner, [key], start, end, "inner").select(key, "at", F.lit(0), "inner", F.lit(True)))
    changes = edges.groupBy(key, "at").agg(F.sum("outer").alias("outer"), F.sum("inner").alias("inner"), F.bool_or("point").alias("point"))
    swept = running(changes, [key], "at", ["outer", "inner"], parts, least, outer.select(key).unionAll(inner.select(key)))
    return swept.where("point and outer_so_far > 0 and inner_so_far = 0").select(key, "at")


def containment(child: DataFrame, parent: DataFrame, on: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Child periods that lie in no parent period with equal keys."""
    p = parent.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(start).alias("_start"), F.col(end).alias("_end"))
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    return child.join(p, [*same, contained_in(F.col(start), F.col(end), F.col("_start"), F.col("_end"))], "left_anti")


def cardinality(parent: DataFrame, child: DataFrame, key: str, least: int | None = 1, most: int | None = 1) -> DataFrame:
    """(key, n) of parents with fewer than ``least`` or more than ``most`` children; parents without children count 0."""
    counts = child.groupBy(key).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    found = parent.select(key).join(counts, key, "left").select(key, n.alias("n"))
    wrong = F.lit(False)
    if least is not None:
        wrong = wrong | (F.col("n") < least)
    if most is not None:
        wrong = wrong | (F.col("n") > most)
    return found.where(wrong)


def boundary_reconcile(periods: DataFrame, events: DataFrame, on: list[str], boundary: str = "valid_from", time: str = "event_time") -> DataFrame:
    """(violation, on, at): boundaries without exactly one event at that time, and events without a boundary."""
    at = [*on, "at"]
    edges = periods.select(*on, F.col(boundary).alias("at")).where("at is not null").distinct()
    seen = events.select(*on, F.col(time).alias("at")).groupBy(*at).agg(F.count("*").alias("n"))
    both = edges.withColumn("edge", F.lit(True)).join(seen, at, "full")
    kind = F.when(F.col("edge").isNull(), "event_without_boundary").when(F.coalesce("n", F.lit(0)) != 1, "boundary_event_mismatch")
    return both.select(kind.alias("violation"), *at).where("violation is not null")


def orphan(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose non-null key has no parent."""
    keys = parent.select(F.col(parent_key).alias("_key")).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_key"), "left_anti")


def ordered_pair(df: DataFrame, first: str, second: str, strict: bool = False) -> DataFrame:
    """Rows whose second time precedes (``strict``: or equals) the first; a null in either is no violation."""
    return df.where(F.col(second) <= F.col(first) if strict else F.col(second) < F.col(first))


def null_safe_mismatch(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two columns differ; two nulls are equal."""
    return df.where(~F.col(a).eqNullSafe(F.col(b)))


def interval_count(events: DataFrame, periods: DataFrame, on: list[str], event_id: str, time: str = "event_time", expected: int = 1, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """(event_id, n) of events that lie in another number of periods than expected."""
    e = events.select(event_id, time, *[c for c in on if c != event_id])
    p = periods.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(start).alias("_start"), F.col(end).alias("_end"))
    joined = e.join(p, [*[F.col(c) == F.col(f"_{c}") for c in on], active_at(F.col(time), F.col("_start"), F.col("_end"))], "left")
    return joined.groupBy(event_id).agg(F.count("_start").alias("n")).where(F.col("n") != expected)


def after_closure(rows: DataFrame, closures: DataFrame, key: str, time: str = "event_time", closure: str = "closure_time") -> DataFrame:
    """Rows later than their key's closure; a null time counts as open-ended, so it is later."""
    late = F.col(time).isNull() | (F.col(time) > F.col(closure))
    return rows.join(closures.select(key, closure), key).where(late)


def duplicate_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n) of keys that occur more than once; keys with a null are not checked."""
    known = df.dropna(subset=columns)
    return known.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def outside_domain(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows with a non-null value that is not in the list."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values))


def failing(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which a check constraint is false; unknown passes, as in SQL."""
    return df.where(~F.coalesce(check, F.lit(True)))


def summary(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations, status) for each rule, in one job."""
    counts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in rules.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return with_status(out)


def with_status(counts: DataFrame) -> DataFrame:
    return counts.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))
