"""Sweeps over periods and as-of lookups, without range joins; one key's rows may span any number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import LEAST, PARTS, dealt, running


def steps(periods: DataFrame, on: list[str], start: str = "valid_from", end: str = "valid_to", name: str = "step") -> DataFrame:
    """(on, at, step, begins) from one pass: 1 where a period begins, -1 where it ends; 0 at both bounds of an empty one.

    Null keys, and periods without a start, have no bounds.
    """
    real = (F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))).cast("int")
    bounds = F.array(F.struct(F.col(start).alias("at"), real.alias(name), F.lit(True).alias("begins")), F.struct(F.col(end).alias("at"), (-real).alias(name), F.lit(False).alias("begins")))
    return periods.dropna(subset=on).select(*on, F.explode(bounds).alias("_s")).select(*on, "_s.*").where("at is not null")


def coverage_depth(periods: DataFrame, on: list[str], start: str = "valid_from", end: str = "valid_to", parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """(on, start, end, depth): the longest stretches in which the same number of a key's periods, at least one, is active.

    An open stretch ends with null. Repeated periods count each.
    """
    changes = steps(periods, on, start, end).groupBy(*on, "at").agg(F.sum("step").alias("step")).where("step != 0")
    swept = running(changes, on, "at", ["step"], parts, least, periods).where("step_so_far > 0")
    return swept.select(*on, F.col("at").alias(start), F.col("next_at").alias(end), F.col("step_so_far").alias("depth"))


def merged_periods(periods: DataFrame, on: list[str], start: str = "valid_from", end: str = "valid_to", parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """(on, start, end): the union of each key's periods; those that overlap or touch become one."""
    changes = steps(periods, on, start, end).groupBy(*on, "at").agg(F.sum("step").alias("step")).where("step != 0")
    swept = running(changes, on, "at", ["step"], parts, least, periods)
    ends = swept.where("step_so_far = 0 or step_so_far = step").select(*on, "at", "step_so_far")
    return running(ends, on, "at", [], parts, least, periods).where("step_so_far > 0").select(*on, F.col("at").alias(start), F.col("next_at").alias(end))


def as_of(
    events: DataFrame, states: DataFrame, on: list[str], columns: list[str], time: str = "event_time", since: str = "valid_from", until: str | None = None,
    order: list[str] | None = None, parts: int = PARTS, least: int = LEAST,
) -> DataFrame:
    """Every event with ``columns`` of its key's latest state at or before its time; null where there is none.

    With ``until`` a state that has ended by then gives null too. Of states that begin together the last by ``order``
    counts. Events and states are sorted together by key and time, and the last state is carried on to the events after it,
    and from bucket to bucket of a hot key. Events without key or time find nothing; names of ``columns`` must not be the events' own.
    """
    kept = [*columns, *([until] if until and until not in columns else [])]
    known = states.dropna(subset=[*on, since])
    latest = F.max_by(F.struct(*kept), F.struct(*(order or [since])))
    known = known.groupBy(*on, F.col(since).alias("_at")).agg(latest.alias("_state"))
    rows = known.withColumn("_event", F.lit(None).cast(events.select(F.struct(*events.columns)).schema[0].dataType))
    nothing = F.lit(None).cast(known.schema["_state"].dataType)
    both = rows.unionByName(events.select(*on, F.col(time).alias("_at"), nothing.alias("_state"), F.struct(*events.columns).alias("_event")))
    counted = states.select(*on).unionAll(events.select(*on))
    both, any_hot = dealt(both, on, "_at", parts, least, counted)
    upto = Window.partitionBy(*on, "_bucket").orderBy("_at", F.col("_event").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("_held", F.last("_state", ignorenulls=True).over(upto)).where("_event is not null")
    if any_hot:
        # states alone, so that the events are not read again; the last of a bucket holds up to the next bucket that has any
        ends = both.where("_bucket > 0 and _state is not null").groupBy(*on, "_bucket").agg(F.max_by("_state", "_at").alias("_carried"))
        upto_next = F.coalesce(F.lead("_bucket").over(Window.partitionBy(*on).orderBy("_bucket")), F.lit(parts))
        carried = ends.withColumn("_next", upto_next).where("_bucket < _next").withColumn("_bucket", F.explode(F.expr("sequence(_bucket + 1, _next)"))).drop("_next")
        held = held.join(F.broadcast(carried), [*on, "_bucket"], "left").withColumn("_held", F.coalesce("_held", "_carried"))
    good = F.col("_at").isNotNull()
    if until:
        good = good & (F.col(f"_held.{until}").isNull() | (F.col("_at") < F.col(f"_held.{until}")))
    return held.withColumn("_held", F.when(good, F.col("_held"))).select("_event.*", *[F.col(f"_held.{c}").alias(c) for c in columns])
