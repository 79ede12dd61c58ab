"""Binned interval joins, sweeps and as-of lookups against brute force, with keys that hold many rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality, ranges
from tidemark.operators.intervals import as_of, coverage_depth, merged_periods
from tidemark.operators.temporal import MOST_BINS, _bin_bounds, _binned, overlapping

ZERO = datetime(2024, 1, 1)
PERIODS = "k string, i int, valid_from timestamp_ntz, valid_to timestamp_ntz"
FOREVER = datetime(9999, 1, 1)


def at(hours: float) -> datetime:
    return ZERO + timedelta(hours=hours)


def periods(n: int, seed: int, keys: str = "aaab") -> list[tuple]:
    draw = random.Random(seed)
    out = [("a", -1, at(0), at(4)), ("a", -2, at(4), at(8)), ("a", -3, at(5), at(6)), ("a", -4, at(0), at(9000)), ("b", -5, at(3), None), (None, -6, at(0), None), ("a", -7, at(7), at(7)), ("c", -8, None, at(9))]
    for i in range(n):
        start = draw.randrange(0, 400)
        out.append((draw.choice(keys), i, at(start), draw.choice([None, at(start + 5000)]) if draw.random() < 0.1 else at(start + draw.randrange(1, 12))))
    return out


def overlap(x: tuple, y: tuple) -> bool:
    return None not in (x[0], y[0], x[2], y[2]) and x[0] == y[0] and x[2] < (y[3] or FOREVER) and y[2] < (x[3] or FOREVER)


@pytest.mark.parametrize("width", [None, "1 hour", "3 days", "1 year"])
def test_binned_overlap_equals_brute_force(spark, width):
    left, right = periods(150, 1), periods(150, 2)
    want = sorted((x[1], y[1]) for x in left for y in right if overlap(x, y))
    got = overlapping(spark.createDataFrame(left, PERIODS), spark.createDataFrame(right, PERIODS), ["k"], width=width)
    assert got.columns == ["k", "i", "valid_from", "valid_to", "other_k", "other_i", "other_valid_from", "other_valid_to"]
    assert sorted((r["i"], r["other_i"]) for r in got.collect()) == want


def test_one_key_is_dealt_out_and_no_period_repeated_without_bound(spark):
    df = spark.createDataFrame(periods(4000, 3, "a"), PERIODS)
    binned = _binned(df, _bin_bounds(df, df, "valid_from", "valid_to", None), "valid_from", "valid_to", "")
    assert binned.groupBy("i").count().agg(F.max("count")).first()[0] <= MOST_BINS + 1
    starts = binned.where("k = 'a' and _bin = _first").groupBy("_bin").count().agg(F.max("count")).first()[0]
    assert starts < 4000 / 20


def depth(rows: list[tuple], key: str, t: datetime) -> int:
    return sum(r[0] == key and r[2] is not None and r[2] <= t < (r[3] or FOREVER) for r in rows)


@pytest.mark.parametrize(("parts", "least"), [(1, 0), (5, 0), (64, 60), (64, ranges.LEAST)])
def test_sweeps_equal_brute_force(spark, parts, least):
    rows = periods(120, 4, "ab") + [("g", i, at(10 * i), at(10 * i + 7)) for i in range(9)] + [("t", 1, at(1), at(2)), ("t", 2, at(2), at(3)), ("t", 2, at(2), at(3))]
    df, points = spark.createDataFrame(rows, PERIODS), sorted({t for r in rows for t in r[2:] if t})
    want, islands = [], []
    for key in "abcgt":
        before, run = 0, None
        for t in points:
            now = depth(rows, key, t)
            if now != before:
                if want and want[-1][0] == key and want[-1][2] is None:
                    want[-1] = (*want[-1][:2], t, want[-1][3])
                if now:
                    want.append((key, t, None, now))
            if now and not before:
                run = t
            if before and not now:
                islands.append((key, run, t))
            before = now
        if before:
            islands.append((key, run, None))
    assert sorted(map(tuple, coverage_depth(df, ["k"], parts=parts, least=least).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, merged_periods(df, ["k"], parts=parts, least=least).collect()), key=str) == sorted(islands, key=str)
    assert coverage_depth(df.limit(0), ["k"], parts=parts).count() == merged_periods(df.limit(0), ["k"], parts=parts).count() == 0


def test_coverage_equals_testing_every_point(spark):
    outer, inner = periods(60, 5, "ab"), [r for r in periods(80, 6, "ab") if r[3] and r[3] < at(500)]
    seen = {(r[0], t) for r in inner for t in r[2:]} | {(r[0], r[2]) for r in outer}
    want = sorted((k, t) for k, t in seen if k and t and depth(outer, k, t) and not depth(inner, k, t))
    got = quality.coverage(spark.createDataFrame(outer, PERIODS), spark.createDataFrame(inner, PERIODS), "k", parts=7, least=50)
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize(("parts", "least"), [(1, 0), (4, 100), (64, 100), (16, 0), (64, ranges.LEAST)])
def test_as_of_with_one_key_of_half_the_rows(spark, parts, least):
    draw = random.Random(7)
    key = lambda: draw.choice(["hot", "hot", "hot", "x", "y", "z"])
    states = [(key(), at(draw.randrange(500)), at(draw.randrange(500)), i) for i in range(150)] + [("hot", at(3), None, 999), ("hot", at(3), None, 998), (None, at(1), None, 5), ("w", None, None, 6)]
    events = [(i, key(), at(draw.randrange(-20, 520))) for i in range(400)] + [(-1, None, at(5)), (-2, "hot", None), (-3, "hot", at(3)), (-3, "hot", at(3)), (-4, "unknown", at(9))]
    want = []
    for i, k, t in events:
        known = [(s, v, e) for g, s, e, v in states if k and t and g == k and s and s <= t]
        last = max(known, key=lambda x: x[:2], default=(None, None, None))
        want.append((i, k, t, last[1], None if last[2] and last[2] <= t else last[1]))
    e = spark.createDataFrame(events, "i int, k string, event_time timestamp_ntz")
    s = spark.createDataFrame(states, "k string, valid_from timestamp_ntz, valid_to timestamp_ntz, v int")
    plain = sorted(map(tuple, as_of(e, s, ["k"], ["v"], order=["v"], parts=parts, least=least).collect()), key=str)
    ended = sorted(map(tuple, as_of(e, s, ["k"], ["v"], until="valid_to", order=["v"], parts=parts, least=least).collect()), key=str)
    assert plain == sorted((w[:4] for w in want), key=str)
    assert ended == sorted(((*w[:3], w[4]) for w in want), key=str)
    assert as_of(e.limit(0), s, ["k"], ["v"], parts=parts).count() == 0
    assert as_of(e, s.limit(0), ["k"], ["v"], parts=parts).where("v is not null").count() == 0


def test_no_bucket_holds_much_more_than_its_share(spark):
    draw = random.Random(8)
    for values in ([draw.random() * 1e-6 for _ in range(4000)], [10 ** draw.uniform(-300, 300) for _ in range(4000)], [float(i) for i in range(4000)]):
        got = ranges.bucketed(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()
        sizes, bounds = {}, {}
        for r in got:
            sizes[r["_bucket"]] = sizes.get(r["_bucket"], 0) + 1
            low, high = bounds.get(r["_bucket"], (r["v"], r["v"]))
            bounds[r["_bucket"]] = min(low, r["v"]), max(high, r["v"])
        assert max(sizes.values()) < 2 * 4000 / ranges.PARTS
        order = sorted(bounds)
        assert all(bounds[a][1] < bounds[b][0] for a, b in zip(order, order[1:]))


def test_a_hot_key_is_dealt_out_evenly(spark):
    rows = [("hot", at(i / 1000)) for i in range(3000)] + [(f"k{i}", at(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    got, any_hot = ranges.dealt(df, ["k"], "t", 64, 100)
    assert any_hot and ranges.hot_keys(df, ["k"], 3000) is None
    sizes = {(r["k"], r["_bucket"]): r["count"] for r in got.groupBy("k", "_bucket").count().collect()}
    assert max(sizes.values()) < 2 * 3000 / 64 and all(b == 0 for k, b in sizes if k != "hot")


def test_as_of_reads_events_once_for_hot_keys(spark):
    """In the plan of the result, what a bucket hands on comes from the states alone, over buckets without any."""
    e = spark.range(900).selectExpr("0 AS k", "id", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, cast(id AS int)) AS event_time")
    s = spark.range(1, 901, 400).selectExpr("0 AS k", "id AS v", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, cast(id AS int)) AS valid_from")
    got = as_of(e, s, ["k"], ["v"], parts=16, least=0)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 900") == 1
    assert {r.id: r.v for r in got.collect()} == {i: None if i < 1 else 1 + (i - 1) // 400 * 400 for i in range(900)}
