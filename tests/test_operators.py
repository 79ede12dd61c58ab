"""Edges of the temporal and quality operators, percentiles, deliveries and streams, on hand-made rows."""

from __future__ import annotations

import random
from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import active_at, contained_in, live_at, local_month, month_end_snapshot, overlaps
from tidemark.operators import deliveries, distinct_sets, quality
from tidemark.operators.percentiles import exact_percentiles, ranked
from tidemark.plans import retention_model, serving
from tidemark.streaming import windows

PERIODS = "k string, valid_from timestamp_ntz, valid_to timestamp_ntz"


def d(day: int, month: int = 1) -> T:
    return T(2024, month, day)


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_boundaries_of_periods(spark):
    rows = spark.createDataFrame([(d(1),), (d(2),), (d(3),)], "t timestamp_ntz")
    start, end, t = F.lit(d(1)).cast("timestamp_ntz"), F.lit(d(3)).cast("timestamp_ntz"), F.col("t")
    none = F.lit(None).cast("timestamp_ntz")
    got = rows.select(active_at(t, start, end), live_at(t, start, end), active_at(t, start, none), live_at(t, start, none)).collect()
    assert [tuple(r) for r in got] == [(True, False, True, False), (True, True, True, True), (False, False, True, True)]


def test_overlap_and_containment_of_periods(spark):
    rows = spark.createDataFrame([(d(1), d(3), d(3), d(4)), (d(1), None, d(3), d(4)), (d(1), d(3), d(2), None), (d(2), None, d(1), None), (d(2), None, d(1), d(9))], "a timestamp_ntz, b timestamp_ntz, c timestamp_ntz, e timestamp_ntz")
    a, b, c, e = (F.col(x) for x in "abce")
    assert [tuple(r) for r in rows.select(overlaps(a, b, c, e), contained_in(a, b, c, e)).collect()] == [(False, False), (True, False), (True, False), (True, True), (True, False)]


def test_months(spark):
    rows = spark.createDataFrame([(T(2024, 1, 31, 22, 30),)], "t timestamp_ntz")
    got = rows.select(local_month(F.col("t")), month_end_snapshot(F.col("t"), 1)).first()
    assert (str(got[0]), got[1]) == ("2024-02-01", T(2024, 2, 29, 23, 59, 59))


def test_contiguity_overlap_coverage(spark):
    p = spark.createDataFrame([("a", d(1), d(3)), ("a", d(3), None), ("b", d(1), d(3)), ("b", d(4), d(6)), ("c", d(1), None), ("c", d(2), d(3))], PERIODS)
    assert values(quality.contiguity(p, "k", ["valid_from"]), "k", "previous_end") == [("b", d(3)), ("c", None)]
    assert values(quality.overlap(p, "k", ["valid_from"]), "k", "valid_from") == [("c", d(2))]
    outer = spark.createDataFrame([("a", d(1), None), ("b", d(1), d(6)), ("x", d(1), d(2))], PERIODS)
    assert values(quality.coverage(outer, p, "k"), "k", "at") == [("b", d(3)), ("x", d(1))]
    assert values(quality.containment(outer, p.where("k != 'c'"), ["k"]), "k") == [("a",), ("b",), ("x",)]


def test_counts_and_reconciliation(spark):
    parent = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    child = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    assert values(quality.cardinality(parent, child, "k"), "k", "n") == [("b", 2), ("c", 0)]
    assert values(quality.cardinality(parent, child, "k", None, 1), "k") == [("b",)]
    assert values(quality.orphan(child, parent.where("k = 'a'"), "k", "k"), "k") == [("b",), ("b",)]
    assert values(quality.duplicate_key(child, ["k"]), "k", "n") == [("b", 2)]
    p = spark.createDataFrame([("a", d(1), d(3)), ("b", d(2), None)], PERIODS)
    e = spark.createDataFrame([("a", d(1)), ("a", d(1)), ("c", d(5))], "k string, event_time timestamp_ntz")
    assert values(quality.boundary_reconcile(p, e, ["k"]), "violation", "k") == [("boundary_event_mismatch", "a"), ("boundary_event_mismatch", "b"), ("event_without_boundary", "c")]
    e = spark.createDataFrame([(1, "a", d(3)), (2, "a", d(2)), (3, None, d(2))], "event_id int, k string, event_time timestamp_ntz")
    assert values(quality.interval_count(e, p, ["k"], "event_id"), "event_id", "n") == [(1, 0), (3, 0)]


def test_pairs_and_domains(spark):
    rows = spark.createDataFrame([(1, d(2), d(1)), (2, d(2), d(2)), (3, None, d(1)), (4, None, None)], "i int, a timestamp_ntz, b timestamp_ntz")
    assert values(quality.ordered_pair(rows, "a", "b"), "i") == [(1,)]
    assert values(quality.ordered_pair(rows, "a", "b", strict=True), "i") == [(1,), (2,)]
    assert values(quality.null_safe_mismatch(rows, "a", "b"), "i") == [(1,), (3,)]
    assert values(quality.failing(rows, F.col("a") > F.col("b")), "i") == [(2,)]
    assert values(quality.outside_domain(rows, "i", [1, 2]), "i") == [(3,), (4,)]
    assert values(quality.summary({"x": rows, "y": rows.where("false")}), "rule", "violations", "status") == [("x", 4, "FAIL"), ("y", 0, "PASS")]


def test_percentiles_equal_sorting(spark):
    draw = random.Random(3)
    rows = [(g, draw.choice([None, -5.0, 0.0, 7.25, draw.random() * 1e6])) for g in ("a", "b", None) for _ in range(200)] + [("empty", None)]
    got = {r["g"]: (r["lo"], r["p"]) for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"lo": 0.0, "p": 0.37}).collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        at = 0.37 * (len(v) - 1)
        assert got[g] == pytest.approx((v[0], v[int(at)] + (v[int(at) + 1] - v[int(at)]) * (at - int(at))))
    assert "empty" not in got


def test_deliveries(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "b", 1), (3, "c", 1), (3, "c", None)], "event_id int, x string, y int")
    assert values(deliveries.conflicts(rows, "event_id"), "event_id", "deliveries") == [(3, 2)]
    assert tuple(deliveries.counters(rows, "event_id").first()) == (5, 3, 2, 1)
    assert values(deliveries.once(rows.where("event_id < 3"), "event_id"), "event_id", "x") == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="different payloads"):
        deliveries.once(rows, "event_id").collect()
    assert tuple(deliveries.counters(rows.where("false"), "event_id").first()) == (0, 0, 0, 0)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", T(2024, 1, 1, 10, 0)), (1, "u", T(2024, 1, 1, 10, 0)), (2, "u", T(2024, 1, 1, 10, 20)), (3, "u", T(2024, 1, 1, 12, 0))], "event_id int, u string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.deliveries_once(stream, "event_id", "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert values(spark.table("once"), "event_id") == values(windows.deliveries_once(rows, "event_id", "ts"), "event_id") == [(1,), (2,), (3,)]
    assert values(windows.sessions(windows.deliveries_once(rows, "event_id", "ts"), "u", "ts"), "events") == [(1,), (2,)]


def rating(i: str, event: str, kind: str, day: int, v: int | None):
    return (event, i, kind, d(day), v)


def test_rating_snapshot_edges(spark):
    rows = [rating("a", "e1", "rating_given", 1, 2), rating("a", "e2", "rating_changed", 1, 5), rating("b", "e3", "rating_changed", 2, 4), rating("b", "e4", "rating_removed", 3, None), rating("c", "e5", "rating_changed", 1, None)]
    t = {"rating_lifecycle_event": spark.createDataFrame(rows, "event_id string, rating_id string, event_type string, event_time timestamp_ntz, rating_value int")}
    got = serving.rating_snapshot(t).orderBy("rating_value").collect()
    assert [r["active_rating_count"] for r in got] == [0, 0, 0, 0, 1]
    assert (got[0]["total_active_ratings"], got[0]["current_avg_rating"], got[0]["high_rating_4_5_share_pct"]) == (1, 5.0, 100.0)


def test_conversion_is_inclusive_and_cohort_fixed(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    t = {
        "plan_catalog": table([("f", "FREE"), ("s", "Standard")], "plan_id string, plan_name string"),
        "website": table([("w1", "a"), ("w2", "b"), ("w3", "c")], "website_id string, account_id string"),
        "website_lifecycle_event": table([("w1", "published", d(1)), ("w2", "published", d(1)), ("w3", "published", T(2025, 12, 1))], "website_id string, event_type string, event_time timestamp_ntz"),
        "subscription_plan_period": table([("1", "a", "f", d(1), d(31)), ("2", "a", "s", d(31), None), ("3", "b", "f", d(1), None), ("4", "c", "f", d(1), None)], "subscription_plan_period_id string, account_id string, plan_id string, valid_from timestamp_ntz, valid_to timestamp_ntz"),
        "account_lifecycle_event": table([("b", "account_closure", d(9))], "account_id string, event_type string, event_time timestamp_ntz"),
    }
    assert values(serving.conversion_horizon(t), "horizon_days", "converted_count", "cohort_size") == [(30, 1, 2), (60, 1, 2), (90, 1, 2), (180, 1, 2)]
    assert values(serving.paid_retention_horizon(t), "horizon_months", "retained_count", "cohort_size") == [(1, 1, 1), (3, 1, 1), (6, 1, 1), (12, 1, 1)]


def test_ranking_metrics_with_ties(spark):
    s = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.5), (3, 1, 0.5), (4, 0, 0.1), (5, None, 0.99)], "id int, label int, score double")
    assert tuple(retention_model.average_precision(s).first()) == (2, 4, round(0.5 * 1 + 0.5 * 2 / 3, 6))
    assert tuple(retention_model.precision_at(s, 2, "id").first()) == (2, 1, 50.0, 50.0)
    c = retention_model.confusion(s, [0.5]).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"], c["recall_0"]) == (2, 1, 0, 1, 0.5)


def test_percentiles_and_counts_of_crowded_values(spark):
    draw = random.Random(4)
    rows = [("a", draw.choice([None, 5 + draw.random() * 1e-6])) for _ in range(3000)] + [("none", None)] * 3
    got = exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p": 0.5}, "rows", "known", "mean").orderBy("g").collect()
    v = sorted(x for _, x in rows if x is not None)
    middle = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert tuple(got[0])[2:4] == (3000, len(v)) and got[0]["p"] == pytest.approx(middle, abs=1e-15) and got[0]["mean"] == pytest.approx(sum(v) / len(v))
    assert tuple(got[1]) == ("none", None, 3, 0, None)
    counts = spark.createDataFrame([(0, x, 1) for x in v], "_all int, s double, n int")
    plan = ranked(counts, ["_all"], "s", ["n"]).select("s", "n_before").collect()
    assert {r["s"]: r["n_before"] for r in plan} == {x: i for i, x in enumerate(v)}


def test_average_precision_of_a_rare_class_with_tiny_scores(spark):
    draw = random.Random(5)
    rows = [(draw.choice([0, 0, 0, 1]), draw.random() * 1e-9) for _ in range(500)]
    ordered = sorted(rows, key=lambda r: -r[1])
    hits = [sum(r[0] for r in ordered[: i + 1]) / (i + 1) for i, r in enumerate(ordered) if r[0]]
    got = retention_model.average_precision(spark.createDataFrame(rows, "label int, score double")).first()
    assert tuple(got) == (len(hits), 500, round(sum(hits) / len(hits), 6))


def test_sets_of_ids_merge_exactly(spark):
    draw = random.Random(6)
    rows = [(draw.choice("ab"), draw.choice("xyz"), draw.choice([None, draw.randrange(-5, 200), draw.randrange(10**12)])) for _ in range(500)]
    sets = distinct_sets.id_sets(spark.createDataFrame(rows, "g string, h string, i long"), ["g", "h"], "i", n=F.count("*"))
    count = lambda keep: (len({i for g, h, i in rows if keep(g, h) and i is not None}), sum(keep(g, h) for g, h, _ in rows))
    assert values(distinct_sets.counted(sets, ["g", "h"], "d", ["n"]), "g", "h", "d", "n") == [(a, b, *count(lambda g, h: (g, h) == (a, b))) for a in "ab" for b in "xyz"]
    assert values(distinct_sets.counted(distinct_sets.merged(sets, ["g"], ["n"]), ["g"], "d", ["n"]), "g", "d", "n") == [(a, *count(lambda g, h: g == a)) for a in "ab"]
    assert values(distinct_sets.counted(distinct_sets.merged(sets, [], ["n"]), [], "d", ["n"]), "d", "n") == [count(lambda g, h: True)]
    with pytest.raises(ValueError, match="whole"):
        distinct_sets.id_sets(spark.createDataFrame(rows, "g string, h string, i long"), ["g"], "h")


def test_transitions_of_text_and_whole_ids_agree(spark):
    moves = [(draw, f"A{i % 7}", "f", "s" if i % 3 else "p") for i in range(40) for draw in (("subscription_upgraded", "subscription_cancelled")[i % 2],)]
    plans = spark.createDataFrame([("f", "free"), ("s", "Standard"), ("p", "premium")], "plan_id string, plan_name string")
    text = spark.createDataFrame(moves, "event_type string, account_id string, from_plan_id string, to_plan_id string")
    whole = text.withColumn("account_id", F.expr("cast(substr(account_id, 2) AS bigint)"))
    got = [values(serving.commercial_transition({"plan_catalog": plans, "subscription_lifecycle_event": df}), "*") for df in (text, whole)]
    assert got[0] == got[1] and len(got[0]) == 4


def test_attempts_by_sets_and_by_counts_agree(spark):
    draw = random.Random(7)
    rows = [(draw.choice("fg"), draw.choice(["free", "standard", "premium", "other"]), draw.randrange(9), draw.randrange(30), draw.choice([None, draw.randrange(5)])) for _ in range(200)]
    locked = spark.createDataFrame(rows, "feature_id string, plan_name string, account_id long, user_id long, website_id long")
    plain = serving._attempt_counts(locked)
    assert values(serving._attempt_sets(locked, ["account_id", "user_id", "website_id"]), *plain.columns) == values(plain, "*")
