"""Reports on hand-made rows, and the logistic model against a plain Newton solution."""

from __future__ import annotations

import math
import random
from datetime import datetime

import numpy as np
import pytest

from tidemark.plans import reports, retention_model


def rows(spark, n: int = 120):
    draw = random.Random(3)
    out = []
    for i in range(n):
        x = [float(draw.randrange(0, 9)) for _ in range(3)]
        p = 1 / (1 + math.exp(-(0.6 * x[0] - 0.4 * x[1] - 0.5)))
        out.append((i, *x, int(draw.random() < p)))
    return out, spark.createDataFrame(out, "account_id long, a double, b double, c double, target_m6 int").repartition(3)


def test_logistic_equals_newton(spark):
    plain, df = rows(spark)
    fitted = retention_model.fit(df, ["a", "b", "c"])
    x, y = np.array([r[1:4] for r in plain]), np.array([r[4] for r in plain], float)
    z = np.column_stack(((x - x.mean(axis=0)) / x.std(axis=0, ddof=1), np.ones(len(x))))
    w, penalty = np.zeros(4), np.diag([1.0, 1, 1, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    table = {r.feature: r for r in reports.coefficients(fitted, df, ["a", "b", "c"]).collect()}
    assert [table[f].coefficient for f in ("a", "b", "c", "(intercept)")] == pytest.approx(w.tolist(), abs=1e-4)
    assert table["(intercept)"].rank is None and sorted(table[f].rank for f in "abc") == [1, 2, 3]
    assert table["a"].odds_ratio == pytest.approx(math.exp(table["a"].coefficient))
    got = {r.account_id: r.score for r in retention_model.score(fitted, df).collect()}
    assert [got[r[0]] for r in plain] == pytest.approx((1 / (1 + np.exp(-z @ w))).tolist(), abs=1e-4)


def test_always_paid(spark):
    df = spark.createDataFrame([("A", 1), ("A", 0), ("A", None), ("B", 0)], "split_name string, target_m6 int")
    got = {r.split_name: (r.accounts, r.tp, r.accuracy, r.balanced_accuracy, r.recall_1) for r in reports.always_paid(df).collect()}
    assert got == {"A": (2, 1, 0.5, 0.5, 1.0), "B": (1, 0, 0.0, 0.0, 0.0), "ALL": (3, 1, 0.333333, 0.5, 1.0)}


def test_sweep_and_calendar(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.3), (0, 0.6), (0, 0.1), (None, 0.5)], "label int, score double")
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in reports.threshold_sweep(df, (0.5, 0.95)).collect()}
    assert got == {0.5: (1, 1, 1, 1), 0.95: (0, 0, 2, 2)}
    days = spark.createDataFrame([(datetime(2023, 5, 1, 3),), (datetime(2024, 2, 1),), (None,)], "t timestamp_ntz")
    found = reports.calendar(days, "t").orderBy("date").collect()
    assert len(found) == 365 + 366 and (found[0].month, found[-1].quarter, found[-1].day) == ("January", 4, 31)
    assert reports.calendar(days.where("t is null"), "t").count() == 0


def test_ranges_and_verdicts(spark):
    measured = spark.createDataFrame([("x", 2, 10), ("y", 0, 0)], "imperfection string, rows long, of long")
    got = {r.imperfection: r.status for r in reports.in_range(measured, {"x": (0.2, 0.3), "y": (0, 1), "z": (0, 1)}).collect()}
    assert got == {"x": "PASS", "y": "FAIL", "z": "FAIL"}
    verdicts = spark.createDataFrame([("DQ-01", 0), ("DQ-02", 0)], "rule string, violations long")
    assert reports.passed(verdicts) and not reports.passed(verdicts.selectExpr("rule", "violations + 1 AS violations"))


def test_visual(spark):
    view = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 12), ("c", 3, 1)], "k string, part int, n int")
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, name string")
    got = reports.visual(view, ["name"], ["n"], {"part": [1, 2]}, "n", [(names, "k")]).collect()
    assert [(r["name"], r["n"], r["sort"]) for r in got] == [("A", 12, 1), ("B", 12, 2)]


def test_a_visual_can_ignore_a_filter_of_the_page(spark):
    view = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 4)], "f string, m string, n int")
    got = lambda **more: sorted(tuple(r)[:2] for r in reports.visual(view, ["f"], ["n"], page={"f": ["a"], "m": ["x"]}, **more).collect())
    assert got() == [("a", 1)] and got(ignore=("m",)) == [("a", 3)] and got(ignore=("f", "m"), keep={"f": ["b"]}) == [("b", 4)]


def test_value_shares_count_nulls(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "v string")
    assert sorted(map(tuple, reports.value_shares(rows, "v").collect()), key=str) == [("a", 2, 0.5), ("b", 1, 0.25), (None, 1, 0.25)]
    assert reports.value_shares(rows.where("false"), "v").count() == 0


def test_exported_data_set_is_ordered_over_all_files(spark, tmp_path):
    draw = random.Random(9)
    made = [(i, datetime(2024, 1, draw.randrange(1, 28)), datetime(2025, 1, 1), "TRAIN", *[draw.randrange(9)] * 9, 1) for i in range(500)]
    kinds = ["long", "timestamp_ntz", "timestamp_ntz", "string", "double", *["long"] * 8, "int"]
    df = spark.createDataFrame([(*r[:4], float(r[4]), *r[5:]) for r in made], ", ".join(f"{c} {k}" for c, k in zip(retention_model.EXPORTED, kinds))).repartition(5)
    retention_model.export_dataset(df.withColumn("more", df.account_id), str(tmp_path / "out"))
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0].split(",") == retention_model.EXPORTED
    keys = [(line.split(",")[1], int(line.split(",")[0])) for line in lines if not line.startswith("account_id")]
    assert keys == sorted(keys) and len(keys) == 500
