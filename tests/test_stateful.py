"""Streams with state: conflicts, late rows, joins with periods, restarts, bounded state."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import deliveries as batch
from tidemark.streaming import stateful as m

ZERO = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    m.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / name))


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def at(hours: float) -> datetime:
    return ZERO + timedelta(hours=hours)


def test_conflicts_have_an_output_of_their_own_and_survive_a_restart(spark, tmp_path):
    schema, out, check = "event_id string, x int, t timestamp", str(tmp_path / "out"), str(tmp_path / "check")
    first = [(k, x, at(1)) for k, x in [("a", 1), ("a", 1), ("b", 1), ("c", 1), ("c", 2)]]
    second = [(k, x, at(1)) for k, x in [("a", 1), ("b", 2), ("b", None), ("d", None), ("d", None)]] + [("e", 1, None)]
    put(spark, tmp_path / "in", "1", first, schema)
    m.split_once(m.deliveries(read(spark, tmp_path / "in", schema), "event_id", "t"), out, check).awaitTermination()
    put(spark, tmp_path / "in", "2", second, schema)
    m.split_once(m.deliveries(read(spark, tmp_path / "in", schema), "event_id", "t"), out, check).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r["event_id"] for r in got.where("outcome = 'new'").collect()) == ["a", "b", "c", "d", "e"]
    conflicting = {r["event_id"] for r in got.where("outcome = 'conflict'").collect()}
    every = spark.createDataFrame(first + second, schema)
    assert conflicting == {r["event_id"] for r in batch.conflicts(every, "event_id").collect()} == {"b", "c"}
    assert got.where("outcome = 'conflict'").count() == 3
    assert sorted(r["x"] or 0 for r in got.where("event_id = 'b'").collect()) == [0, 1, 2]


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path):
    schema = "event_id string, x int, t timestamp"
    for n in range(6):
        put(spark, tmp_path / "in", str(n), [(f"e{n}-{i}", i, at(100 * n)) for i in range(10)], schema)
    query = m.split_once(m.deliveries(read(spark, tmp_path / "in", schema), "event_id", "t"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60 and max(rows[3:]) <= max(rows[:3])


def test_late_and_timely_rows_together_are_all_rows(spark, tmp_path):
    schema = "i int, t timestamp"
    for n, hours in enumerate(([0, 1, 2], [50, 1.5, 49.5], [49.2, 3, 51], [48, 50.5])):
        put(spark, tmp_path / "in", str(n), [(100 * n + i, at(h)) for i, h in enumerate(hours)] + [(100 * n + 99, None)], schema)
    out = str(tmp_path / "out")
    m.split_once(m.lateness(read(spark, tmp_path / "in", schema), "t", "1 hour"), out, str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(out)
    late = sorted(r["i"] for r in got.where("outcome = 'late'").collect())
    assert late == [201, 300] and got.count() == 15 and got.select("i").distinct().count() == 15


def test_events_meet_periods_of_another_stream(spark, tmp_path):
    events, periods = "k string, i int, t timestamp", "k string, p int, a timestamp, b timestamp"
    put(spark, tmp_path / "e", "1", [("x", 1, at(1)), ("x", 2, at(5)), ("y", 3, at(1)), ("z", 4, at(2))], events)
    put(spark, tmp_path / "p", "1", [("x", 1, at(0), at(5)), ("x", 2, at(0.5), at(2)), ("y", 3, at(1), None)], periods)
    put(spark, tmp_path / "e", "2", [("x", 5, at(20)), ("y", 6, at(100))], events)
    put(spark, tmp_path / "p", "2", [("x", 4, at(5), at(30))], periods)
    put(spark, tmp_path / "e", "3", [("y", 7, at(200))], events)
    put(spark, tmp_path / "e", "4", [("y", 8, at(300))], events)
    joined = m.events_in_periods(read(spark, tmp_path / "e", events), read(spark, tmp_path / "p", periods), "k", "t", "a", "b")
    m.split_once(joined, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted((r["outcome"], json.loads(r["event"])["i"], json.loads(r["period"])["p"] if r["period"] else 0) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("joined", 1, 1), ("joined", 1, 2), ("joined", 2, 4), ("joined", 3, 3), ("joined", 5, 4), ("joined", 6, 3), ("joined", 7, 3), ("joined", 8, 3), ("unmatched", 4, 0)]


def test_state_does_not_grow_over_a_long_replay(spark, tmp_path):
    events, periods = "k string, i int, t timestamp", "k string, p int, a timestamp, b timestamp"
    for n in range(8):
        put(spark, tmp_path / "e", f"{n}", [(f"k{n}-{i}", i, at(100 * n + 1)) for i in range(20)], events)
        put(spark, tmp_path / "p", f"{n}", [(f"k{n}-{i}", i, at(100 * n), at(100 * n + 2)) for i in range(20)], periods)
    joined = m.events_in_periods(read(spark, tmp_path / "e", events), read(spark, tmp_path / "p", periods), "k", "t", "a", "b")
    query = m.split_once(joined, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("outcome") == "joined").count() == 160
    assert len(rows) >= 8 and max(rows[4:]) <= max(rows[:4])
