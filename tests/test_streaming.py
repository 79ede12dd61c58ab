"""Streams: late rows, repeats across batches, and batches that run again."""

from __future__ import annotations

import shutil

from tidemark.streaming import windows

SCHEMA = "event_id string, event_time timestamp, user string"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, "event_id string, event_time string, user string").coalesce(1).write.mode("append").json(str(folder / name))


def read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/*")


def test_batches_are_written_once(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    put(spark, source, "a", [("e1", "2024-01-01T00:00:00Z", "u"), ("e1", "2024-01-01T00:00:00Z", "u"), ("e2", "2024-01-01T00:01:00Z", "v")])
    windows.write_once(read(spark, source), out, check, "event_id").awaitTermination()
    put(spark, source, "b", [("e3", "2024-01-01T00:02:00Z", "u")])
    windows.write_once(read(spark, source), out, check, "event_id").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["e1", "e2", "e3"]
    shutil.rmtree(f"{check}/commits")  # as if the last batch had failed after its rows were written: all run again
    windows.write_once(read(spark, source), out, check, "event_id").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["e1", "e2", "e3"]


def test_repeats_across_batches_and_late_rows(spark, tmp_path):
    source = tmp_path / "in"
    put(spark, source, "a", [("e1", "2024-01-01T00:00:00Z", "u"), ("e2", "2024-01-03T00:00:00Z", "u")])
    put(spark, source, "b", [("e2", "2024-01-03T00:00:00Z", "u"), ("e3", "2024-01-03T01:00:00Z", "u")])
    put(spark, source, "c", [("e4", "2023-12-01T00:00:00Z", "u"), ("e5", "2024-01-03T02:00:00Z", "u")])
    once = windows.deliveries_once(read(spark, source), "event_id", "event_time", "1 hour")
    windows.write_once(once, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == ["e1", "e2", "e3", "e5"]  # e4 is later than the watermark allows
