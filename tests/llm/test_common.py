"""Shared storage where no checkpoint folder is set, and options that are put back."""

from __future__ import annotations

import os
import subprocess
import sys

from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.common import arrow_batches, emptied, sieved, written

CODE = """
from pyspark.sql import SparkSession
from tidemark.llm.common import shared_folder, written
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
print("rows", written(spark.range(3), "x").count(), shared_folder(spark) == shared_folder(spark))
"""


def test_a_local_session_without_a_folder_makes_one(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=120)
    assert "rows 3 True" in done.stdout, done.stderr[-2000:]


def test_options_are_put_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    with arrow_batches(spark, 7):
        assert spark.conf.get(name) == "7"
    assert spark.conf.get(name) == old


def test_sieve_keeps_all_keys_and_few_others(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h")).unionByName(spark.createDataFrame([(0,), (-1,), (None,), (2**63 - 1,), (-(2**63),)], "h long"))
    rows = keys.unionByName(spark.range(3000, 60_000).select(F.xxhash64("id").alias("h"))).withColumn("_bit", F.lit("kept"))
    got = sieved(rows.withColumnRenamed("_bit", "x"), keys, "h")
    assert got.columns == ["h", "x"]
    assert got.join(keys, "h", "left_semi").count() == 3004 and got.count() < 3004 + 60
    assert sieved(rows.drop("_bit"), keys.limit(0), "h").count() == 0


def test_emptied_tables_read_as_empty(spark):
    t = written(spark.range(50), "test-emptied")
    emptied(t, t.limit(0))
    assert spark.read.parquet(t.inputFiles()[0].rsplit("/", 1)[0]).count() == 0


def test_sieve_is_as_large_as_its_keys_ask_for(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(common, "written", lambda df, label: tables.append(df.localCheckpoint()) or tables[-1])
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    for keys, maps in ((0, 0), (1, 1), (1000, 1), (5000, 8)):
        passed = common.sieved(rows, rows.limit(keys).localCheckpoint(), "h", sparse=32)
        assert keys <= passed.count() <= keys + 20_000 / 32 * 1.5
        assert tables[-1].count() <= maps
