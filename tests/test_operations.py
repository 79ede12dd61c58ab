"""Checks before a run, exports, reports and redaction."""

from __future__ import annotations

import json

import pytest
from tests.test_load import package

from tidemark.functions.redaction import redacted, redacted_text
from tidemark.plans import load, operations
from tidemark.sources import contract as c


def test_redaction(spark):
    cases = {
        "jdbc:postgresql://bob:pa55@db:5432/x failed": "jdbc:postgresql://bob:***@db:5432/x failed",
        'password = "a b", user=x': "password = ***, user=x", "API_KEY=abc123;next": "API_KEY=***;next", "Authorization: Bearer abcdef0123456789": "Authorization: Bearer ***",
        "nothing to hide: the tokens are words": "nothing to hide: the tokens are words",
    }
    assert {k: redacted_text(k) for k in cases} == cases
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    assert {r.t: r.s for r in df.select("t", redacted(df.t).alias("s")).collect()} == cases | {None: None}


def test_checks_before_a_run(spark, tmp_path):
    made = operations.validate(spark, package(tmp_path))
    assert operations.plan_check(made, 6) == [["account", "rating", "event"], ["period"]]
    assert operations.batch_id(made, "b-1") == "b-1" and operations.batch_id(made) == f"v1.0-{made.fingerprint()[:12]}"
    with pytest.raises(c.ContractError, match="no batch id"):
        operations.batch_id(made, "../b")
    root = str(tmp_path / "out")
    assert {r.status for r in operations.target_check(spark, made, root).collect()} == {"FAIL"}
    run, text = operations.with_evidence(spark, made, root, "b1", duplicates={"event": 1})
    assert run["status"] == "SUCCESS" and "| account | 2 |" in text and text.startswith("# Load of b1: SUCCESS")
    assert {r.status for r in operations.target_check(spark, made, root).collect()} == {"PASS"}
    found = operations.catalog(load.published(spark, root)).where("table_name = 'period'").orderBy("ordinal").collect()
    assert [(r.column_name, r.data_type) for r in found][:3] == [("period_id", "string"), ("account_id", "string"), ("valid_from", "timestamp_ntz")]


def test_export_and_report(spark, tmp_path):
    a = spark.createDataFrame([(1, 'x, "y"'), (2, None)], "id int, t string").repartition(2)
    root = str(tmp_path / "out")
    got = {r.dataset: (r.format, r.rows) for r in operations.export({"a": a, "b": a}, root, {"b": "jsonl"}).collect()}
    assert got == {"a": ("csv", 2), "b": ("jsonl", 2)}
    assert {(r.id, r.t) for r in spark.read.csv(f"{root}/a", header=True, schema="id int, t string", escape='"').collect()} | {(1, 'x, "y"')} >= {(2, None)}
    assert sorted((r.id, r.t) for r in spark.read.schema("id int, t string").json(f"{root}/b").collect())[0] == (1, 'x, "y"')
    assert spark.read.json(f"{root}/manifest").count() == 2
    as_json, as_text = operations.report_text(a.orderBy("id"), "A")
    assert json.loads(as_json)["rows"] == [{"id": 1, "t": 'x, "y"'}, {"id": 2, "t": None}]
    assert as_text.splitlines()[2:] == ["| id | t |", "|---|---|", '| 1 | x, "y" |', "| 2 |  |"]
    with pytest.raises(ValueError, match="more than 1"):
        operations.report_text(a, "A", 1)
    with pytest.raises(ValueError, match="format"):
        operations.export({"c": a}, root, {"c": "xml"})


def test_views_outlive_their_session_and_are_replaced_together(spark, tmp_path):
    root, other = str(tmp_path / "out"), spark.newSession()
    assert operations.stored_catalog(spark, root) is None
    a, b = spark.createDataFrame([(1, "x")], "id int, t string"), spark.createDataFrame([(2.5,)], "v double")
    assert operations.publish_views({"vw_a": a, "vw_b": b}, root) == ["vw_a", "vw_b"]
    assert {n: [tuple(r) for r in df.collect()] for n, df in operations.published_views(other, root).items()} == {"vw_a": [(1, "x")], "vw_b": [(2.5,)]}
    operations.publish_views({"vw_a": a.union(a)}, root)
    assert [n for n in operations.published_views(other, root)] == ["vw_a"] and operations.published_views(other, root)["vw_a"].count() == 2
    assert [(r.table_name, r.column_name, r.data_type) for r in operations.stored_catalog(other, root).orderBy("ordinal").collect()] == [("vw_a", "id", "int"), ("vw_a", "t", "string")]


def test_contract_is_read_through_spark(spark, tmp_path):
    path = package(tmp_path)
    made = c.load_contract(f"file://{path}", spark=spark)
    assert made.datasets == c.load_contract(path).datasets and made.root == f"file://{tmp_path}"
    assert operations.validate(spark, f"file://{path}").datasets == made.datasets
