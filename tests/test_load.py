"""The contract, its readers and the rerun-safe load."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta, timezone

import pytest

from tidemark.plans import load
from tidemark.sources import contract as c


def package(root, rating="5.0", status="FROZEN", event="e1"):
    (root / "a.csv").write_text("account_id\nA1\nA2\n")
    (root / "p.csv").write_text("period_id,account_id,valid_from,valid_to\nP1,A1,2024-01-01T00:00:00Z,\n")
    (root / "r.csv").write_text(f"rating_id,rating_value\nR1,{rating}\n")
    line = {"event_id": "e1", "event_type": "x", "event_time": "2024-01-01T00:00:00Z"}
    again = {k: line[k] for k in reversed(line)} | {"event_id": event}
    (root / "e.jsonl").write_text(json.dumps(line) + "\n\n" + json.dumps(again) + "\n")
    fields = [("account", "a.csv", "csv", 2, ["account_id"]), ("period", "p.csv", "csv", 1, ["period_id", "account_id", "valid_from", "valid_to"]), ("rating", "r.csv", "csv", 1, ["rating_id", "rating_value"]), ("event", "e.jsonl", "jsonl", 2, list(line))]
    digest = lambda p: hashlib.sha256((root / p).read_bytes()).hexdigest()
    datasets = [{"number": i + 1, "dataset": n, "path": p, "format": f, "rows": k, "required_fields": cols, "sha256": digest(p)} for i, (n, p, f, k, cols) in enumerate(fields)]
    (root / "contract.json").write_text(json.dumps({"contract_version": "1.0", "status": status, "datasets_expected": 4, "datasets": datasets}))
    return str(root / "contract.json")


def test_load_publish_skip(spark, tmp_path):
    made = c.load_contract(package(tmp_path))
    root = str(tmp_path / "out")
    run = load.full_load(spark, made, root, "b1", duplicates={"event": 1})
    assert run["status"] == "SUCCESS" and run["tables"] == {"account": 2, "period": 1, "rating": 1, "event": 1}
    t = load.published(spark, root)
    assert t["rating"].first()["rating_value"] == 5 and t["period"].first()["valid_to"] is None
    assert dict(t["period"].dtypes)["valid_from"] == "timestamp_ntz"
    assert load.full_load(spark, made, root, "b1", duplicates={"event": 1})["status"] == "SKIPPED"
    other = c.Contract(made.version, made.root, made.datasets[:1])
    with pytest.raises(load.BatchConflict):
        load.full_load(spark, other, root, "b1")


def test_failed_attempt_stays_invisible_and_can_be_repeated(spark, tmp_path):
    made = c.load_contract(package(tmp_path))
    root = str(tmp_path / "out")
    with pytest.raises(c.ContractError, match="row counts differ"):
        load.full_load(spark, made, root, "b1")  # the repeated event is not announced
    assert load.published(spark, root) == {}
    assert load.full_load(spark, made, root, "b1", duplicates={"event": 1})["status"] == "SUCCESS"


def refused(spark, made, root, message):
    with pytest.raises(c.ContractError, match=message):
        load.full_load(spark, made, root, "b1", duplicates={"event": 1})
    assert load.published(spark, root) == {}
    assert [r.status for r in load.runs(spark, root).collect()] == ["FAILED"]


def test_wrong_digest_is_refused(spark, tmp_path):
    made = c.load_contract(package(tmp_path))
    (tmp_path / "a.csv").write_text("account_id\nA1\nA3\n")
    refused(spark, made, str(tmp_path / "out"), "SHA-256 differs from the contract's: ..account")


def test_missing_file_is_refused(spark, tmp_path):
    made = c.load_contract(package(tmp_path))
    (tmp_path / "r.csv").unlink()
    refused(spark, made, str(tmp_path / "out"), "missing: ..r.csv")


def test_orphans_are_refused(spark, tmp_path):
    package(tmp_path)
    (tmp_path / "p.csv").write_text("period_id,account_id,valid_from,valid_to\nP1,A9,2024-01-01T00:00:00Z,\n")
    raw = json.loads((tmp_path / "contract.json").read_text())
    raw["datasets"][1]["sha256"] = hashlib.sha256((tmp_path / "p.csv").read_bytes()).hexdigest()
    (tmp_path / "contract.json").write_text(json.dumps(raw))
    refused(spark, c.load_contract(str(tmp_path / "contract.json")), str(tmp_path / "out"), "without an owner: .*period.account_id")


def test_plan_order_and_totals(tmp_path):
    made = c.load_contract(package(tmp_path))
    assert load.needs_of(made) == {1: (), 2: (1,), 3: (), 4: ()}
    assert c.check_plan(made, load.needs_of(made), 6) == [[1, 3, 4], [2]]
    with pytest.raises(c.ContractError, match="6 rows, the plan 7"):
        c.check_plan(made, load.needs_of(made), 7)
    with pytest.raises(c.ContractError, match="differ in"):
        c.check_plan(made, {1: (), 2: (1,)})


def test_target_with_another_batch_is_refused(spark, tmp_path):
    made, root = c.load_contract(package(tmp_path)), str(tmp_path / "out")
    load.full_load(spark, made, root, "b1", duplicates={"event": 1})
    with pytest.raises(load.BatchConflict, match="not empty"):
        load.full_load(spark, made, root, "b2", duplicates={"event": 1})
    assert load.full_load(spark, made, root, "b2", duplicates={"event": 1}, replace=True)["status"] == "SUCCESS"
    assert sorted(r.batch for r in load.runs(spark, root).collect()) == ["b1", "b2"]


def test_lock_of_a_dead_process_expires(spark, tmp_path):
    made, root = c.load_contract(package(tmp_path)), str(tmp_path / "out")
    store = load.Store(spark, root)
    store.write("state/b1.lock", {"at": datetime.now(timezone.utc).isoformat(), "owner": "r9"}, new=True)
    with pytest.raises(load.BatchConflict, match="r9"):
        load.full_load(spark, made, root, "b1", duplicates={"event": 1})
    store.write("state/b1.lock", {"at": (datetime.now(timezone.utc) - timedelta(days=2)).isoformat(), "owner": "r9"})
    assert load.full_load(spark, made, root, "b1", duplicates={"event": 1})["status"] == "SUCCESS"


@pytest.mark.parametrize("change, message", [({"rating": "4.5"}, "no whole number"), ({"rating": ""}, "is empty")])
def test_bad_values_fail(spark, tmp_path, change, message):
    made = c.load_contract(package(tmp_path, **change))
    with pytest.raises(Exception, match=message):
        c.target_rows(c.read_raw(spark, made["rating"], made.root), made["rating"]).collect()


def test_unexpected_and_missing_fields_fail(spark, tmp_path):
    made = c.load_contract(package(tmp_path))
    (tmp_path / "e.jsonl").write_text('{"event_id": "e1", "event_type": "x", "event_time": "y", "more": 1}\n')
    with pytest.raises(Exception, match="contract's fields"):
        c.read_raw(spark, made["event"], made.root).collect()
    (tmp_path / "a.csv").write_text("other_id\nA1\n")
    with pytest.raises(Exception, match="(?i)header|conform"):
        c.read_raw(spark, made["account"], made.root).collect()


def test_contract_checks(tmp_path):
    with pytest.raises(c.ContractError, match="FROZEN"):
        c.load_contract(package(tmp_path, status="DRAFT"))
    assert c.load_order({1: (), 2: (1,), 3: (1, 2)}) == [[1], [2], [3]]
    with pytest.raises(c.ContractError, match="circle"):
        c.load_order({1: (2,), 2: (1,)})


@pytest.mark.parametrize("state, expected", [(None, "PROCESS"), ({"fingerprint": "f", "status": "FAILED"}, "PROCESS"), ({"fingerprint": "f", "status": "SUCCESS"}, "SKIP")])
def test_decide(state, expected):
    assert load.decide(state, "f") == expected


def test_decide_conflicts():
    for state in ({"fingerprint": "g", "status": "FAILED"}, {"fingerprint": "f", "status": "PROCESSING"}):
        with pytest.raises(load.BatchConflict):
            load.decide(state, "f")


def test_counters_come_with_the_record(spark, tmp_path):
    made, root = c.load_contract(package(tmp_path)), str(tmp_path / "out")
    load.full_load(spark, made, root, "b1", duplicates={"event": 1})
    r = load.runs(spark, root).first()
    assert (r.raw_records_scanned, r.rows_loaded, r.duplicates_skipped, r.datasets_processed, r.transaction_outcome) == (6, 5, 1, 4, "COMMIT")
    assert r.counters["event"].asDict() == {"raw": 2, "emitted": 1, "duplicates": 1} and r.duration_ms > 0 and r.failure_stage is None


def test_failed_stage_is_recorded(spark, tmp_path):
    made, root = c.load_contract(package(tmp_path)), str(tmp_path / "out")
    with pytest.raises(c.ContractError):
        load.full_load(spark, made, root, "b1")
    r = load.runs(spark, root).first()
    assert (r.failure_stage, r.error_type, r.transaction_outcome, r.raw_records_scanned) == ("reconcile", "ContractError", "ROLLBACK", 6)


def test_only_one_run_takes_an_expired_lock_and_none_frees_anothers(spark, tmp_path):
    store, old = load.Store(spark, str(tmp_path)), (datetime.now(timezone.utc) - timedelta(days=2)).isoformat()
    store.write("state/b.lock", {"at": old, "owner": "r0"})
    load._lock(store, "b", "r1")
    with pytest.raises(load.BatchConflict, match="r1"):
        load._lock(store, "b", "r2")
    with pytest.raises(load.BatchConflict, match="passed"):
        load._renew(store, "b", "r2")
    load._renew(store, "b", "r1")
    assert load._owned(store, "b", "r1") and not load._owned(store, "b", "r2")


def test_bad_lines_are_named_by_file_and_line(spark, tmp_path):
    made = c.load_contract(package(tmp_path))
    good = json.dumps({"event_id": "e", "event_type": "x" * 50, "event_time": "2024-01-01T00:00:00Z"})
    lines = [good if i % 97 else "" for i in range(3000)]
    lines[7], lines[1234], lines[2999] = "[1]", '{"event_id": 1}', '{"event_id": '
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        found = c.bad_lines(spark, made["event"], made.root)
        assert sorted(r["line"] for r in found.collect()) == [8, 1235, 3000]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    raw = json.loads((tmp_path / "contract.json").read_text())
    raw["datasets"][3]["sha256"] = hashlib.sha256((tmp_path / "e.jsonl").read_bytes()).hexdigest()
    (tmp_path / "contract.json").write_text(json.dumps(raw))
    refused(spark, c.load_contract(str(tmp_path / "contract.json")), str(tmp_path / "out"), r"'e.jsonl', 8.*'e.jsonl', 1235")


def test_large_files_are_digested_in_pieces(spark, tmp_path):
    path = tmp_path / "large"
    with path.open("wb") as f:
        f.truncate(3 << 30)
    sha = hashlib.sha256()
    for _ in range(3 << 6):
        sha.update(bytes(1 << 24))
    assert tuple(c.file_digests(spark, [f"file:{path}"]).first()) == (f"file:{path}", sha.hexdigest(), 3 << 30)
