"""A load that can be run again: tables are written to a staging folder and published by one small file.

Spark has no transaction over several tables. A batch's tables are Parquet under ``<root>/batches/<batch>-<attempt>``;
readers find the current folder through ``<root>/published.json``, which is replaced as a whole after every count has
been reconciled and every reference has an owner. A failed attempt is never visible and never overwrites another.
Control files are small JSON texts written through Hadoop's file system, so the root can be on any store that Spark
writes to; they are reached through the session's JVM gateway, which Spark Connect does not have.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.redaction import redacted_text
from tidemark.operators.quality import summary
from tidemark.plans import constraints
from tidemark.sources.contract import Contract, ContractError, Dataset, bad_lines, check_files, check_plan, read_raw, reconcile, row_counts, target_rows

PROCESS, SKIP = "PROCESS", "SKIP"
PROCESSING, SUCCESS, FAILED = "PROCESSING", "SUCCESS", "FAILED"
EXPIRY = timedelta(days=1)  # after which a lock is taken to be that of a dead process


class BatchConflict(RuntimeError):
    """The batch is registered with other content, or is being processed."""


def decide(state: Mapping | None, fingerprint: str) -> str:
    """What to do with a batch: process new and failed ones, skip those that succeeded; conflicts raise."""
    if state is None:
        return PROCESS
    if state["fingerprint"] != fingerprint:
        raise BatchConflict("the batch is registered with different content")
    if state["status"] == PROCESSING:
        raise BatchConflict("the batch is being processed")
    return {SUCCESS: SKIP, FAILED: PROCESS}[state["status"]]


class Store:
    """Small JSON files under the root, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> dict | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict, new: bool = False) -> None:
        """``new``: fail if the file exists, which makes it a lock. Else the old file stays whole until it is replaced."""
        target = self._path(name)
        path = target if new else self._path(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(path, not new)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        if not new:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
            option = self.jvm.org.apache.hadoop.fs.Options.Rename
            options = self.jvm.java.lang.reflect.Array.newInstance(option.OVERWRITE.getClass(), 1)
            options[0] = option.OVERWRITE
            context.rename(path, target, options)

    def move(self, name: str, to: str) -> bool:
        """False if the file is gone or the other name is taken."""
        return bool(self.fs.rename(self._path(name), self._path(to)))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), False)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds")


def needs_of(contract: Contract) -> dict[int, tuple[int, ...]]:
    """Of each dataset the numbers of those that its columns refer to."""
    number = {d.name: d.number for d in contract.datasets}
    out: dict[int, set[int]] = {n: set() for n in number.values()}
    for name, _, owner, _ in constraints.references({d.name: d.target_columns for d in contract.datasets}):
        out[number[name]].add(number[owner])
    return {n: tuple(sorted(found)) for n, found in out.items()}


def _lock(store: Store, batch: str, run: str) -> None:
    """Takes the batch's lock, also one older than EXPIRY.

    An expired lock is moved aside, which only one of several processes can do; who finds that it has moved another's fresh lock
    puts it back.
    """
    name = f"state/{batch}.lock"
    held = store.read(name)
    if held and datetime.now(timezone.utc) - datetime.fromisoformat(held["at"]) > EXPIRY:
        aside = f"state/{batch}.expired-{run}"
        if store.move(name, aside) and store.read(aside) != held:
            store.move(aside, name)
    try:
        store.write(name, {"at": _now(), "owner": run}, new=True)
    except Exception as e:
        raise BatchConflict(f"the batch is being processed by {(store.read(name) or {}).get('owner')}") from e


def _owned(store: Store, batch: str, run: str) -> bool:
    return (store.read(f"state/{batch}.lock") or {}).get("owner") == run


def _renew(store: Store, batch: str, run: str) -> None:
    """Sets the lock's time anew; BatchConflict if it has passed to another run."""
    if not _owned(store, batch, run):
        raise BatchConflict("the batch's lock has passed to another run")
    store.write(f"state/{batch}.lock", {"at": _now(), "owner": run})


def _observing(spark: SparkSession) -> SparkSession:
    """A session of the same settings in which rows can be observed.

    Once a session has observed rows, Spark 4.1 cannot ship its fitted models with a training summary to tasks any more.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def _write(spark: SparkSession, observing: SparkSession, d: Dataset, source: str, path: str, nullable: frozenset[str]) -> tuple[DataFrame, dict]:
    """Writes one dataset; returns its table and the counters of the writing job: rows read, written and left out as repeats."""
    read, emitted = Observation(), Observation()
    raw = read_raw(observing, d, source).observe(read, F.count(F.lit(1)).alias("n"))
    rows = target_rows(raw, d, nullable).observe(emitted, F.count(F.lit(1)).alias("n"))
    try:
        rows.write.mode("errorifexists").parquet(path)
    except Exception as e:
        if d.format == "jsonl" and (bad := bad_lines(spark, d, source).orderBy("file", "line").limit(5).collect()):
            raise ContractError(f"{d.name}: not an object with the contract's fields: {[(r['file'].rpartition('/')[2], r['line']) for r in bad]}") from e
        raise
    counts = {"raw": read.get["n"], "emitted": emitted.get["n"]}
    return spark.read.schema(rows.schema).parquet(path), counts | {"duplicates": counts["raw"] - counts["emitted"]}


def full_load(
    spark: SparkSession, contract: Contract, root: str, batch: str, nullable: Mapping[str, frozenset[str]] | None = None,
    duplicates: Mapping[str, int] | None = None, replace: bool = False, at_once: int = 4,
) -> dict:
    """Loads all datasets of the contract and publishes them together; returns the run's record.

    Before anything is read, files must exist and have the contract's digests. Datasets are written in the order of
    their references, ``at_once`` of those that do not refer to each other at a time. Before anything is published, the rows read, counted
    by the writing job itself, must be the contract's, those left out as exact repeats the known ones (``duplicates``
    by dataset), and all references must have owners. Where a counter does not agree, which a task that ran twice can cause, the
    table is counted before the load is refused. A root that shows another batch is refused unless ``replace``. The record of each attempt is kept under ``runs/``.
    """
    store, fingerprint = Store(spark, root), contract.fingerprint()
    run = {"run": uuid.uuid4().hex, "batch": batch, "fingerprint": fingerprint, "mode": "full", "started_at": _now(), "datasets_expected": len(contract.datasets)}
    _lock(store, batch, run["run"])
    try:
        state = store.read(f"state/{batch}.json")
        if state and state["status"] == PROCESSING:  # its process ended without a word: the lock was free
            state = state | {"status": FAILED}
        if decide(state, fingerprint) == SKIP:
            return run | {"status": "SKIPPED", "ended_at": _now()}
        shown = store.read("published.json")
        if shown and shown["batch"] != batch and not replace:
            raise BatchConflict(f"the target is not empty: it shows batch {shown['batch']}")
        store.write(f"state/{batch}.json", {"fingerprint": fingerprint, "status": PROCESSING})
        folder = f"batches/{batch}-{run['run']}"
        counters: dict[str, dict] = {}
        stage = "files"
        try:
            check_files(spark, contract)
            by_number = {d.number: d for d in contract.datasets}
            written = {}
            observing = _observing(spark)
            for group in check_plan(contract, needs_of(contract)):
                stage = "write"
                with ThreadPoolExecutor(at_once) as pool:
                    made = {by_number[n].name: pool.submit(_write, spark, observing, by_number[n], contract.root, f"{store.root}/{folder}/{by_number[n].name}", (nullable or {}).get(by_number[n].name, frozenset({"valid_to"}))) for n in group}
                for name, future in made.items():
                    written[name], counters[name] = future.result()
                _renew(store, batch, run["run"])
            stage = "reconcile"
            expected = {d.name: d.rows - (duplicates or {}).get(d.name, 0) for d in contract.datasets}
            odd = [d.name for d in contract.datasets if (counters[d.name]["raw"], counters[d.name]["emitted"]) != (d.rows, expected[d.name])]
            if odd:
                checked = reconcile(row_counts({n: written[n] for n in odd}), {n: expected[n] for n in odd}).collect()  # one row for each dataset
                if wrong := [r.asDict() | {"raw": counters[r["dataset"]]["raw"]} for r in checked if r["status"] != "PASS"]:
                    raise ContractError(f"row counts differ: {wrong}")
                for d in (d for d in contract.datasets if d.name in odd):
                    counters[d.name] = {"raw": d.rows, "emitted": expected[d.name], "duplicates": d.rows - expected[d.name]}
            stage = "references"
            if keys := constraints.foreign_keys(written):
                orphans = summary(keys).where("violations > 0").collect()  # one row for each reference
                if orphans:
                    raise ContractError(f"references without an owner: {[(r['rule'], r['violations']) for r in orphans]}")
            stage = "publish"
            _renew(store, batch, run["run"])
            run |= {"tables": {n: c["emitted"] for n, c in counters.items()}, "target_tables_reconciled": len(written)}
            store.write("published.json", {"folder": folder, "batch": batch, "tables": sorted(written)})
            run |= {"status": SUCCESS, "transaction_outcome": "COMMIT"}
        except Exception as e:
            text = redacted_text(str(e)[:500])
            run |= {"status": FAILED, "transaction_outcome": "ROLLBACK", "failure_stage": stage, "error_type": type(e).__name__, "error_message": text, "error": f"{type(e).__name__}: {text}"}
            raise
        finally:
            total = lambda what: sum(c[what] for c in counters.values())
            run |= {"ended_at": _now(), "counters": counters, "datasets_processed": len(counters), "raw_records_scanned": total("raw"), "duplicates_skipped": total("duplicates"), "rows_loaded": total("emitted")}
            run["duration_ms"] = round((datetime.fromisoformat(run["ended_at"]) - datetime.fromisoformat(run["started_at"])).total_seconds() * 1000)
            if _owned(store, batch, run["run"]):
                store.write(f"state/{batch}.json", {"fingerprint": fingerprint, "status": run.get("status", FAILED)})
            store.write(f"runs/{run['run']}.json", run)
    finally:
        if _owned(store, batch, run["run"]):
            store.delete(f"state/{batch}.lock")
    return run


RUN = (
    "run string, batch string, fingerprint string, mode string, status string, started_at timestamp, ended_at timestamp, duration_ms long, datasets_expected int, "
    "datasets_processed int, raw_records_scanned long, duplicates_skipped long, rows_loaded long, target_tables_reconciled int, transaction_outcome string, "
    "failure_stage string, error_type string, error_message string, error string, counters map<string,struct<raw:bigint,emitted:bigint,duplicates:bigint>>"
)


def runs(spark: SparkSession, root: str) -> DataFrame:
    """All attempts that ended, one row each, with their counters by dataset and in total."""
    return spark.read.schema(RUN).json(f"{root.rstrip('/')}/runs")


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The published tables by name; {} before the first load."""
    now = Store(spark, root).read("published.json")
    return {t: spark.read.parquet(f"{root.rstrip('/')}/{now['folder']}/{t}") for t in now["tables"]} if now else {}
