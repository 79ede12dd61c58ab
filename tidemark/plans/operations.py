"""What operators of the load and its reports call: checks before a run, exports with a manifest, reports."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import load
from tidemark.sources.contract import TIME_FORMAT, Contract, ContractError, check_files, check_plan, load_contract

BATCH = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")


def batch_id(contract: Contract, given: str | None = None) -> str:
    """The given id if it is fit for a file name, else one that follows from the contract's version and content."""
    if given is None:
        return f"v{contract.version}-{contract.fingerprint()[:12]}"
    if not BATCH.fullmatch(given):
        raise ContractError(f"{given!r} is no batch id: up to 64 letters, digits, dots, dashes and underscores")
    return given


def validate(spark: SparkSession, path: str, root: str | None = None) -> Contract:
    """The contract at a path, on any store that Spark reads, read and checked, with all its files present and unchanged."""
    contract = load_contract(path, root, spark)
    check_files(spark, contract)
    return contract


def plan_check(contract: Contract, total_rows: int | None = None) -> list[list[str]]:
    """Names of the datasets in the groups in which they are loaded."""
    name = {d.number: d.name for d in contract.datasets}
    return [[name[n] for n in group] for group in check_plan(contract, load.needs_of(contract), total_rows)]


def catalog(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """(table_name, column_name, ordinal, data_type) of tables, from their schemas alone; None without tables."""
    rows = [(name, f.name, i + 1, f.dataType.simpleString()) for name, df in sorted(tables.items()) for i, f in enumerate(df.schema)]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string") if rows else None


def stored_catalog(spark: SparkSession, root: str) -> DataFrame | None:
    """As ``catalog``, of the tables that a store has published and of the views computed from them; None for an empty store."""
    return catalog(load.published(spark, root) | published_views(spark, root))


def publish_views(views: Mapping[str, DataFrame], root: str) -> list[str]:
    """Computes views into tables that outlive the session, and shows all of them at once, in place of those shown before.

    Each is written under a folder of this call; one small file names the folder that readers take.
    """
    spark = next(iter(views.values())).sparkSession
    folder = f"views/{uuid.uuid4().hex}"
    for name, df in views.items():
        df.write.parquet(f"{root.rstrip('/')}/{folder}/{name}")
    load.Store(spark, root).write("views.json", {"folder": folder, "views": sorted(views)})
    return sorted(views)


def published_views(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The published views by name; {} before there are any."""
    now = load.Store(spark, root).read("views.json")
    return {v: spark.read.parquet(f"{root.rstrip('/')}/{now['folder']}/{v}") for v in now["views"]} if now else {}


def target_check(spark: SparkSession, contract: Contract, root: str) -> DataFrame:
    """(dataset, missing, unexpected, status) of the published tables against the contract's target columns."""
    shown = load.published(spark, root)
    rows = []
    for d in contract.datasets:
        have, want = (shown[d.name].columns if d.name in shown else []), d.target_columns
        missing, more = [c for c in want if c not in have], [c for c in have if c not in want]
        rows.append((d.name, missing, more, "FAIL" if missing or more else "PASS"))
    return spark.createDataFrame(rows, "dataset string, missing array<string>, unexpected array<string>, status string")


def export(tables: Mapping[str, DataFrame], root: str, formats: Mapping[str, str] | None = None) -> DataFrame:
    """Writes tables as CSV (with a header) or JSON lines, and a manifest (dataset, format, rows, columns) beside them.

    A table is a folder of files, written by all tasks; ``formats`` names the table's format, csv by default. Rows are
    counted from what was written.
    """
    made = []
    for name, df in tables.items():
        kind, path = (formats or {}).get(name, "csv"), f"{root.rstrip('/')}/{name}"
        if kind not in ("csv", "jsonl"):
            raise ValueError(f"{name}: unknown format {kind}")
        if kind == "csv":
            df.write.option("timestampNTZFormat", TIME_FORMAT).csv(path, header=True, timestampFormat=TIME_FORMAT)
        else:
            df.write.json(path, ignoreNullFields=False)
        schema = ", ".join(f"`{c}` string" for c in df.columns)
        back = df.sparkSession.read.csv(path, schema=schema, header=True) if kind == "csv" else df.sparkSession.read.schema(schema).json(path)
        made.append((name, kind, back.count(), df.columns))
    spark = next(iter(tables.values())).sparkSession
    manifest = spark.createDataFrame(made, "dataset string, format string, rows long, columns array<string>")
    manifest.coalesce(1).write.json(f"{root.rstrip('/')}/manifest")  # one row for each table
    return manifest


def report_text(results: DataFrame, title: str, most: int = 1000) -> tuple[str, str]:
    """A result of bounded size (verdicts, reconciliations, samples) as JSON and as a Markdown table; ValueError beyond ``most`` rows."""
    rows = results.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    plain = [{k: None if v is None else v if isinstance(v, (bool, int, float)) else str(v) for k, v in r.asDict().items()} for r in rows]
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(results.columns) + " |", "|" + "---|" * len(results.columns)]
    lines += ["| " + " | ".join(cell(r[c]) for c in results.columns) + " |" for r in plain]
    return json.dumps({"title": title, "rows": plain}, indent=1), "\n".join(lines) + "\n"


def with_evidence(spark: SparkSession, contract: Contract, root: str, batch: str, **options) -> tuple[dict, str]:
    """full_load, and a Markdown account of it; a failed load raises after its record is kept, with secrets redacted."""
    run = load.full_load(spark, contract, root, batch, **options)
    counts = spark.createDataFrame(sorted(run.get("tables", {}).items()), "dataset string, rows long")
    return run, report_text(counts, f"Load of {batch}: {run['status']}")[1]
