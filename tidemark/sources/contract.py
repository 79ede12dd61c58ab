"""Sources declared by an input contract: checks, readers and the projection onto target tables.

Schemas are declared, never inferred: a dataset's columns are its required fields, and a column's type follows from
its name. All values are read as text, checked, then cast, so that a bad value is reported and not silently nulled.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import deliveries
from tidemark.session import ship

# Names of time and integer columns, source fields that targets do not keep, and datasets of deliveries.
TIMES, WHOLE = ("event_time", "valid_from", "valid_to", "invitation_time", "attributed_at"), ("rating_value",)
DROPPED = {8: ("user_id", "account_id"), 36: ("website_id",)}
FORMATS = ("csv", "jsonl")
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


class ContractError(ValueError):
    """The contract, or a source against it, is wrong."""


@dataclass(frozen=True)
class Dataset:
    number: int
    name: str
    path: str
    format: str
    rows: int
    fields: tuple[str, ...]
    sha256: str | None = None

    @property
    def target_columns(self) -> list[str]:
        return [f for f in self.fields if f not in DROPPED.get(self.number, ())]

    @property
    def is_deliveries(self) -> bool:
        """JSON-lines datasets hold event deliveries, which may repeat."""
        return self.format == "jsonl" and "event_id" in self.fields


@dataclass(frozen=True)
class Contract:
    version: str
    root: str
    datasets: tuple[Dataset, ...]

    def __getitem__(self, name: str) -> Dataset:
        return next(d for d in self.datasets if d.name == name)

    def fingerprint(self) -> str:
        """SHA-256 over the sorted numbers and digests of the datasets."""
        parts = sorted((d.number, d.sha256 or "") for d in self.datasets)
        return hashlib.sha256(json.dumps(parts, separators=(",", ":")).encode()).hexdigest()


def load_contract(path: str, root: str | None = None, spark: SparkSession | None = None) -> Contract:
    """Reads and checks a contract: frozen, as many datasets as it expects, unique numbers and names, known formats.

    With a session the path may be on any store that Spark reads; else it is the driver's own file.
    """
    text = spark.read.text(path, wholetext=True).first() if spark else [Path(path).read_text()]
    if text is None:
        raise ContractError("the contract is empty")
    raw = json.loads(text[0])
    if raw.get("status") != "FROZEN":
        raise ContractError(f"the contract is {raw.get('status')!r}, not FROZEN")
    made = tuple(Dataset(d["number"], d["dataset"], d.get("path", ""), d["format"], d["rows"], tuple(d["required_fields"]), d.get("sha256")) for d in raw["datasets"])
    if len(made) != raw["datasets_expected"]:
        raise ContractError(f"{len(made)} datasets, {raw['datasets_expected']} expected")
    for what in ("number", "name"):
        if len({getattr(d, what) for d in made}) != len(made):
            raise ContractError(f"a dataset's {what} occurs twice")
    if wrong := [d.name for d in made if d.format not in FORMATS or not d.fields]:
        raise ContractError(f"unknown format or no fields: {wrong}")
    return Contract(raw["contract_version"], root or path.rpartition("/")[0] or ".", made)


def load_order(needs: Mapping[int, tuple[int, ...]]) -> list[list[int]]:
    """Groups of datasets, each after all that it needs; ContractError for unknown or circular needs."""
    if unknown := {n for ns in needs.values() for n in ns} - set(needs):
        raise ContractError(f"unknown datasets {sorted(unknown)}")
    groups, done = [], set()
    while len(done) < len(needs):
        ready = sorted(n for n, ns in needs.items() if n not in done and done.issuperset(ns))
        if not ready:
            raise ContractError("datasets need each other in a circle")
        groups.append(ready)
        done.update(ready)
    return groups


# ---------------------------------------------------------------- readers


def read_raw(spark: SparkSession, d: Dataset, root: str) -> DataFrame:
    """All columns as text. CSV headers must be the fields in order; JSON lines must be objects with just these keys."""
    path = f"{root}/{d.path}"
    if d.format == "csv":
        schema = ", ".join(f"`{f}` string" for f in d.fields)
        return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)
    lines = spark.read.text(path).where("trim(value) != ''")
    message = F.concat(F.lit(f"{d.name}: not an object with the contract's fields: "), F.substring("value", 1, 200))
    checked = F.when(_bad(d), F.raise_error(message)).otherwise(F.col("m"))
    return lines.select("value", _parsed().alias("m")).select(checked.alias("m")).select(*[F.col("m")[f].alias(f) for f in d.fields])


def _parsed() -> Column:
    return F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})


def _bad(d: Dataset) -> Column:
    """Whether ``value``, parsed as ``m``, is no object with just the dataset's fields."""
    wanted = F.lit(json.dumps(sorted(d.fields), separators=(",", ":")))
    return ~F.trim("value").startswith("{") | F.col("m").isNull() | (F.to_json(F.array_sort(F.map_keys("m"))) != wanted)


def bad_lines(spark: SparkSession, d: Dataset, root: str) -> DataFrame:
    """(file, line, text) of the lines of a JSON-lines dataset that are no objects with the contract's fields; lines count from 1.

    Files are read in ranges by as many tasks as Spark likes. A line's number is its place in its range plus the lines of
    the file's earlier ranges, which are counted and summed: one row for each range.
    """
    rows = spark.read.option("lineSep", "\n").text(f"{root}/{d.path}")
    place = F.monotonically_increasing_id()
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), place.alias("place"))
    ranges = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    bad = rows.where("trim(value) != ''").withColumn("m", _parsed()).where(_bad(d)).join(ranges, ["file", "block"])
    return bad.select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line"), F.substring("value", 1, 200).alias("text"))


def _typed(d: Dataset, name: str, nullable: bool) -> Column:
    text = F.when(F.trim(name) != "", F.trim(name)) if nullable else F.col(name)
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{d.name}.{name} {why}: "), F.coalesce(name, F.lit("null"))))
    if name in TIMES:
        value = F.expr(f"try_to_timestamp(`{name}`, \"{TIME_FORMAT}\")").cast("timestamp_ntz")
        typed = F.when(text.isNull(), F.lit(None)).when(value.isNull(), fail("is no time")).otherwise(value)
    elif name in WHOLE:
        value = F.expr(f"try_cast(`{name}` AS decimal(38, 10))")
        typed = F.when(text.isNull(), F.lit(None)).when(value.isNull() | (value != F.floor(value)), fail("is no whole number")).otherwise(value.cast("int"))
    else:
        typed = text
    if not nullable:
        typed = F.when(F.coalesce(F.trim(name), F.lit("")) == "", fail("is empty")).otherwise(typed)
    return typed.alias(name)


def target_rows(raw: DataFrame, d: Dataset, nullable: frozenset[str] = frozenset({"valid_to"})) -> DataFrame:
    """The target table's rows: projected, blank to null where nullable (else an error), typed, and delivered once.

    An error is raised by the job that reads the bad row.
    """
    if raw.columns != list(d.fields):
        raise ContractError(f"{d.name}: columns {raw.columns}, expected {list(d.fields)}")
    rows = deliveries.once(raw, "event_id") if d.is_deliveries else raw
    return rows.select(*[_typed(d, c, c in nullable) for c in d.target_columns])


# ---------------------------------------------------------------- integrity


PIECE = 1 << 20


def check_files(spark: SparkSession, contract: Contract) -> None:
    """ContractError for files that are missing or have another SHA-256 than the contract's.

    Names come from a listing; contents are read and digested by one task a file. Datasets without a digest in the
    contract are only looked for.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(contract.root).select("path", "length")
    wanted = spark.createDataFrame([(d.name, "/" + d.path.lstrip("/")) for d in contract.datasets], "dataset string, ending string")
    found = {r["dataset"]: r for r in listed.join(F.broadcast(wanted), F.expr("endswith(path, ending)")).collect()}  # one row for each dataset
    if missing := [d.path for d in contract.datasets if d.name not in found]:
        raise ContractError(f"files are missing: {missing}")
    known = {found[d.name]["path"]: d for d in contract.datasets if d.sha256}
    digests = file_digests(spark, list(known)).collect() if known else []  # one row for each dataset
    if wrong := [known[r["path"]].name for r in digests if r["sha256"] != known[r["path"]].sha256]:
        raise ContractError(f"SHA-256 differs from the contract's: {sorted(wrong)}")


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256, bytes) of files of any size, each read by one task in pieces of PIECE bytes.

    Files are opened through Arrow's file systems, which know local paths and the usual stores.
    """
    ship(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                sha, size = hashlib.sha256(), 0
                with _opened(path) as stream:
                    while piece := stream.read(PIECE):
                        sha.update(piece)
                        size += len(piece)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sha.hexdigest()]), pa.array([size])], ["path", "sha256", "bytes"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInArrow(digest, "path string, sha256 string, bytes long")


def _opened(path: str):
    """A stream of the file's bytes."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem().open_input_stream(path)
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_stream(name)


def check_plan(contract: Contract, needs: Mapping[int, tuple[int, ...]], total_rows: int | None = None) -> list[list[int]]:
    """The groups of ``load_order``; ContractError unless the needs cover just the contract's datasets, and its rows add up."""
    if set(needs) != {d.number for d in contract.datasets}:
        raise ContractError(f"the plan and the contract differ in {sorted(set(needs) ^ {d.number for d in contract.datasets})}")
    if total_rows is not None and sum(d.rows for d in contract.datasets) != total_rows:
        raise ContractError(f"the contract has {sum(d.rows for d in contract.datasets)} rows, the plan {total_rows}")
    return load_order(needs)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, actual) of all tables, in one job."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("actual")).select(F.lit(name).alias("dataset"), "actual")
        out = one if out is None else out.unionByName(one)
    return out


def reconcile(counts: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """(dataset, expected, actual, status) of all expected datasets; missing ones count 0."""
    wanted = counts.sparkSession.createDataFrame(list(expected.items()), "dataset string, expected long")
    actual = F.coalesce("actual", F.lit(0))
    return wanted.join(counts, "dataset", "left").select("dataset", "expected", actual.alias("actual"), F.when(actual == F.col("expected"), "PASS").otherwise("FAIL").alias("status"))
