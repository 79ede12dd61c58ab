"""Stateful streams on Spark's own state store: deliveries with conflicts, rows behind the watermark, events in periods.

Each gives one stream whose ``outcome`` column tells the outputs apart; ``split_once`` writes every outcome to a table of
its own, once, also where a batch runs again. All take streams of a watermarked time; the session must use the RocksDB
state store (``use_rocksdb``). State is held by key and ends by a timer or a time to live, never by the length of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.deliveries import payload_digest
from tidemark.session import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers and times to live needs this store; it is set for the session's later queries."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _with(schema: T.StructType, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in more]])


class Deliveries(StatefulProcessor):
    """Holds each key's payload digest until the watermark is ``keep_ms`` past its last delivery's time."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("digest", T.StructType([T.StructField("digest", T.StringType()), T.StructField("ends", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, ends = self.held.get() if self.held.exists() else (None, 0)
        before = ends
        for some in rows:
            some = some.sort_values("digest__", kind="stable")
            new = pd.Series([held is None] + [False] * (len(some) - 1), index=some.index)
            held = held or some["digest__"].iloc[0]
            ends = max(ends, int(some["ms__"].max()) + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1)
            outcome = pd.Series("repeat", index=some.index).mask(some["digest__"] != held, "conflict").mask(new, "new")
            yield some.drop(columns=["digest__", "ms__"]).assign(outcome=outcome)[lambda x: x["outcome"] != "repeat"]
        if ends != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ends)
            self.held.update((held, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def deliveries(stream: DataFrame, key: str, time: str, keep: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Deliveries with ``outcome``: new for a key's first payload, conflict for each that differs from it; exact repeats go.

    Of deliveries that come in one batch the payload with the smallest digest is the first, as in the batch operator. A key
    is forgotten once the watermark, which trails the latest time by ``delay``, is ``keep`` past its last delivery's time; rows behind the
    watermark are judged like others. Null keys are one key.
    """
    ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    marked = stream.withColumns({"digest__": payload_digest(stream.columns), "ms__": F.coalesce(F.unix_millis(time), F.lit(0))})
    rows = _unmarked(marked.withWatermark(time, delay), time)
    return rows.groupBy(key).transformWithStateInPandas(Deliveries(ms), _with(stream.schema, ("outcome", T.StringType())), "Append", "EventTime")


class Lateness(StatefulProcessor):
    """Keeps nothing; compares each row's time with the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for some in rows:
            yield some.drop(columns=["ms__", "part__"]).assign(outcome=(some["ms__"] < mark).map({True: "late", False: "on time"}))

    def close(self) -> None:
        pass


def lateness(stream: DataFrame, time: str, delay: str, parts: int = 64) -> DataFrame:
    """All rows with ``outcome``: late if their time lies before the watermark, which trails the latest time seen by ``delay``.

    Rows are dealt out by hash to ``parts`` keys; no row is dropped and no state is kept. Rows without a time are on time.
    """
    plain = stream.withWatermark(time, delay)
    rows = plain.withColumns({"ms__": F.coalesce(F.unix_millis(time), F.lit((1 << 62))), "part__": F.pmod(F.xxhash64(*stream.columns), F.lit(parts))})
    rows = _unmarked(rows, time)
    return rows.groupBy("part__").transformWithStateInPandas(Lateness(), _with(stream.schema, ("outcome", T.StringType())), "Append", "EventTime")


def _unmarked(rows: DataFrame, *times: str) -> DataFrame:
    """The same rows, the times computed anew, so that Spark does not drop those behind the watermark."""
    return rows.withColumns({t: F.timestamp_micros(F.unix_micros(t)) for t in times})


ROW = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("row", T.StringType())])


class EventsInPeriods(StatefulProcessor):
    """Per key: the periods still within reach of late events, and the events that wait for their period."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.periods, self.waiting = handle.getListState("periods", ROW), handle.getListState("waiting", ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        periods, waiting = list(self.periods.get()), list(self.waiting.get())
        for some in rows:
            for is_period, *row in some[["period__", "start__", "end__", "row__"]].itertuples(index=False):
                (periods if is_period else waiting).append((int(row[0]), int(row[1]), row[2]))
        yield from self._settled(key, periods, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, list(self.periods.get()), list(self.waiting.get()), timerValues.getCurrentWatermarkInMs())

    def _settled(self, key, periods: list, waiting: list, mark: int) -> Iterator[pd.DataFrame]:
        out, still = [], []
        for event in waiting:
            hits = [p for p in periods if p[0] <= event[0] < p[1]]
            out += [(event[2], p[2], "joined") for p in hits]
            if not hits and event[0] + self.wait_ms >= mark:
                still.append(event)
            elif not hits:
                out.append((event[2], None, "unmatched"))
        periods = [p for p in periods if p[1] + self.wait_ms >= mark]
        for state, rows in ((self.periods, periods), (self.waiting, still)):
            state.put([tuple(r) for r in rows]) if rows else state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [p[1] + self.wait_ms + 1 for p in periods if p[1] < OPEN] + [e[0] + self.wait_ms + 1 for e in still]
        if ends:
            self.handle.registerTimer(max(min(ends), mark + 1))
        if out:
            yield pd.DataFrame(out, columns=["event", "period", "outcome"])

    def close(self) -> None:
        pass


OPEN = 1 << 60


def events_in_periods(events: DataFrame, periods: DataFrame, on: str, time: str, start: str, end: str, delay: str = "1 hour", wait: str = "1 day") -> DataFrame:
    """Two streams joined: (on, event, period, outcome), the rows as JSON; one row for each period that holds the event.

    An event waits up to ``wait`` behind the watermark for a period, then it is unmatched, once. A period is kept until ``wait``
    behind its end (open ones stay), so state follows what is open and recent, not the stream's length. The
    watermark trails both streams' times by ``delay``. An event meets the periods that are known when it is first joined.
    """
    ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    left = events.select(on, F.lit(False).alias("period__"), F.col(time).alias("_time"), F.unix_millis(time).alias("start__"), F.unix_millis(time).alias("end__"), F.to_json(F.struct(*events.columns)).alias("row__"))
    finish = F.coalesce(F.unix_millis(end), F.lit(OPEN))
    right = periods.select(on, F.lit(True).alias("period__"), F.col(start).alias("_time"), F.unix_millis(start).alias("start__"), finish.alias("end__"), F.to_json(F.struct(*periods.columns)).alias("row__"))
    both = left.unionByName(right).withWatermark("_time", delay)
    rows = _unmarked(both, "_time").drop("_time")
    out = T.StructType([events.schema[on], *[T.StructField(n, T.StringType()) for n in ("event", "period", "outcome")]])
    return rows.groupBy(on).transformWithStateInPandas(_Keyed(ms, on), out, "Append", "EventTime")


class _Keyed(EventsInPeriods):
    """As its parent, with the key in each row."""

    def __init__(self, wait_ms: int, on: str):
        super().__init__(wait_ms)
        self.on = on

    def _settled(self, key, *rest) -> Iterator[pd.DataFrame]:
        for out in super()._settled(key, *rest):
            out.insert(0, self.on, key[0])
            yield out


def split_once(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each outcome's rows to ``path/outcome=<name>/batch=<id>``, over what a failed try left there."""

    def put(batch: DataFrame, number: int) -> None:
        root = f"{path.rstrip('/')}"
        rows = batch.withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("outcome", "batch").parquet(root)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
