"""Folds over a stream in event order, however its rows arrive.

Rows wait in keyed state, in pages of sorted runs, until the watermark has passed them; a timer then sweeps the pages that
are due and hands their rows to the fold in order, some pages at a time. Rows later than the watermark are dropped by the
engine before they get here, so no row can follow that belongs before one already told. A key without rows for as long as
its state matters is forgotten by a timer, too.

A finite input ends before the watermark passes its last rows. A second source, empty until then, brings one row of a far time
that closes the stream: ``jobs.drain`` writes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.session import checkpoint_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time from which on a row is none but the closing one.
FAR = "9999-01-01 00:00:00"
MOST_IDLE_MS = 100 * 365 * 86_400_000
#: Rows of a page of waiting rows, of a run that is sorted before it is cut into pages, and of pages merged at once.
PAGE_ROWS, RUN_ROWS, MERGED_ROWS = 1_024, 131_072, 32_768


@dataclass(frozen=True)
class Fold:
    """``advance`` takes the state of a key (a tuple, None at first) and its next rows in order, and returns the new state and
    the columns of ``result`` for these rows. ``state`` and ``result`` are schemas in DDL."""

    state: str
    result: str
    advance: Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]
    idle_ms: int


class InEventOrder(StatefulProcessor):
    """One key's rows by time and ``event_id``. State: pages under the time of their first row, the timer of the earliest page, the
    fold's state, and the timer after which that no longer matters."""

    def __init__(self, columns: list[tuple[str, str]], fold: Fold):
        self.columns, self.fold = columns, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "first long, nth long", "rows binary")
        self.next = handle.getValueState("next", "at long")
        self.state = handle.getValueState("folded", self.fold.state)
        self.idle = handle.getValueState("idle", "at long")

    def store(self, pdf: pd.DataFrame) -> None:
        """Sorted rows as pages."""
        rows, used = pa.Table.from_pandas(pdf[[c for c, _ in self.columns]], preserve_index=False), {}
        for k in range(0, len(pdf), PAGE_ROWS):
            first = int(pdf["t_us"].iloc[k])
            nth = used.get(first, 0)
            while self.pages.containsKey((first, nth)):
                nth += 1
            used[first] = nth + 1
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows.slice(k, PAGE_ROWS))
            self.pages.updateValue((first, nth), (sink.getvalue().to_pybytes(),))

    def wake(self, state: Any, at: int | None) -> None:
        """Move the timer that ``state`` names."""
        if state.exists():
            self.handle.deleteTimer(state.get()[0])
        if at is None:
            state.clear()
        else:
            self.handle.registerTimer(at)
            state.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in runs(rows):
            self.store(pdf)
            at = int(pdf["t_us"].iloc[0]) // 1000 + 1
            first = at if first is None else min(first, at)
        if first is not None and not (self.next.exists() and self.next.get()[0] <= first):
            self.wake(self.next, first)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.next.exists() and self.next.get()[0] == at:
            yield from self.sweep(key[0], int(timerValues.getCurrentWatermarkInMs()) * 1000)
        elif self.idle.exists() and self.idle.get()[0] == at:
            self.state.clear()
            self.idle.clear()

    def sweep(self, key: Any, until: int) -> Iterator[pd.DataFrame]:
        """Tell all rows before ``until``. Pages overlap; rows are told up to where the next page begins. As many pages are merged at once as
        there are rows held, so a row is sorted a few times only, however many pages overlap."""
        firsts = sorted(self.pages.keys())
        due = [k for k in firsts if k[0] < until]
        state, last = tuple(self.state.get()) if self.state.exists() else None, None
        held, at = None, 0
        while at < len(due):
            taken, count = ([] if held is None else [held]), 0
            least = max(MERGED_ROWS, 0 if held is None else len(held))
            while at < len(due) and count < least:
                taken.append(pa.ipc.open_stream(self.pages.getValue(due[at])[0]).read_all().to_pandas())
                self.pages.removeKey(due[at])
                count, at = count + len(taken[-1]), at + 1
            held = pd.concat(taken, ignore_index=True).sort_values(["t_us", "event_id"], ignore_index=True)
            limit = due[at][0] if at < len(due) else until
            cut = int(held["t_us"].searchsorted(limit))
            if cut:
                ready, held = held.iloc[:cut].reset_index(drop=True), held.iloc[cut:]
                last = int(ready["t_us"].iloc[-1])
                state, out = self.fold.advance(state, ready)
                out.insert(0, "key", key)
                yield out
        if state is not None:
            self.state.update(state)
        if held is not None and len(held):
            self.store(held)
        rest = [k[0] for k in firsts[len(due):]] + ([int(held["t_us"].iloc[0])] if held is not None and len(held) else [])
        self.wake(self.next, min(rest) // 1000 + 1 if rest else None)
        if last is not None:
            self.wake(self.idle, last // 1000 + self.fold.idle_ms + 1)

    def close(self) -> None:
        pass


def runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in sorted runs: the longer a run, the fewer pages overlap."""
    held: list[pd.DataFrame] = []
    for pdf in parts:
        held.append(pdf)
        if sum(map(len, held)) >= RUN_ROWS:
            yield pd.concat(held).sort_values(["t_us", "event_id"], ignore_index=True)
            held = []
    if held and any(map(len, held)):
        yield pd.concat(held).sort_values(["t_us", "event_id"], ignore_index=True)


def closing_source(rows: DataFrame, time: str) -> tuple[DataFrame, str]:
    """``rows`` with a second source that is empty as yet, and the folder that its closing row goes to."""
    spark = rows.sparkSession
    folder = f"{checkpoint_folder(spark)}/closing-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    last = spark.readStream.schema(T.StructType([rows.schema[time]])).parquet(folder)
    return rows.unionByName(last, allowMissingColumns=True), folder


def write_closing(spark: Any, folder: str, time: str) -> None:
    spark.range(1).select(F.to_timestamp(F.lit(FAR)).alias(time)).write.mode("append").parquet(folder)


def fold_stream(rows: DataFrame, fold: Fold, lateness: str) -> DataFrame:
    """(key, columns of ``fold.result``) of a stream of rows with key, event_time, event_id and more, in event order per key.

    A row is told once the watermark, ``lateness`` behind the latest row, has passed it. Rows without a time are dropped.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    closed, folder = closing_source(rows, "event_time")
    # The condition names the event time, so the closing row passes the watermark before it is left out.
    timed = (closed.withWatermark("event_time", lateness).filter(F.col("event_time") < F.lit(FAR).cast("timestamp"))
             .withColumn("t_us", F.unix_micros("event_time")))
    columns = [(f.name, f.dataType.simpleString()) for f in timed.schema if f.name not in ("key", "event_time")]
    key = rows.schema["key"].dataType.simpleString()
    out = timed.groupBy("key").transformWithStateInPandas(InEventOrder(columns, fold), f"key {key}, {fold.result}", "Append", "eventTime")
    out.closing = folder
    return out
