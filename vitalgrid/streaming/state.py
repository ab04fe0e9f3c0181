"""Operators with a state per key, held in the state store and versioned with the stream's checkpoint.

A key's state is a list of bounded length: the newest rows of a conversation, or the samples of intervals that are not
complete yet. The store writes what changes, a restart goes on from the checkpoint, and the store can be read as a table.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, LongType, StructType

from vitalgrid.session import materialize
from vitalgrid.streaming import jobs

#: Buckets that open intervals are dealt over; part of the checkpoint.
INTERVAL_BUCKETS = 1024

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def list_state_store(spark: SparkSession):
    """List state and timers need the store that keeps state outside the heap; other streams keep their own."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _fields(df: DataFrame, columns: Sequence[str]) -> tuple[str, list[str]]:
    """The schema of the columns as text, and which of them hold whole numbers."""
    fields = df.select(*[f"`{c}`" for c in columns]).schema.fields
    whole = [f.name for f in fields if isinstance(f.dataType, IntegralType)]
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), whole


def _values(frame: pd.DataFrame, whole: Sequence[str]) -> list[tuple]:
    """Rows as tuples of plain values: missing ones as None, whole numbers as such beside missing ones too."""
    plain = lambda c, v: int(v) if c in whole else v
    columns = [[None if gone else plain(n, v) for v, gone in zip(c.tolist(), c.isna())] for n, c in frame.items()]
    return list(zip(*columns))


def _in_utc(value):
    """Times come without a zone from rows and with one from the state; the session's zone is UTC."""
    if isinstance(value, datetime):
        return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)
    return value


class Idle(NamedTuple):
    """The rows' time column, how long a key may be silent, and how far behind the newest time rows may come."""

    time: str
    seconds: int
    delay: str = "0 seconds"


class NewestRows(StatefulProcessor):
    """Keeps the newest n rows of a key; with ``idle`` a timer forgets a key that gets no row for so long."""

    def __init__(self, columns: Sequence[str], schema: str, order: str, n: int, idle: Idle | None) -> None:
        self.columns, self.schema, self.n, self.idle = list(columns), schema, n, idle
        self.place = self.columns.index(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def _newest(self, rows: list[tuple]) -> list[tuple]:
        # equal places are told apart by the whole row, so any arrival order leaves the same rows
        rank = lambda r: (r[self.place] is not None, r[self.place], tuple((v is not None, v) for v in r))
        return sorted(rows, key=rank, reverse=True)[: self.n]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = [tuple(map(_in_utc, r)) for r in self.rows.get()]
        arriving = iter(rows)
        while part := list(itertools.islice(arriving, 1024)):
            kept = self._newest(kept + [tuple(_in_utc(r[c]) for c in self.columns) for r in part])
        self.rows.put(kept)
        if self.idle is not None:
            self._forget_later(kept)
        yield Row(kept=len(kept))

    def _forget_later(self, kept: list[tuple]) -> None:
        times = [r[self.columns.index(self.idle.time)] for r in kept]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        last = max((t for t in times if t is not None), default=None)
        if last is not None:
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.idle.seconds * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.rows.clear()
        yield Row(kept=0)

    def close(self) -> None:
        pass


def newest_rows(stream: DataFrame, out: str, key: str, order: str, n: int = 10, idle: Idle | None = None) -> None:
    """Drain a stream into the state: the newest n rows (by ``order``, null last) of every key.

    With ``idle``, rows behind the watermark drop, as in every operator with event time.
    A task first leaves n rows a key of each Arrow batch, so a key that fills a batch sends few rows on.
    """
    rest = [c for c in stream.columns if c != key]
    schema, _ = _fields(stream, rest)
    by = [(key, "ascending"), *[(c, "descending") for c in [order, *[c for c in rest if c != order]]]]

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ranked = batch.take(pa.compute.sort_indices(batch, sort_keys=by))
            keys = ranked.column(key).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[True], keys[1:] != keys[:-1]])
            place = np.arange(len(keys)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
            yield ranked.filter(pa.array(place < n))

    few_rows = stream.mapInArrow(few, stream.schema)
    if idle is not None:
        few_rows = few_rows.withWatermark(idle.time, idle.delay)
    processor, mode = NewestRows(rest, schema, order, n, idle), "None" if idle is None else "EventTime"
    kept = few_rows.groupBy(key).transformWithState(processor, "kept int", "Update", mode)

    def discard(batch: DataFrame, batch_id: int) -> None:
        batch.write.format("noop").mode("overwrite").save()

    with list_state_store(stream.sparkSession):
        jobs.run_available(kept, out, "update", discard)


def kept_rows(spark: SparkSession, out: str) -> DataFrame:
    """The state of ``newest_rows`` as a table: the key and the rows kept."""
    state = spark.read.format("statestore").option("stateVarName", "rows").load(f"{out}/checkpoint")
    return state.select("key.*", "list_element.*")


class OpenIntervals(StatefulProcessor):
    """Collects numbered samples and lets go of every interval of ``size`` numbers of a key once it is complete.

    Samples may come in any order and more than once. State holds the samples of open intervals only. A state belongs to
    a bucket of intervals, not to a key: one call serves many keys, and a key that has most samples is met by many tasks.
    """

    def __init__(self, columns: Sequence[str], schema: str, whole: Sequence[str], key: str, number: str, size: int) -> None:
        self.columns, self.schema, self.whole, self.key, self.number, self.size = list(columns), schema, list(whole), key, number, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", self.schema)

    def _parted(self, held: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Samples of complete intervals, in order, and the others."""
        held = held.drop_duplicates([self.key, self.number])
        held.insert(0, "interval", held[self.number].astype("int64") // self.size)
        complete = held.groupby([self.key, "interval"], dropna=False)[self.number].transform("size") == self.size
        return held[complete].sort_values([self.key, self.number]), held[~complete].drop(columns="interval")

    def handleInputRows(self, bucket, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, arrived = pd.DataFrame([tuple(r) for r in self.samples.get()], columns=self.columns), []
        # what arrives is looked through once it is as much as what is held, so the work grows with the samples
        for part in itertools.chain(rows, [None]):
            if part is not None:
                arrived.append(part[self.columns])
            if arrived and (part is None or sum(map(len, arrived)) >= max(len(held), 1024)):
                done, held = self._parted(pd.concat([held, *arrived] if len(held) else arrived, ignore_index=True))
                arrived = []
                if len(done):
                    yield done[[self.key, "interval", *[c for c in self.columns if c != self.key]]]
        if len(held):
            self.samples.put(_values(held, self.whole))
        else:
            self.samples.clear()

    def close(self) -> None:
        pass


def complete_intervals(stream: DataFrame, key: str, number: str, size: int, buckets: int = INTERVAL_BUCKETS) -> DataFrame:
    """Samples of complete intervals, with the interval's number and the key; append mode.

    Samples without a number belong to no interval. The number of buckets belongs to the checkpoint and must stay.
    """
    schema, whole = _fields(stream, stream.columns)
    start = F.col(number) - F.pmod(F.col(number), F.lit(size))
    bucket = F.pmod(F.xxhash64(key, start), F.lit(buckets))
    dealt = stream.where(F.col(number).isNotNull()).withColumn("__bucket", bucket)
    result = StructType([stream.schema[key]]).add("interval", LongType())
    for c in stream.columns:
        if c != key:
            result = result.add(stream.schema[c])
    processor = OpenIntervals(stream.columns, schema, whole, key, number, size)
    return dealt.groupBy("__bucket").transformWithStateInPandas(processor, result, "Append", "None")


def score_intervals(stream: DataFrame, out: str, key: str, number: str, size: int, score: Callable[[DataFrame], DataFrame]) -> None:
    """Drain a stream of samples: each interval is scored in the micro-batch that completes it.

    A micro-batch is written once before it is scored, so the state is not read and written again by every branch of the
    scoring plan.
    """
    scoring = jobs.scored_batches(out, lambda batch: score(materialize(batch, "intervals")))
    with list_state_store(stream.sparkSession):
        jobs.run_available(complete_intervals(stream, key, number, size), out, "append", scoring)


def scored(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/data").drop("batch_id")
