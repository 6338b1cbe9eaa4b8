"""Trailing-edge debouncing of a stream by processing time, with keys that are being worked on left alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """For each key the last event, once no other has come for ``quiet`` milliseconds; those within ``in_flight`` milliseconds after that are dropped."""

    def __init__(self, key: str, events: StructType, quiet: int, in_flight: int) -> None:
        self.key, self.events, self.quiet, self.in_flight = key, events, quiet, in_flight
        self.rest = [f.name for f in events if f.name != key]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([f for f in self.events if f.name != self.key]))
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches = [b for b in rows if len(b)]
        now = timerValues.getCurrentProcessingTimeInMs()
        if batches and not (self.until.exists() and now < self.until.get()[0]):
            row = batches[-1].iloc[-1]
            self.last.update(tuple(_plain(row[c]) for c in self.rest))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now + self.quiet)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            self.until.clear()
            yield pd.DataFrame()
            return
        values = dict(zip(self.rest, self.last.get(), strict=True))
        self.last.clear()
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.in_flight:
            self.until.update((now + self.in_flight,))
            self.handle.registerTimer(now + self.in_flight)  # to forget the key
        row = {**values, self.key: key[0]}
        yield pd.DataFrame([[row[f.name] for f in self.events]], columns=[f.name for f in self.events])

    def close(self) -> None:
        pass


def _plain(value):
    """A value as state takes it."""
    if value is None or value is pd.NaT or isinstance(value, float) and pd.isna(value):
        return None
    return value.item() if hasattr(value, "item") else value


def debounce_stream(events: DataFrame, key: str, quiet: int = 300, in_flight: int = 0) -> DataFrame:
    """A stream of the last event of each burst of a ``key``: given out once ``quiet`` milliseconds of processing time pass without another.

    Bursts may span micro-batches: the last event and a timer are the key's state. Of the events of one micro-batch the
    one that comes last counts. For ``in_flight`` milliseconds after a key was given out its events are dropped. Null
    keys are a key. The session must use the RocksDB state store (PROVIDER).
    """
    rows = events.groupBy(key)
    processor = Debounce(key, events.schema, quiet, in_flight)
    return rows.transformWithStateInPandas(statefulProcessor=processor, outputStructType=events.schema, outputMode="Update", timeMode="ProcessingTime")
