"""Streams that are put in order, with timers: rows wait until the watermark has passed them, then feed a fold.

A series' rows may come late and out of order, as far as the watermark allows; rows behind it are dropped by Spark.
Each series keeps in the state store what waits (by event time), the fold's state, and two timers: one for
the first row that waits, and one that drops a series that has been idle. After that the series starts anew.

Needs a state store with timers: `spark.sql.streaming.stateStore.providerClass` set to `PROVIDER`.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns that a stream gets on its way: its event time, and that in milliseconds.
STAMP, AT = "_stamp", "_at"

Rows = list[dict[str, Any]]
#: Takes the state (None for a new series) and the next row in order; gives the new state and the rows to put out.
Fold = Callable[[Any, dict[str, Any]], tuple[Any, Rows]]


class Ordered(StatefulProcessor):
    """Buffers rows by event time and feeds them to `fold` when the watermark passes."""

    def __init__(self, fold: Fold, order: list[str], inputs: list[str], names: list[str], idle_ms: int) -> None:
        self.fold, self.order, self.inputs, self.names, self.idle_ms = fold, order, inputs, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rows binary")
        self.held = handle.getValueState("held", "next long, last long, state binary")

    def _held(self) -> tuple[int, int, Any]:
        if not self.held.exists():
            return -1, -1, None
        nxt, last, state = self.held.get()
        return nxt, last, pickle.loads(bytes(state))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        nxt, last, state = self._held()
        found: dict[int, Rows] = {}
        for batch in rows:
            for row in batch.set_axis(self.inputs, axis=1).drop(columns=STAMP).to_dict("records"):
                found.setdefault(int(row.pop(AT)), []).append(row)
        for at, own in found.items():
            before = pickle.loads(bytes(self.waiting.getValue((at,))[0])) if self.waiting.containsKey((at,)) else []
            self.waiting.updateValue((at,), (pickle.dumps(before + own),))
        newest = max([last, *found])
        if newest > last:
            if last >= 0:
                self.handle.deleteTimer(last + self.idle_ms)
            self.handle.registerTimer(newest + self.idle_ms)
        first = min(found)
        if nxt < 0 or first < nxt:
            if nxt >= 0 and nxt != last + self.idle_ms:
                self.handle.deleteTimer(nxt)
            self.handle.registerTimer(first)
            nxt = first
        self.held.update((nxt, newest, pickle.dumps(state)))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        nxt, last, state = self._held()
        now = timerValues.getCurrentWatermarkInMs()
        ready = sorted(at for (at,) in self.waiting.keys() if at <= now)
        out: Rows = []
        for at in ready:
            own = pickle.loads(bytes(self.waiting.getValue((at,))[0]))
            for row in sorted(own, key=lambda r: [r[c] for c in self.order]):
                state, made = self.fold(state, row)
                out += made
            self.waiting.removeKey((at,))
        later = sorted(at for (at,) in self.waiting.keys())
        if not later and now >= last + self.idle_ms:
            self.waiting.clear()
            self.held.clear()
        else:
            if later:
                self.handle.registerTimer(later[0])
            self.held.update((later[0] if later else -1, last, pickle.dumps(state)))
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, ts: str, order: list[str], fold: Fold, schema: T.StructType | str, late: str, idle_ms: int) -> DataFrame:
    """The rows that `fold` gives for each series of `stream` in the order of event time, then of `order`."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    rows = stream.withColumn(STAMP, F.col(ts).cast("timestamp")).withWatermark(STAMP, late).withColumn(AT, F.unix_millis(STAMP))
    return rows.groupBy(key).transformWithStateInPandas(Ordered(fold, order, rows.columns, kind.names, idle_ms), kind, "append", "EventTime")


def grid_rows(key: str, tick: str, values: list[str], flag: str = "filled") -> Fold:
    """A row for every integer tick up to the next one that came; what is put in is flagged and filled forward, as in `scan.grid_fill`."""

    def fold(state: Any, row: dict[str, Any]) -> tuple[Any, Rows]:
        at = int(row[tick])
        out: Rows = []
        if state is not None:
            last, known = state
            if at <= last:
                return state, []  # a second row of a tick that is out
            out = [{key: row[key], tick: t, **known, flag: True} for t in range(last + 1, at)]
        else:
            known = dict.fromkeys(values)
        known = {c: known[c] if pd.isna(row[c]) else row[c] for c in values}
        return (at, known), [*out, {key: row[key], tick: at, **known, flag: False}]

    return fold


def wave_rows(cond: str, name: str = "wave") -> Fold:
    """Every row with the number of rows with `cond` before it, as in `scan.wave_id`."""

    def fold(state: Any, row: dict[str, Any]) -> tuple[Any, Rows]:
        wave = state or 0
        return wave + bool(row[cond]), [{**row, name: wave}]

    return fold


def streaming_grid(stream: DataFrame, key: str, ts: str, tick: str, values: list[str], late: str = "10 minutes", idle_ms: int = 86_400_000, flag: str = "filled") -> DataFrame:
    """`scan.grid_fill` of a stream: key, tick, values, flag."""
    fields = {f.name: f for f in stream.schema.fields}
    schema = T.StructType([*(fields[c] for c in (key, tick, *values)), T.StructField(flag, T.BooleanType())])
    return in_order(stream, key, ts, [tick], grid_rows(key, tick, values, flag), schema, late, idle_ms)


def streaming_wave(stream: DataFrame, key: str, ts: str, order: list[str], cond: str, late: str = "10 minutes", idle_ms: int = 86_400_000, name: str = "wave") -> DataFrame:
    """`scan.wave_id` of a stream: all its columns and the wave."""
    schema = T.StructType([*stream.schema.fields, T.StructField(name, T.LongType())])
    return in_order(stream, key, ts, order, wave_rows(cond, name), schema, late, idle_ms)
