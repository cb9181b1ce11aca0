"""Recurrences over long series, by ranges: no task holds a series, and a series runs on many tasks.

Rows are sorted by series and order and dealt to ranges, written once. What a row needs from the rows
before its range is a carry, and a carry is small: a number for a linear recurrence x -> a x + b (whose maps
compose), the last few values for lags and windows, a wait for a greedy choice (whose effect on a range
is a table from the wait at its start to the wait at its end). A pass over the ranges gives one summary each, the driver
strings the summaries together (one small row per range), and a further pass fills the rows.

Indicators are built as a graph of `Value`s: columns, functions of arrays, and scans. Scans that need one
another's results run in successive passes; each pass computes what is known again from the written rows,
so nothing but summaries is exchanged between passes.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ticktide.session import written

_uids = itertools.count()
BLOCK = 128


def linear(a: np.ndarray, b: np.ndarray, start: float = 0.0) -> np.ndarray:
    """y[i] = a[i] y[i - 1] + b[i]: maps composed by doubling inside blocks, then block after block."""
    n = len(a)
    if not n:
        return np.zeros(0)
    rows = -(-n // BLOCK)
    m, c = np.ones(rows * BLOCK), np.zeros(rows * BLOCK)
    m[:n], c[:n] = a, b
    m, c = m.reshape(rows, BLOCK), c.reshape(rows, BLOCK)
    step = 1
    while step < BLOCK:
        c[:, step:] += m[:, step:] * c[:, :-step]
        m[:, step:] *= m[:, :-step].copy()
        step *= 2
    carry, at = np.empty(rows), start
    for k, (mk, ck) in enumerate(zip(m[:, -1].tolist(), c[:, -1].tolist(), strict=True)):
        carry[k] = at
        at = mk * at + ck
    return (m * carry[:, None] + c).ravel()[:n]


class Part:
    """A range's rows: its columns, where series begin inside it, and the carries known so far."""

    def __init__(self, table: pa.Table, by: list[str], carries: dict[int, Any]) -> None:
        self.table, self.n, self.carries = table, table.num_rows, carries
        fresh = np.zeros(self.n, dtype=bool)
        for name in by:
            c = table.column(name).combine_chunks()
            if isinstance(c, pa.ChunkedArray):
                c = c.chunk(0)
            a, b = c.slice(0, self.n - 1), c.slice(1)
            differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            fresh[1:] |= differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
        #: Rows at which a series begins inside the range; the first row may go on with an earlier range's series.
        self.fresh = fresh
        self.last = int(np.flatnonzero(fresh)[-1]) if fresh.any() else 0
        self.single = not fresh.any()

    def key(self, by: list[str], row: int) -> bytes:
        return pickle.dumps([self.table.column(c)[row].as_py() for c in by])

    def numbers(self, name: str) -> np.ndarray:
        """A column as doubles, null as NaN."""
        c = self.table.column(name)
        c = c.cast(pa.int8()) if pa.types.is_boolean(c.type) else c
        return c.cast(pa.float64()).to_numpy().astype(float, copy=True)


class Linear:
    """Scan of y = a y + b from 0 at the start of a series."""

    def _reset(self, part: Part, a: np.ndarray) -> np.ndarray:
        return np.where(part.fresh, 0.0, a)

    def apply(self, part: Part, carry: float | None, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return linear(self._reset(part, a), b, carry or 0.0)

    def summary(self, part: Part, a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
        a = self._reset(part, a)
        return float(np.prod(a)), float(linear(a, b)[-1])

    def compose(self, carry: float | None, summary: tuple[float, float], single: bool) -> float:
        return summary[0] * (carry or 0.0) + summary[1]


class Tail:
    """Scan that puts the `width` values before a range in front of its own; NaN where there are none."""

    def __init__(self, width: int) -> None:
        self.width = width

    def apply(self, part: Part, carry: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        before = np.full(self.width, np.nan)
        if carry is not None and len(carry):
            before[-len(carry) :] = carry
        return np.concatenate([before, x])

    def summary(self, part: Part, x: np.ndarray) -> np.ndarray:
        return x[part.last :][-self.width :].copy()

    def compose(self, carry: np.ndarray | None, summary: np.ndarray, single: bool) -> np.ndarray:
        return np.concatenate([carry, summary])[-self.width :] if single and carry is not None else summary


class Greedy:
    """Scan that takes flagged rows at least `span` rows apart; the carry is the wait in rows."""

    def __init__(self, span: int) -> None:
        self.span = span

    def _links(self, part: Part, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of flagged rows, their series' numbers, and each place's successor (itself at the end)."""
        places = np.flatnonzero(flags)
        series = np.cumsum(part.fresh)[places]
        after = np.searchsorted(places, places + self.span)
        ends = (after >= len(places)) | (series[np.minimum(after, len(places) - 1)] != series) if len(places) else np.zeros(0, dtype=bool)
        return places, series, np.where(ends, np.arange(len(places)), after)

    def apply(self, part: Part, carry: int | None, flags: np.ndarray) -> np.ndarray:
        places, series, after = self._links(part, flags)
        taken = np.zeros(len(flags), dtype=bool)
        if not len(places):
            return taken
        on = np.zeros(len(places), dtype=bool)
        first = np.searchsorted(places, carry or 0)
        if first < len(places) and series[first] == 0:
            on[first] = True
        on[np.flatnonzero(np.diff(series, prepend=0))] = True
        while True:  # rows reached in twice as many steps each time
            more = on.copy()
            more[after[on]] = True
            if (more == on).all() and (after[after] == after).all():
                break
            on, after = more, after[after]
        taken[places[on]] = True
        return taken

    def summary(self, part: Part, flags: np.ndarray) -> np.ndarray:
        places, series, after = self._links(part, flags)
        while len(after) and (after[after] != after).any():
            after = after[after]
        waits = np.arange(self.span)
        if not part.single:
            waits = np.zeros(1, dtype=int)
        start = np.searchsorted(places, part.last + waits) if not part.single else np.searchsorted(places, waits)
        out = np.maximum(waits - part.n, 0) if part.single else np.zeros(1, dtype=int)
        there = start < len(places)
        out[there] = np.maximum(places[after[start[there]]] + self.span - part.n, 0)
        return out

    def compose(self, carry: int | None, summary: np.ndarray, single: bool) -> int:
        return int(summary[carry or 0]) if single else int(summary[0])


class Value:
    """A column of numbers to come: made from others row by row, or by a scan."""

    def __init__(self, deps: Iterable[Value] = (), make: Callable[..., np.ndarray] | None = None, scan: Any = None, known: Value | None = None) -> None:
        self.deps, self.make, self.scan, self.uid = list(deps), make, scan, next(_uids)
        self.level = max((d.level for d in self.deps), default=0) + (scan is not None)
        self._known = known

    @property
    def known(self) -> Value:
        """Which rows have a value: often clear before the value itself is."""
        if self._known is None:
            self._known = each(lambda x: ~np.isnan(x), self)
        return self._known

    def __sub__(self, other: Value) -> Value:
        return each(np.subtract, self, other, known=each(np.logical_and, self.known, other.known))

    def __add__(self, other: Value) -> Value:
        return each(np.add, self, other, known=each(np.logical_and, self.known, other.known))

    def __mul__(self, factor: float) -> Value:
        return each(lambda x: x * factor, self, known=self.known)


def column(name: str) -> Value:
    return Value(make=lambda part: part.numbers(name))


def each(make: Callable[..., np.ndarray], *values: Value, known: Value | None = None) -> Value:
    """A function of arrays, row by row."""
    return Value(values, lambda part, *arrays: make(*arrays), known=known)


def count(flags: Value) -> Value:
    """Rows of the series with the flag up to here."""
    return Value([each(lambda f: np.ones(len(f)), flags), each(lambda f: f.astype(float), flags)], scan=Linear())


def total(x: Value) -> Value:
    """Sum of the series up to here."""
    return Value([each(lambda v: np.ones(len(v)), x), x], scan=Linear())


#: Place of a row in its series, from 0.
PLACE = each(lambda n: n - 1, count(Value(make=lambda part: np.ones(part.n, dtype=bool))))


def before(x: Value, steps: int) -> Value:
    """The value `steps` rows earlier, none at the start of a series."""
    return each(lambda long, place: np.where(place >= steps, long[: len(place)], np.nan), Value([x], scan=Tail(steps)), PLACE) if steps else x


def windows(x: Value, rows: int, make: Callable[[np.ndarray], np.ndarray]) -> Value:
    """make(windows of the last `rows` values), none where the series is shorter."""
    def run(long: np.ndarray, place: np.ndarray) -> np.ndarray:
        if not len(place):
            return place
        return np.where(place >= rows - 1, make(np.lib.stride_tricks.sliding_window_view(long[1:], rows)), np.nan)

    return each(run, Value([x], scan=Tail(rows)), PLACE)


def ewm(x: Value, alpha: float, start: int) -> Value:
    """Exponential mean seeded with the mean of the first `start` values; nulls leave it as it is.

    Up to the seed it is a running mean, so every step is linear in the state.
    """
    rank = count(x.known)

    def slope(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), 1.0, np.where(k <= start, (k - 1) / np.maximum(k, 1), 1 - alpha))

    def push(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), 0.0, np.nan_to_num(x) * np.where(k <= start, 1 / np.maximum(k, 1), alpha))

    state = Value([each(slope, x, rank), each(push, x, rank)], scan=Linear())
    known = each(lambda k: k >= start, rank)
    return each(lambda y, ok: np.where(ok, y, np.nan), state, known, known=known)


# --- running a graph ------------------------------------------------------------------------------


def _scans(outputs: Iterable[Value]) -> list[Value]:
    found: dict[int, Value] = {}
    todo, seen = list(outputs), set()
    while todo:
        v = todo.pop()
        if v.uid not in seen:
            seen.add(v.uid)
            todo += v.deps
            if v.scan is not None:
                found[v.uid] = v
    return [found[k] for k in sorted(found)]


def _eval(value: Value, part: Part, memo: dict[int, np.ndarray]) -> np.ndarray:
    if value.uid not in memo:
        args = [_eval(d, part, memo) for d in value.deps]
        memo[value.uid] = value.scan.apply(part, part.carries.get(value.uid), *args) if value.scan is not None else value.make(part, *args)
    return memo[value.uid]


def in_ranges(df: DataFrame, by: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """`df` sorted by series and order, in as many ranges, written to the shared folder."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return written(df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order))


def with_values(df: DataFrame, by: list[str], order: list[str], outputs: dict[str, Value], ranges: int | None = None, flags: Iterable[str] = ()) -> DataFrame:
    """`df` with the outputs as double columns (boolean ones for `flags`); null where there is no value."""
    flags, rows, names = set(flags), in_ranges(df, by, order, ranges), df.columns
    scans = _scans(outputs.values())
    carries: dict[int, dict[int, Any]] = {}

    def part_of(batches: Iterator[pa.RecordBatch]) -> tuple[int, Part] | None:
        held = [b for b in batches if b.num_rows]
        number = TaskContext.get().partitionId()
        return (number, Part(pa.Table.from_batches(held), by, carries.get(number, {}))) if held else None

    needed = rows.select(*dict.fromkeys([*by, *_columns(outputs.values(), names)]))
    for level in range(1, max((v.level for v in scans), default=0) + 1):
        now = [v for v in scans if v.level == level]

        def summarise(batches: Iterator[pa.RecordBatch], now: list[Value] = now) -> Iterator[pa.RecordBatch]:
            if (found := part_of(batches)) is not None:
                number, part = found
                memo: dict[int, np.ndarray] = {}
                own = {v.uid: v.scan.summary(part, *[_eval(d, part, memo) for d in v.deps]) for v in now}
                cells = [[number], [part.key(by, 0)], [part.key(by, part.n - 1)], [part.single], [pickle.dumps(own)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["number", "first", "last", "single", "own"])

        state: dict[int, Any] = {}
        key = None
        for r in sorted(needed.mapInArrow(summarise, "number long, first binary, last binary, single boolean, own binary").collect(), key=lambda r: r["number"]):
            own, goes_on = pickle.loads(bytes(r["own"])), key == bytes(r["first"])
            for v in now:
                carry = state.get(v.uid) if goes_on else None
                if carry is not None:
                    carries.setdefault(r["number"], {})[v.uid] = carry
                state[v.uid] = v.scan.compose(carry if r["single"] else None, own[v.uid], r["single"])
            key = bytes(r["last"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := part_of(batches)) is not None:
            _, part = found
            memo: dict[int, np.ndarray] = {}
            made = []
            for name, v in outputs.items():
                x = _eval(v, part, memo)
                made.append(pa.array(x.astype(bool)) if name in flags else pa.array(x.astype(float), from_pandas=True))
            columns = [part.table.column(c) for c in names]
            yield from pa.Table.from_arrays([*columns, *made], [*names, *outputs]).to_batches(max_chunksize=10_000)

    fields = [T.StructField(n, T.BooleanType() if n in flags else T.DoubleType()) for n in outputs]
    return rows.mapInArrow(fill, T.StructType([*df.schema.fields, *fields]))


def _columns(outputs: Iterable[Value], names: list[str]) -> list[str]:
    """Columns that the graph reads, found by running it on a part without rows."""
    read: list[str] = []

    class Probe(Part):
        def __init__(self) -> None:
            self.n, self.carries, self.fresh, self.last, self.single = 0, {}, np.zeros(0, dtype=bool), 0, True

        def numbers(self, name: str) -> np.ndarray:
            read.append(name)
            return np.zeros(0)

    memo: dict[int, np.ndarray] = {}
    for v in outputs:
        _eval(v, Probe(), memo)
    return [n for n in names if n in set(read)]


# --- folds that don't compose ---------------------------------------------------------------------


def with_fold(df: DataFrame, by: list[str], order: list[str], inputs: list[str], make: Callable[[], Any], names: list[str]) -> DataFrame:
    """`df` with the columns that a fold gives: `make().feed(arrays)` takes a series' rows in order, batch after batch.

    For recurrences that no small table sums up. A series runs through one task, which holds a batch of it and the fold's state.
    """
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = Part(pa.Table.from_batches([batch]), by, {})
            starts = [0, *np.flatnonzero(part.fresh).tolist(), part.n]
            arrays, made = {c: part.numbers(c) for c in inputs}, []
            for a, b in itertools.pairwise(starts):
                if (own := part.key(by, a)) != key:
                    fold, key = make(), own
                made.append(fold.feed({c: x[a:b] for c, x in arrays.items()}))
            new = [pa.array(np.concatenate([m[n] for m in made]), from_pandas=True) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*columns, *names])

    fields = [T.StructField(n, T.DoubleType()) for n in names]
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, T.StructType([*df.schema.fields, *fields]))
