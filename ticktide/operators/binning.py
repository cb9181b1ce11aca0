"""Supervised binning: equal-frequency ticks, intervals and points, strategies that fit, merge and cost bins.

Ticks come from counts by the digits of the values, and one aggregate fits all bins; merging then works on the
partial results of at most some hundred bins on the driver, a bound that doesn't grow with the data.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.operators.quantiles import order_statistics

MAX_CATEGORIES = 20
#: Partial results that one task merges.
FAN = 32


def nearest_ticks(df: DataFrame, column: str, parts: int) -> list[float]:
    """Quantiles k / parts, each the value at the nearest place (halves to even), ends included; distinct ones, in order.

    Null and NaN don't count.
    """
    return sorted(set(_quantile_ticks(df, column, parts)))


def _quantile_ticks(df: DataFrame, column: str, parts: int) -> list[float]:
    x = F.col(column).cast("double")

    def places(n: int) -> list[int]:
        return sorted({round((n - 1) * k / parts) for k in range(parts + 1)})

    n, found = order_statistics(df, {column: F.when(~F.isnan(x), x)}, {column: places})[column]
    return [found[round((n - 1) * k / parts)] for k in range(parts + 1)] if n else []


# --- intervals ------------------------------------------------------------------------------------


@dataclass
class Bin:
    """An interval from `low` to `high`, each end closed or open; a barrier is never joined to a neighbour.

    `stats` is the partial result of its rows, as its strategy makes it.
    """

    low: float
    high: float
    low_open: bool = True
    high_open: bool = False
    barrier: bool = False
    stats: Any = field(default_factory=dict)

    @property
    def name(self) -> str:
        low, high = (f"{round(x, 3):g}" if math.isfinite(x) else str(x) for x in (self.low, self.high))
        return f"{'(' if self.low_open else '['}{low},{high}{')' if self.high_open else ']'}"

    @property
    def is_point(self) -> bool:
        return self.low == self.high

    @property
    def cnt(self) -> int:
        return self.stats.get("cnt", 0)

    @property
    def bad(self) -> int:
        return self.stats.get("bad", 0)

    @property
    def good(self) -> int:
        return self.stats.get("good", 0)

    @property
    def mean(self) -> float:
        return self.bad / (self.cnt + 0.5)


def intervals(ticks: Iterable[float], single: bool = False, stable: Iterable[float] = ()) -> list[Bin]:
    """Bins between the ticks, in order and without gaps; stable points become ticks too.

    With `single`, every tick is a bin of its own and what lies between two of them is open at both ends. Without,
    bins are closed above (the first one below too), and only stable points are bins of their own. A first tick
    given twice makes a first bin of that single value. Stable points are barriers.
    """
    stable = {float(p) for p in stable}
    ordered = sorted([*(float(t) for t in ticks), *stable])
    if not ordered:
        return []
    rest = sorted(set(ordered)) if single else sorted(set(ordered[1:]))
    ticks_ = rest if single else [ordered[0], *rest]
    if not single and len(ticks_) > 1 and ticks_[0] == ticks_[1] and (ticks_[0] in stable or len(ticks_) == 2):
        ticks_ = ticks_[1:]
    out: list[Bin] = []
    for k, t in enumerate(ticks_):
        alone = single or t in stable
        if k:
            before = ticks_[k - 1]
            out.append(Bin(before, t, not (k == 1 and not (single or before in stable)), alone))
        if alone or len(ticks_) == 1:
            out.append(Bin(t, t, False, False, t in stable))
    return out


def with_points(ticks: list[float], points: list[float]) -> list[Bin]:
    """Intervals between the ticks, cut at the points; each point is a bin of its own, which nothing is joined to."""
    return intervals(ticks, stable=points)


def point_bins(values: list[float]) -> list[Bin]:
    """A bin per single value, and the open intervals between them."""
    return intervals(values, single=True)


def _from(x: Column, b: Bin) -> Column:
    return x > b.low if b.low_open else x >= b.low


def bin_index(column: Column, bins: list[Bin]) -> Column:
    """Place of the bin that holds the value, by a search in halves; null where none does. Bins are in order, without gaps."""
    def find(a: int, b: int) -> Column:
        if b - a == 1:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(_from(column, bins[m]), find(m, b)).otherwise(find(a, m))

    if not bins:
        return F.lit(None).cast("int")
    end = bins[-1]
    inside = _from(column, bins[0]) & (column < end.high if end.high_open else column <= end.high)
    return F.when(inside & ~F.isnan(column.cast("double")), find(0, len(bins)))


def join(a: Bin, b: Bin, stats: Any) -> Bin:
    return Bin(a.low, b.high, a.low_open, b.high_open, False, stats)


# --- strategies -----------------------------------------------------------------------------------


class Strategy:
    """How bins are fitted, joined and judged. A caller overrides what differs.

    `fit` gives a partial result per bin; `merge` joins two; `cost` says what joining bins k and k + 1 loses (the
    least goes first); `row` makes the published numbers. `total` is the partial result of all rows, those in no bin included.
    """

    #: Whether a cost depends on more than the two bins.
    wide = False

    def fit(self, df: DataFrame, index: Column) -> dict[int | None, Any]:
        raise NotImplementedError

    def empty(self) -> Any:
        return {}

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def cost(self, bins: list[Bin], k: int) -> float:
        return math.inf

    def row(self, stats: Any, total: Any) -> dict[str, float]:
        return dict(stats)


class Sums(Strategy):
    """Partial results that add up: named Spark aggregates (or functions that make them), counts or sums, in one pass."""

    def __init__(self, **measures: Column | Callable[[], Column]) -> None:
        self.measures = {"cnt": lambda: F.count(F.lit(1)), **measures}

    def fit(self, df: DataFrame, index: Column) -> dict[int | None, Any]:
        columns = {n: m if isinstance(m, Column) else m() for n, m in self.measures.items()}
        rows = df.groupBy(index.alias("_bin")).agg(*[m.alias(n) for n, m in columns.items()]).collect()
        return {r["_bin"]: {n: r[n] or 0 for n in self.measures} for r in rows}

    def empty(self) -> dict[str, float]:
        return dict.fromkeys(self.measures, 0)

    def merge(self, a: dict, b: dict) -> dict:
        return {n: a[n] + b[n] for n in a}


class Counts(Sums):
    """The smaller count of two neighbours, plus a fraction for the larger."""

    def cost(self, bins: list[Bin], k: int) -> float:
        small, large = sorted((bins[k].cnt, bins[k + 1].cnt))
        return small + min(large / 100_000, 1)


class Means(Sums):
    """Count and sums of targets; never joined."""

    def __init__(self, *targets: str) -> None:
        super().__init__(**{f"sum_{t}": lambda t=t: F.sum(t) for t in targets}, **{f"n_{t}": lambda t=t: F.count(t) for t in targets})
        self.targets = targets

    def row(self, stats: dict, total: dict) -> dict[str, float]:
        out = {"cnt": stats["cnt"]}
        for t in self.targets:
            out |= {f"sum_{t}": stats[f"sum_{t}"], f"mean_{t}": stats[f"sum_{t}"] / stats[f"n_{t}"] if stats[f"n_{t}"] else None}
        return out


class Woe(Counts):
    """Good and bad rows by a label of 0 and 1; the cost is the chance that neighbours differ, the weight of evidence is shown.

    With `monotone`, a step between rates is the harder to join the fewer steps of its direction lie
    around it: with k of them in a row, to its left and right together, the probability p of no
    difference counts (k + 2) / 2 ** (k + 1) times.
    """

    def __init__(self, label: str, monotone: bool = False) -> None:
        super().__init__(**{n: lambda v=v: F.sum((F.col(label) == v).cast("int")) for n, v in (("bad", 1), ("good", 0))})
        self.wide = monotone

    def cost(self, bins: list[Bin], k: int) -> float:
        own = chi_cost(bins[k], bins[k + 1])
        if not self.wide:
            return own
        up = [b.mean > a.mean for a, b in zip(bins, bins[1:], strict=False)]
        low, high = k, k
        while low > 0 and up[low - 1] == up[k]:
            low -= 1
        while high + 1 < len(up) and up[high + 1] == up[k]:
            high += 1
        n = high - low
        return 1 - (1 - own) * (n + 2) / 2 ** (n + 1)

    def row(self, stats: dict, total: dict) -> dict[str, float]:
        b = Bin(0, 0, stats=stats)
        return {"cnt": b.cnt, "bad": b.bad, "good": b.good, "mean": b.mean, "woe": woe(b, base_of(total))}


class Partials(Strategy):
    """Partial results of any kind: `partial` makes one from a bin's rows in a batch, `merge` joins two.

    Batches are Arrow; partial results are merged inside a partition, then level by level, FAN at a time, and only
    one per bin reaches the driver. Their size is the caller's affair: it should not grow with the rows.
    """

    columns: list[str] = []

    def partial(self, columns: dict[str, np.ndarray]) -> Any:
        raise NotImplementedError

    def fit(self, df: DataFrame, index: Column) -> dict[int | None, Any]:
        names, make, merge = list(self.columns), self.partial, self.merge

        def rows_of(found: dict[int, Any], part: int) -> pa.RecordBatch:
            cells = [pa.array(list(found), pa.int32()), pa.array([part] * len(found), pa.int64()), pa.array([pickle.dumps(v) for v in found.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, ["bin", "part", "own"])

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, Any] = {}
            for batch in batches:
                which = batch.column(0).to_numpy(zero_copy_only=False)
                arrays = {n: batch.column(k + 1).to_numpy(zero_copy_only=False) for k, n in enumerate(names)}
                order = np.argsort(which, kind="stable")
                kinds, starts = np.unique(which[order], return_index=True)
                for k, rows in zip(kinds.tolist(), np.split(order, starts[1:]), strict=True) if len(kinds) else ():
                    new = make({n: x[rows] for n, x in arrays.items()})
                    found[k] = merge(found[k], new) if k in found else new
            yield rows_of(found, TaskContext.get().partitionId())

        def level(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                for own in batch.column("own").to_pylist():
                    new = pickle.loads(own)
                    out = new if out is None else merge(out, new)
            yield rows_of({key[0].as_py(): out}, key[1].as_py())

        kind = "bin int, part long, own binary"
        out = df.select(F.coalesce(index, F.lit(-1)).alias("_bin"), *names).mapInArrow(first, kind)
        parts = df.rdd.getNumPartitions()
        while parts > 1:
            parts = -(-parts // FAN)
            out = out.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("bin", "part").applyInArrow(level, kind)
        return {None if r["bin"] < 0 else r["bin"]: pickle.loads(bytes(r["own"])) for r in out.collect()}


class Medians(Partials):
    """Exact medians of a target, from counts of its distinct values: for targets that have few of them."""

    def __init__(self, target: str) -> None:
        self.columns = [target]

    def empty(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0), np.zeros(0, dtype=np.int64)

    def partial(self, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = columns[self.columns[0]].astype(float)
        return np.unique(x[~np.isnan(x)], return_counts=True)

    def merge(self, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        values, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
        return values, np.bincount(place, np.concatenate([a[1], b[1]]), len(values)).astype(np.int64)

    def row(self, stats: tuple, total: tuple) -> dict[str, float]:
        values, counts = stats
        n = int(counts.sum())
        ends = np.cumsum(counts)
        at = [float(values[np.searchsorted(ends, k, side="right")]) for k in ((n - 1) // 2, n // 2)] if n else []
        return {"cnt": n, "median": sum(at) / 2 if at else None}


class Fitted(list):
    """Bins with their strategy, and the partial result of all rows."""

    def __init__(self, bins: Iterable[Bin], strategy: Strategy, total: Any) -> None:
        super().__init__(bins)
        self.strategy, self.total = strategy, total

    def rows(self) -> list[dict[str, float]]:
        return [{"bin": k, "bin_name": b.name, **self.strategy.row(b.stats, self.total)} for k, b in enumerate(self)]


def fit(df: DataFrame, column: str, bins: list[Bin], strategy: Strategy) -> Fitted:
    found = strategy.fit(df, bin_index(F.col(column), bins))
    total = strategy.empty()
    for stats in found.values():
        total = strategy.merge(total, stats)
    for k, b in enumerate(bins):
        b.stats = found.get(k, strategy.empty())
    return Fitted(bins, strategy, total)


def merge_bins(bins: Fitted, limit: float, strategy: Strategy | None = None) -> Fitted:
    """Joins the neighbours of the least cost until it exceeds `limit`; the first of equal ones.

    Nothing is joined to a barrier. A join changes the costs beside it, or all, if the strategy looks wider.
    """
    by = strategy or bins.strategy
    out = list(bins)

    def cost(k: int) -> float:
        return math.inf if out[k].barrier or out[k + 1].barrier else by.cost(out, k)

    costs = [cost(k) for k in range(len(out) - 1)]
    while costs:
        k = min(range(len(costs)), key=costs.__getitem__)
        if costs[k] > limit:
            break
        out[k : k + 2] = [join(out[k], out[k + 1], by.merge(out[k].stats, out[k + 1].stats))]
        del costs[k]
        for i in range(len(costs)) if by.wide else (k - 1, k):
            if 0 <= i < len(costs):
                costs[i] = cost(i)
    return Fitted(out, bins.strategy, bins.total)


def merge_small(bins: Fitted, least: float) -> Fitted:
    return merge_bins(bins, least, Counts())


def merge_alike(bins: Fitted, limit: float = 0.95) -> Fitted:
    """Joins the neighbours that differ least until all differ with more than `limit` probability."""
    return merge_bins(bins, limit)


def woe(b: Bin, base: float) -> float:
    return math.log((b.bad + 0.5) / (b.good + 0.5)) - base


def base_of(total: dict) -> float:
    """Log odds of all rows, with half a bad one more; without a good one, half a good one too."""
    return math.log((total["bad"] + 0.5) / (total["good"] or 0.5))


def base_rate(bins: list[Bin]) -> float:
    """Log odds of all rows that were fitted; of plain lists, of the rows in their bins."""
    return base_of(bins.total if isinstance(bins, Fitted) else {"bad": sum(b.bad for b in bins), "good": sum(b.good for b in bins)})


def chi_cost(a: Bin, b: Bin) -> float:
    """Probability that two bins with equal rates differ less: small where merging loses little.

    Each cell gets a small pseudo-count; the shares that give the expected cells are of the raw total, and
    the second of two shares is what the first leaves. Two bins without rows differ in nothing.
    """
    total = a.good + a.bad + b.good + b.bad
    if not total:
        return 0.0
    soft = min(0.5, total / 10_000)
    cells = {("a", "good"): a.good + soft, ("a", "bad"): a.bad + soft, ("b", "good"): b.good + soft, ("b", "bad"): b.bad + soft}
    good, one = (a.good + b.good + 2 * soft) / total, (a.good + a.bad + 2 * soft) / total
    share = {"good": good, "bad": 1 - good, "a": one, "b": 1 - one}
    chi = 0.0
    for (row, column), value in cells.items():
        want = total * share[row] * share[column]
        if want == 0:
            return 1.0
        chi += (value - want) ** 2 / want
    return math.erf(math.sqrt(max(chi, 0.0) / 2))


def open_ends(bins: Fitted) -> Fitted:
    """The outer bins reach to infinity, for values that fitting didn't see; barriers stay points."""
    if bins and not bins[0].barrier:
        bins[0].low, bins[0].low_open = float("-inf"), False
    if bins and not bins[-1].barrier:
        bins[-1].high, bins[-1].high_open = float("inf"), False
    return bins


def woe_bins(df: DataFrame, column: str, label: str, parts: int = 100, least: int = 100, limit: float = 0.95, monotone: bool = False, single: bool = True, stable: Iterable[float] = ()) -> Fitted:
    """Equal-frequency bins and single ticks, joined until they are large enough and differ."""
    bins = intervals(_quantile_ticks(df, column, parts), single, stable)
    return open_ends(merge_alike(merge_small(fit(df, column, bins, Woe(label, monotone)), least), limit))


def binned(df: DataFrame, column: str, strategy: Strategy, parts: int = 10, single: bool = False, stable: Iterable[float] = (), limit: float | None = None) -> Fitted:
    """Equal-frequency bins fitted by any strategy, and joined by its cost if there is a limit."""
    found = fit(df, column, intervals(_quantile_ticks(df, column, parts), single, stable), strategy)
    return found if limit is None else merge_bins(found, limit)


def _name(bins: list[Bin]) -> Column:
    return F.try_element_at(F.array(*[F.lit(b.name) for b in bins]), F.col("bin") + 1) if bins else F.lit(None).cast("string")


def bin_table(df: DataFrame, column: str, targets: list[str], parts: int = 10) -> DataFrame:
    """Rows (bin_name, bin, cnt, mean_<target>...) of equal-frequency bins; null values fall in none."""
    return custom_table(df, column, {f"mean_{t}": F.avg(t) for t in targets}, parts)


def category_table(df: DataFrame, column: str, label: str, most: int = MAX_CATEGORIES) -> DataFrame:
    """Rows (category, cnt, bad, good, mean, woe) of a column with at most `most` values; else it stops."""
    out = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum((F.col(label) == 1).cast("int")).alias("bad"), F.sum((F.col(label) == 0).cast("int")).alias("good")
    )
    n, bad, good = out.agg(F.count(F.lit(1)), F.sum("bad"), F.sum("good")).first()
    if n > most:
        raise ValueError(f"{column} has {n} categories")
    base = F.lit(math.log(((bad or 0) + 0.5) / (good or 0.5)))
    return out.select(
        "category", "cnt", "bad", "good", (F.col("bad") / (F.col("cnt") + 0.5)).alias("mean"), (F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - base).alias("woe"),
    )


def apply_woe(df: DataFrame, column: str, bins: list[Bin], name: str) -> DataFrame:
    """`name`: the weight of evidence of the value's bin, null where it falls in none."""
    base = base_rate(bins)
    return apply_attribute(df, column, bins, [woe(b, base) for b in bins], name)


def to_json(bins: Fitted) -> str:
    """Bins and the counts of all rows as text; ends that are infinite as words."""
    def plain(b: Bin) -> dict:
        return {k: (str(v) if isinstance(v, float) and not math.isfinite(v) else v) for k, v in vars(b).items()}

    return json.dumps({"bins": [plain(b) for b in bins], "total": bins.total})


def from_json(text: str, strategy: Strategy | None = None) -> Fitted:
    held = json.loads(text)
    rows = [Bin(**{k: float(v) if k in ("low", "high") else v for k, v in row.items()}) for row in held["bins"]]
    return Fitted(rows, strategy or Woe("label"), held["total"])


def masked_table(df: DataFrame, column: str, target: str, mask: Column, parts: int = 10) -> DataFrame:
    """`bin_table` of the rows where `mask` holds; its bins come from those rows alone."""
    return bin_table(df.filter(mask), column, [target], parts)


def sum_table(df: DataFrame, column: str, target: str, parts: int = 10) -> DataFrame:
    """Rows (bin, bin_name, cnt, sum, mean) of equal-frequency bins."""
    return custom_table(df, column, {"sum": F.sum(target), "mean": F.avg(target)}, parts)


def custom_table(df: DataFrame, column: str, measures: dict[str, Column], parts: int = 10) -> DataFrame:
    """Rows (bin, bin_name, cnt, measures...) of equal-frequency bins, the measures any aggregates. A first bin of one value stands alone."""
    bins = intervals(_quantile_ticks(df, column, parts))
    rows = df.withColumn("bin", bin_index(F.col(column), bins)).filter("bin IS NOT NULL")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("cnt"), *[m.alias(n) for n, m in measures.items()]).withColumn("bin_name", _name(bins))


def apply_attribute(df: DataFrame, column: str, bins: list[Bin], values: list[float], name: str) -> DataFrame:
    """`name`: the bin's given value, null where the value falls in no bin."""
    index = bin_index(F.col(column), bins)
    if not bins:
        return df.withColumn(name, F.lit(None).cast("double"))
    return df.withColumn(name, F.try_element_at(F.array(*[F.lit(float(v)) for v in values]), (index + 1).cast("int")))


def bin_frame(bins: Fitted, like: DataFrame, schema: str) -> DataFrame:
    """The published numbers of fitted bins as rows of the given columns."""
    names = [c.split()[0] for c in schema.split(", ")]
    return like.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in bins.rows()], schema)
