"""Ordered scans over series: lags, fills, segments, runs, greedy selection, exponential means.

A series is a set of partition columns (for example symbol and day) with an order. Functions take
the partition and order columns by name and return a DataFrame with added columns; all windows of
one function share one sort. `jump` and `ema`, which are sequential by nature, run over ranges of a
series and carry their state from range to range.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ticktide.operators.ranges import Greedy, Value, column, each, ewm, with_values

Names = Iterable[str]


def series(by: Names, order: Names) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def running(by: Names, order: Names) -> WindowSpec:
    return series(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def backwards(by: Names, order: Names) -> WindowSpec:
    """From a series' end to the current row, so a value over all later rows is a running one."""
    return Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lag_reset(df: DataFrame, by: Names, order: Names, prices: Names, volumes: Names, step: int = 1) -> DataFrame:
    """`<c>_last`: the value `step` rows before; at a series' start a price keeps itself, a volume is 0."""
    w = series(by, order)
    new = {f"{c}_last": F.coalesce(F.lag(c, step).over(w), F.col(c)) for c in prices}
    return df.withColumns(new | {f"{c}_last": F.coalesce(F.lag(c, step).over(w), F.lit(0)) for c in volumes})


def difference(df: DataFrame, by: Names, order: Names, columns: Names, step: int = 1) -> DataFrame:
    """`<c>_diff`: the change over `step` rows; the first rows keep their value."""
    w = series(by, order)
    return df.withColumns({f"{c}_diff": F.col(c) - F.coalesce(F.lag(c, step).over(w), F.lit(0)) for c in columns})


def forward_fill(column: Column, by: Names, order: Names) -> Column:
    return F.last(column, ignorenulls=True).over(running(by, order))


def backward_fill(column: Column, by: Names, order: Names) -> Column:
    return F.last(column, ignorenulls=True).over(backwards(by, order))


def wave_id(df: DataFrame, by: Names, order: Names, cond: str, name: str = "wave") -> DataFrame:
    """Number of rows with `cond` before this one: a new id begins behind each of them."""
    w = series(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(F.col(cond).cast("int")).over(w), F.lit(0)).cast("long"))


def segment_scans(df: DataFrame, by: Names, order: Names, cond: str, value: str) -> DataFrame:
    """Running sum, largest and smallest value since the last row with `cond`, that row included.

    Before the first such row the largest and smallest start from 0.
    """
    by = list(by)
    df = df.withColumn("_segment", F.sum(F.col(cond).cast("int")).over(running(by, order)))
    w, v = running([*by, "_segment"], order), F.col(value)
    high, low = F.max(v).over(w), F.min(v).over(w)
    open_ = F.col("_segment") == 0
    return df.withColumns({
        "seg_sum": F.sum(v).over(w),
        "seg_max": F.when(open_, F.greatest(high, F.lit(0))).otherwise(high),
        "seg_min": F.when(open_, F.least(low, F.lit(0))).otherwise(low),
    }).drop("_segment")


def split_index(df: DataFrame, by: Names, order: Names, cond: str) -> DataFrame:
    """Distance to the last row with `cond` (or the start) and to the row before the next one, and both places."""
    by = list(by)
    df = df.withColumns({
        "_segment": F.sum(F.col(cond).cast("int")).over(running(by, order)), "_place": (F.row_number().over(series(by, order)) - 1).cast("long"),
    })
    seg = Window.partitionBy(*by, "_segment")
    first, last = F.min("_place").over(seg), F.max("_place").over(seg)
    return df.withColumns({
        "to_front": F.col("_place") - first, "to_end": last - F.col("_place"), "front_idx": first, "end_idx": last,
    }).drop("_segment", "_place")


def stable_run(df: DataFrame, by: Names, order: Names, stable: str) -> DataFrame:
    """Places of the last and the next row that is not stable, and the distances to them."""
    by = list(by)
    df = df.withColumn("_place", (F.row_number().over(series(by, order)) - 1).cast("long"))
    broken = F.when(~F.col(stable), F.col("_place"))
    df = df.withColumns({"last_unstable": F.max(broken).over(running(by, order)), "next_unstable": F.min(broken).over(backwards(by, order))})
    return df.withColumns({"since_unstable": F.col("_place") - F.col("last_unstable"), "until_unstable": F.col("next_unstable") - F.col("_place")}).drop("_place")


def rolling(df: DataFrame, by: Names, order: Names, rows: int, sums: Names = (), highs: Names = (), lows: Names = ()) -> DataFrame:
    """`<c>_sum`, `<c>_max`, `<c>_min` over the last `rows` rows, and `count_n`."""
    w = series(by, order).rowsBetween(-(rows - 1), Window.currentRow)
    new = {f"{c}_sum": F.sum(c).over(w) for c in sums} | {f"{c}_max": F.max(c).over(w) for c in highs} | {f"{c}_min": F.min(c).over(w) for c in lows}
    return df.withColumns(new | {"count_n": F.count(F.lit(1)).over(w)})


def phases(df: DataFrame, by: Names, order: Names, step: int) -> DataFrame:
    """`phase`: every `step`-th row of a series forms a series of its own, with its place in it."""
    n = F.row_number().over(series(by, order)) - 1
    return df.withColumns({"phase": (n % step).cast("int"), "phase_row": F.floor(n / step).cast("long")})


def drawdown(column: Column, by: Names, order: Names) -> Column:
    """How far `column` will yet fall below its present value."""
    return column - F.min(column).over(backwards(by, order))


def lags(df: DataFrame, by: Names, order: Names, columns: Names, steps: int) -> DataFrame:
    """`<c>_lag1` to `<c>_lag<steps>`."""
    w = series(by, order)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in range(1, steps + 1)})


def first_in_wave(column: Column, by: Names, order: Names, wave: str = "wave") -> Column:
    """The wave's first value."""
    return F.first(column).over(running([*by, wave], order))


def value_at(df: DataFrame, by: Names, order: Names, column: str, place: str, name: str) -> DataFrame:
    """`name`: the value of `column` in the row whose place (from 0) in the series the column `place` gives.

    A join on (series, place), so a place may lie anywhere; one outside the series gives null.
    """
    by = list(by)
    numbered = df.withColumn("_n", (F.row_number().over(series(by, order)) - 1).cast("long"))
    there = numbered.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_n").alias("_at"), F.col(column).alias(name))
    on = F.col(place).cast("long") == F.col("_at")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return df.join(there, on, "left").drop(*[f"_by{i}" for i in range(len(by))], "_at")


def running_totals(df: DataFrame, value: str, columns: Names, parts: int | None = None) -> DataFrame:
    """`<c>_before`, the sum of `c` over all rows with a smaller `value`, and `<c>_whole`, over all rows.

    Values should be distinct. Rows are dealt to ranges between approximate quantiles; each range is
    summed and sorted by itself, and the sums of the ranges before it (a row a range) are added, so
    no task gets all rows.
    """
    columns = list(columns)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = df.agg(F.percentile_approx(value, F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10 * parts).alias("q")).first()["q"] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    span = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(value))) if cuts else F.lit(0)
    rows = df.withColumn("_span", span)
    up = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_span").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    ahead = sums.select("_span", *[F.coalesce(F.sum(f"_{c}").over(up), F.lit(0)).alias(f"_a_{c}") for c in columns], *[F.sum(f"_{c}").over(Window.partitionBy()).alias(f"{c}_whole") for c in columns])
    inside = Window.partitionBy("_span").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"_b_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    out = own.join(F.broadcast(ahead), "_span").withColumns({f"{c}_before": F.col(f"_a_{c}") + F.col(f"_b_{c}") for c in columns})
    return out.drop("_span", *[f"_{k}_{c}" for c in columns for k in "ab"])


def global_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """`name`: the average rank over the whole table, from the counts of distinct values; null stays null."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_totals(counts, "_v", ["_n"]).select("_v", (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, df[column] == ranks["_v"], "left").drop("_v")


def average_rank(column: Column, by: Names = ()) -> Column:
    """Rank from 1, equal values share their mean rank; null has none."""
    order = Window.partitionBy(*by).orderBy(column)
    equal = Window.partitionBy(*by, column)
    return F.when(column.isNotNull(), F.rank().over(order) - F.count(F.when(column.isNull(), 1)).over(Window.partitionBy(*by)) + (F.count(F.lit(1)).over(equal) - 1) / 2)


def jump(df: DataFrame, by: list[str], order: list[str], cond: str, span: int, name: str = "taken", ranges: int | None = None) -> DataFrame:
    """Greedy choice of rows with `cond` that lie at least `span` rows after the last one taken, over ranges of a series."""
    flags = each(lambda x: x > 0, column(cond))
    return with_values(df, by, order, {name: Value([flags], scan=Greedy(span))}, ranges, [name])


def ema(df: DataFrame, by: list[str], order: list[str], value: str, rate: float, name: str = "ema", ranges: int | None = None) -> DataFrame:
    """m += (x - m) / rate, from the first value on; a null leaves the mean as it is. Over ranges of a series."""
    return with_values(df, by, order, {name: ewm(column(value), 1 / rate, 1)}, ranges)


def grid_fill(df: DataFrame, by: list[str], tick: str, values: list[str], flag: str = "filled") -> DataFrame:
    """A row for every integer tick between a series' first and last one; inserted rows are flagged and filled forward."""
    ends = df.groupBy(*by).agg(F.min(tick).alias("_a"), F.max(tick).alias("_b"))
    grid = ends.select(*by, F.explode(F.sequence("_a", "_b")).alias(tick))
    joined = grid.join(df.select(*by, tick, *values, F.lit(False).alias(flag)), [*by, tick], "left")
    filled = {c: forward_fill(F.col(c), by, [tick]) for c in values}
    return joined.withColumns(filled).withColumn(flag, F.coalesce(F.col(flag), F.lit(True)))


def direction_runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows with a change of `value` other than 0: its sign, whether the sign turned, and the run's number."""
    moves = df.filter(F.col(value) != 0).withColumn("sign", F.signum(value).cast("int"))
    turned = moves.withColumn("turned", F.coalesce(F.lag("sign").over(series(by, order)) != F.col("sign"), F.lit(False)))
    return turned.withColumn("run", F.sum(F.col("turned").cast("int")).over(running(by, order)))
