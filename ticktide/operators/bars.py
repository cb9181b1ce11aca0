"""Bars and forward returns.

A bar groups ticks by a bucket of time or of tick number; open and close are the values of the
first and last tick that have one, by (order columns). All aggregates combine on the map side.
Forward returns are leads over one shared window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.operators.scan import Names, series


def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def tick_bucket(time: Column, period: int) -> Column:
    """Bucket of a time in seconds on the half-second grid: `period` ticks a bar."""
    return F.floor((2 * time - 1) / period).cast("int")


def first_of(value: str, order: Column) -> Column:
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def last_of(value: str, order: Column) -> Column:
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def bars(df: DataFrame, keys: list[str], order: list[str], price: str, volume: str | None = None, amount: str | None = None) -> DataFrame:
    """open, high, low, close, n_ticks (and volume, amount) for each group of `keys`."""
    place = F.struct(*order)
    aggs = [
        first_of(price, place).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), last_of(price, place).alias("close"),
        F.count(F.lit(1)).alias("n_ticks"),
    ]
    aggs += [F.sum(c).alias(n) for c, n in ((volume, "volume"), (amount, "amount")) if c]
    return df.groupBy(*keys).agg(*aggs)


def rolling_bars(df: DataFrame, by: Names, order: Names, rows: int, price: str, volume: str) -> DataFrame:
    """high_n, low_n, vol_n, count_n over the last `rows` ticks of each series, at every tick."""
    from pyspark.sql import Window

    w = series(by, order).rowsBetween(-(rows - 1), Window.currentRow)
    return df.withColumns({"high_n": F.max(price).over(w), "low_n": F.min(price).over(w), "vol_n": F.sum(volume).over(w), "count_n": F.count(F.lit(1)).over(w)})


#: Forward horizons: (name, ticks). A minute has 120 ticks.
HORIZONS = [(f"M{m}", 120 * m) for m in (30, 20, 15, 10, 5, 3, 2, 1)] + [(f"T{t}", t) for t in (60, 30, 20, 10, 5, 3, 1)]


def return_name(horizon: str, mid: bool, across_days: bool) -> str:
    """The name grammar of return columns: O for across days, M for the mid price, R, then the horizon."""
    return f"{'O' if across_days else ''}{'M' if mid else ''}R{horizon}"


def forward_returns(
    df: DataFrame, by: list[str], day: str, order: list[str], prices: dict[bool, str], horizons: list[tuple[str, int]] = HORIZONS, zero_is_missing: bool = True
) -> DataFrame:
    """Price in so many ticks less the price now; `prices` maps False (traded) and True (mid) to columns.

    Within-day returns end with the day, across-day ones with the series `by`. Prices are never 0 in
    a market, so a later 0 counts as missing unless `zero_is_missing` is off.
    """
    new: dict[str, Column] = {}
    for across in (False, True):
        w = series(by if across else [*by, day], order)
        for mid, column in prices.items():
            for name, ticks in horizons:
                later = F.lead(column, ticks).over(w)
                new[return_name(name, mid, across)] = (F.nullif(later, F.lit(0)) if zero_is_missing else later) - F.col(column)
    return df.withColumns(new)
