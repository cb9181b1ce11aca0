"""Trailing sums of price-volume maps.

In long form, a row per tick and price, a trailing sum over the last `rows` ticks of a series is a
range frame over the tick's place: the running sum telescopes per price, so the work is in the
number of levels, not in the length of the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticktide.functions import pvmap as pv


def to_long(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.select(*keys, F.explode(pv.or_empty(F.col(column))).alias("price", "volume"))


def to_maps(long: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Maps back from rows (keys, price, volume); equal prices add up, zeros are left out."""
    sums = long.groupBy(*keys, "price").agg(F.sum("volume").alias("volume")).filter("volume <> 0")
    return sums.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("price", "volume")))).alias(name))


def trailing(df: DataFrame, by: list[str], place: str, column: str, rows: int) -> DataFrame:
    """Rows (by, place, price, volume): the sum of `column` over the last `rows` places, non-zero prices only.

    Each volume enters at its place and leaves `rows` places later; the sum at a place is the running
    sum of both. A place is given out for a price while the price's sum lasts.
    """
    enter = to_long(df, [*by, place], column)
    leave = enter.withColumns({place: F.col(place) + rows, "volume": -F.col("volume")})
    steps = enter.unionByName(leave).groupBy(*by, "price", place).agg(F.sum("volume").alias("step"))
    w = Window.partitionBy(*by, "price").orderBy(place)
    lasting = steps.withColumns({"volume": F.sum("step").over(w), "_next": F.lead(place).over(w)})
    ends = df.groupBy(*by).agg(F.max(place).alias("_end"))
    spans = lasting.filter("volume <> 0").join(ends, by).withColumn("_stop", F.least(F.coalesce(F.col("_next") - 1, F.col("_end")), F.col("_end")))
    return spans.filter(F.col("_stop") >= F.col(place)).select(*by, F.explode(F.sequence(F.col(place), F.col("_stop"))).alias(place), "price", "volume")


def balance(above: str, below: str):
    """(above + 1) / (above + below + 2)."""
    return (F.col(above) + 1) / (F.col(above) + F.col(below) + 2)
