"""Streaming bars: tumbling windows with a watermark, for append sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, ts: str, key: str, price: str, width: str = "5 minutes", late: str = "10 minutes", order: tuple[str, ...] = ()) -> DataFrame:
    """open, high, low, close, n_ticks per key and window; windows close when the watermark passes.

    Ticks of equal time come in the order of the columns `order`, then of their prices.
    """
    rows = ticks.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    place = F.when(F.col(price).isNotNull(), F.struct("_ts", *order, price))
    out = rows.groupBy(F.window("_ts", width), key).agg(
        F.min_by(price, place).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, place).alias("close"), F.count(F.lit(1)).alias("n_ticks")
    )
    return out.select(key, F.col("window.start").alias("start"), "open", "high", "low", "close", "n_ticks")
