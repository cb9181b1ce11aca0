"""Signal back-tests: signed plays, their statistics, quantile buckets and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.operators.quantiles import quantiles
from ticktide.operators.scan import jump, running


def play(signal: Column, reward: Column) -> Column:
    """The reward where the signal is positive, its negative where it is negative, else no play."""
    return F.when(signal > 0, reward).when(signal < 0, -reward)


def stats(df: DataFrame, by: list[str], order: list[str], plays: str) -> DataFrame:
    """Statistics of the plays that aren't null, per group of `by`.

    The drawdown is that of the running sum of plays in order; calmar = sum / drawdown, sharpe =
    mean / sample deviation.
    """
    rows = df.filter(F.col(plays).isNotNull())
    rows = rows.withColumn("_sum", F.sum(plays).over(running(by, order)))
    rows = rows.withColumn("_down", F.max("_sum").over(running(by, order)) - F.col("_sum"))
    p = F.col(plays)
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_plays"), F.avg(p).alias("r_mean"), F.sum(p).alias("r_sum"), F.stddev_samp(p).alias("r_std"),
        F.avg((p > 0).cast("int")).alias("win_rate"), F.avg(F.when(p > 0, p)).alias("win_mean"),
        F.avg((p < 0).cast("int")).alias("lose_rate"), F.avg(F.when(p < 0, p)).alias("lose_mean"), F.max("_down").alias("max_drawdown"),
    )
    return out.withColumns({
        "calmar": F.try_divide("r_sum", F.when(F.col("max_drawdown") > 0, F.col("max_drawdown"))),
        "sharpe": F.try_divide("r_mean", F.when(F.col("r_std") > 0, F.col("r_std"))),
    })


def edges(df: DataFrame, column: str, parts: int) -> list[float]:
    """Distinct inner quantiles (linear interpolation) of `column`."""
    return sorted(set(quantiles(df, {column: F.col(column)}, [k / parts for k in range(1, parts)])[column]))


def bucket(column: Column, cuts: list[float]) -> Column:
    """Number of the bucket, left-open: at most cuts[0] is 0; null has none."""
    out = F.lit(len(cuts))
    for k in range(len(cuts) - 1, -1, -1):
        out = F.when(column <= cuts[k], F.lit(k)).otherwise(out)
    return F.when(column.isNotNull(), out)


def quantile_backtest(df: DataFrame, factor: str, reward: str, parts: int, order: list[str]) -> DataFrame:
    """The statistics of `reward` in each quantile bucket of `factor`."""
    rows = df.withColumn("bucket", bucket(F.col(factor), edges(df, factor, parts))).filter("bucket IS NOT NULL")
    return stats(rows, ["bucket"], order, reward)


def tail_backtest(df: DataFrame, factor: str, reward: str, share: float, order: list[str]) -> DataFrame:
    """Long the lowest `share` of the factor, short the highest, and both together."""
    low, high = quantiles(df, {factor: F.col(factor)}, [share, 1 - share])[factor] or [None, None]
    f, r = F.col(factor), F.col(reward)
    sides = F.array(
        F.struct(F.lit("long").alias("side"), F.when(f <= low, r).alias("play")), F.struct(F.lit("short").alias("side"), F.when(f >= high, -r).alias("play")),
        F.struct(F.lit("both").alias("side"), F.when(f <= low, r).when(f >= high, -r).alias("play")),
    )
    rows = df.select(*order, F.explode(sides).alias("s")).select(*order, "s.*")
    return stats(rows, ["side"], order, "play")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first `k` rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def spaced_backtest(df: DataFrame, by: list[str], order: list[str], signal: str, reward: str, span: int) -> DataFrame:
    """Statistics of non-overlapping plays: a signal counts only `span` rows or more after the last one that counted.

    A signal without a reward is none: it isn't taken and blocks no later one. Adds exch_count, the signals taken, and exch_ratio, their share of all rows.
    """
    fires = F.coalesce((F.col(signal) != 0) & F.col(reward).isNotNull(), F.lit(False))
    rows = jump(df.select(*dict.fromkeys([*by, *order, signal, reward]), fires.alias("_fires")), by, order, "_fires", span)
    rows = rows.withColumn("play", F.when(F.col("taken"), play(F.col(signal), F.col(reward))))
    counts = rows.groupBy(*by).agg(F.count_if("taken").alias("exch_count"), F.avg(F.col("taken").cast("int")).alias("exch_ratio"))
    return stats(rows, by, order, "play").join(counts, by)
