"""Correlation of factors (x) and targets (y).

A matrix is one aggregate: for every pair five sums under the pair's null mask, combined on the map
side, so the input is read once whatever the number of pairs. Constant columns give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.operators.relational import columns_like
from ticktide.operators.scan import average_rank, global_rank


def _sums(x: str, y: str, tag: str) -> list[Column]:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    parts = {"n": F.count(a), "x": F.sum(a), "y": F.sum(b), "xx": F.sum(a * a), "yy": F.sum(b * b), "xy": F.sum(a * b)}
    return [v.alias(f"{tag}_{k}") for k, v in parts.items()]


def pearson_of(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    spread = F.sqrt(F.greatest(n * xx - x * x, F.lit(0.0))) * F.sqrt(F.greatest(n * yy - y * y, F.lit(0.0)))
    return F.when(n > 1, F.try_divide(n * xy - x * y, F.when(spread > 0, spread)))


def matrix(df: DataFrame, xs: list[str], ys: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows (by..., x, y, n, corr), Pearson over the rows where both are present."""
    by = by or []
    pairs = [(x, y) for x in xs for y in ys]
    sums = df.groupBy(*by).agg(*[c for k, (x, y) in enumerate(pairs) for c in _sums(x, y, f"p{k}")])
    cells = [
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"p{k}_n").alias("n"), pearson_of(*[F.col(f"p{k}_{s}") for s in ("n", "x", "y", "xx", "yy", "xy")]).alias("corr"))
        for k, (x, y) in enumerate(pairs)
    ]
    return sums.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")


def spearman(df: DataFrame, xs: list[str], ys: list[str], by: list[str] | None = None) -> DataFrame:
    """The same of average ranks; ranks are taken over all rows (of `by`), before pairs are masked."""
    columns = list(dict.fromkeys([*xs, *ys]))
    if by:
        return matrix(df.select(*by, *[average_rank(F.col(c), by).alias(c) for c in columns]), xs, ys, by)
    for c in columns:
        df = global_rank(df, c, f"_rank_{c}")
    return matrix(df.select(*[F.col(f"_rank_{c}").alias(c) for c in columns]), xs, ys)


def pair_means(df: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    """Rows (x, y, mean_x, mean_y) over the rows where both are present."""
    pairs = [(x, y) for x in xs for y in ys]
    both = [F.col(x).isNotNull() & F.col(y).isNotNull() for x, y in pairs]
    aggs = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.avg(F.when(b, F.col(x))).alias("mean_x"), F.avg(F.when(b, F.col(y))).alias("mean_y")) for (x, y), b in zip(pairs, both, strict=True)]
    return df.agg(F.array(*aggs).alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*")


def daywise(df: DataFrame, day: str, xs: list[str], ys: list[str]) -> DataFrame:
    """Mean, population deviation and their ratio of the daily correlations of each pair."""
    daily = matrix(df, xs, ys, [day]).groupBy("x", "y")
    stats = daily.agg(F.avg("corr").alias("mean"), F.stddev_pop("corr").alias("std"), F.count("corr").alias("days"))
    return stats.withColumn("sharpe", F.try_divide("mean", F.when(F.col("std") > 0, F.col("std"))))


def self_correlation(df: DataFrame, day: str, xs: list[str], ys: list[str]) -> DataFrame:
    """Mean product of neighbouring days' correlations (null as 0) over their mean square."""
    daily = matrix(df, xs, ys, [day]).withColumn("c", F.coalesce("corr", F.lit(0.0)))
    pairs = daily.withColumn("before", F.lag("c").over(Window.partitionBy("x", "y").orderBy(day)))
    sums = pairs.groupBy("x", "y").agg(F.sum(F.col("c") * F.col("before")).alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count(F.lit(1)).alias("n"))
    return sums.select("x", "y", F.try_divide(F.try_divide("s", F.col("n") - 1), F.try_divide("q", F.col("n"))).alias("self_corr"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (name, null_rate)."""
    rates = [F.struct(F.lit(c).alias("name"), F.avg(F.col(c).isNull().cast("int")).alias("null_rate")) for c in columns]
    return df.agg(F.array(*rates).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def by_period(frames: dict[int, DataFrame], xs: list[str], ys: list[str], day: str | None = None) -> DataFrame:
    """One long table of matrices, a frame for each bar period; with `day`, beside the daily correlations' mean, deviation and ratio."""
    out: DataFrame | None = None
    for period, df in frames.items():
        one = matrix(df, xs, ys).withColumn("period", F.lit(period))
        one = one if day is None else one.join(daywise(df, day, xs, ys), ["x", "y"])
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no frames")
    return out


def factor_report(df: DataFrame, day: str, x_pattern: str = "^TX", y_pattern: str = r"^O?M?R[MT]\d+$") -> DataFrame:
    """Rows (x, y, n, corr, mean, std, days, sharpe, self_corr, null_rate) of the factors and targets named by pattern."""
    xs, ys = columns_like(df, x_pattern), columns_like(df, y_pattern)
    whole, daily, own = matrix(df, xs, ys), daywise(df, day, xs, ys), self_correlation(df, day, xs, ys)
    rates = null_rates(df, xs).withColumnRenamed("name", "x")
    return whole.join(daily, ["x", "y"]).join(own, ["x", "y"]).join(rates, "x")
