"""Recurrences by ranges against plain loops: one series over many ranges, many series in one range."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import sequential
from ticktide.operators import indicators, ranges, scan


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = np.random.default_rng(7), []
    for key, n in (("a", 900), (None, 3), ("b", 1), ("c", 260), ("d", 40)):
        c = 100 + np.cumsum(rng.normal(size=n))
        for i in range(n):
            spread = rng.uniform(0.1, 2, 2)
            rows.append((key, i, float(c[i] + rng.normal()), float(c[i] + spread[0]), float(c[i] - spread[1]), float(c[i]), float(rng.integers(1, 99)), bool(rng.uniform() < 0.3)))
    df = spark.createDataFrame(rows, "k string, t int, open double, high double, low double, close double, volume double, flag boolean")
    return df.repartition(5).cache()


def of_series(df, columns):
    rows = {}
    for r in sorted(df.select("k", "t", *columns).collect(), key=lambda r: (r["k"] or "", r["t"])):
        rows.setdefault(r["k"], []).append([np.nan if r[c] is None else float(r[c]) for c in columns])
    return {k: dict(zip(columns, np.array(v).T, strict=True)) for k, v in rows.items()}


def test_linear_scan():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 1000):
        a, b, y = rng.uniform(-1, 1, n), rng.normal(size=n), 3.0
        want = []
        for x, z in zip(a, b):
            want.append(y := x * y + z)
        assert np.allclose(ranges.linear(a, b, 3.0), want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("parts", [1, 9])
def test_series_over_ranges(spark, bars, parts):
    df = bars.withColumn("x", F.when(F.col("t") % 11 == 0, None).otherwise(F.col("close")))
    out = scan.jump(scan.ema(df, ["k"], ["t"], "x", 4.0, ranges=parts), ["k"], ["t"], "flag", 6, ranges=parts)
    assert parts == 1 or out.filter("k = 'a'").select(F.spark_partition_id()).distinct().count() > 3
    for o in of_series(out, ["x", "ema", "flag", "taken"]).values():
        mean, wait, means, taken = None, 0, [], []
        for x, flag in zip(o["x"], o["flag"]):
            if x == x:
                mean = x if mean is None else mean + (x - mean) / 4
            means.append(np.nan if mean is None else mean)
            taken.append(flag == 1 and wait <= 0)
            wait = 5 if taken[-1] else wait - 1
        assert np.allclose(o["ema"], means, rtol=1e-12, equal_nan=True) and (o["taken"] == taken).all()


@pytest.mark.parametrize("span", [1, 2, 7, 400])
def test_waits_cross_ranges(spark, bars, span):
    out = scan.jump(bars, ["k"], ["t"], "flag", span, ranges=12)
    for o in of_series(out, ["flag", "taken"]).values():
        wait = 0
        for flag, taken in zip(o["flag"], o["taken"]):
            assert bool(taken) == (flag == 1 and wait <= 0)
            wait = span - 1 if taken else wait - 1


@pytest.mark.parametrize("parts", [1, 8])
def test_recursive_indicators_equal_plain_loops(spark, bars, parts):
    names = indicators.RECURSIVE
    out = indicators.with_recursive(bars, ["k"], ["t"], ranges=parts)
    for o in of_series(out, ["open", "high", "low", "close", "volume", *names]).values():
        want = sequential.recursive(o)
        assert set(want) == set(names)
        for n in names:
            assert np.allclose(o[n], want[n], rtol=1e-8, atol=1e-8, equal_nan=True), n


def test_sweeps_equal_plain_loops(spark, bars):
    out = indicators.with_sweep(bars, ["k"], ["t"], (3, 5, 10), ranges=6)
    names = list(indicators.sweep_values((3, 5, 10)))
    for o in of_series(out, ["open", "high", "low", "close", "volume", *names]).values():
        want = sequential.sweep(o, (3, 5, 10))
        for n in names:
            assert np.allclose(o[n], want[n], rtol=1e-8, atol=1e-8, equal_nan=True), n


def test_nothing_at_all(spark):
    none = spark.createDataFrame([], "k string, t int, x double, flag boolean")
    out = scan.jump(scan.ema(none, ["k"], ["t"], "x", 3.0), ["k"], ["t"], "flag", 2)
    assert out.count() == 0 and out.columns == ["k", "t", "x", "flag", "ema", "taken"]
