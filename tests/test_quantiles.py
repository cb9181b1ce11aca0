import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticktide.operators import backtest, relational
from ticktide.operators.quantiles import order_statistics, ordered, quantiles

ODD = [0.0, -0.0, 1.0, -1.0, 2.0, 4.0, 3.9999999999999996, 1e-300, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 0.1, 0.30000000000000004]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(4)


def test_code_rises_with_the_value(spark):
    rng = random.Random(1)
    values = ODD + [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(4000)]
    values = [v for v in values if v == v] + [2.0**k for k in range(-1074, 1024)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024)]
    rows = sorted((r["x"], r["k"]) for r in frame(spark, values).select("x", ordered(F.col("x")).alias("k")).collect())
    for (a, i), (b, j) in zip(rows, rows[1:]):
        assert (i < j) if a < b else i == j


@pytest.mark.parametrize("values", [ODD, [7.0] * 50, [1.5], [float(k % 13) for k in range(500)], [math.exp(k / 7) * (-1) ** k for k in range(900)]])
def test_places(spark, values):
    n, found = order_statistics(frame(spark, [*values, None]), {"x": F.col("x")}, {"x": range(0, len(values), max(1, len(values) // 7))})["x"]
    want = sorted(values)
    assert n == len(values) and found and all(v == want[p] for p, v in found.items())


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=3001) * 1e6, rng.integers(0, 9, 3001)
    df = spark.createDataFrame([(float(x), int(y), None) for x, y in zip(a, b)], "a double, b long, c double").repartition(5)
    shares = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.95, 1.0]
    got = quantiles(df, {c: F.col(c) for c in "abc"}, shares)
    assert np.allclose(got["a"], np.quantile(a, shares), rtol=1e-14) and np.allclose(got["b"], np.quantile(b, shares)) and got["c"] == []


def test_no_rows(spark):
    none = frame(spark, [])
    assert quantiles(none, {"x": F.col("x")}, [0.5]) == {"x": []}
    assert relational.quantile_parts(none, "x", [0.0, 1.0]) == [] and relational.long_quantile(none, [], ["x"], 0.5).count() == 0
    both = spark.createDataFrame([], "t int, f double, r double")
    assert backtest.tail_backtest(both, "f", "r", 0.1, ["t"]).count() == 0
