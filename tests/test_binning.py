import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticktide.operators import binning as B


def of(*counts, barriers=()):
    bins = [B.Bin(float(k), float(k + 1), k > 0, False, k in barriers, {"cnt": g + b, "good": g, "bad": b}) for k, (g, b) in enumerate(counts)]
    return B.Fitted(bins, B.Woe("y"), {"cnt": sum(g + b for g, b in counts), "good": sum(g for g, _ in counts), "bad": sum(b for _, b in counts)})


def test_rules_by_hand():
    # base: ln((20 + .5) / 80); cost of two bins by hand: soft = min(.5, 100 / 10000) = .01
    bins = of((45, 5), (35, 15))
    assert abs(B.base_rate(bins) - math.log(20.5 / 80)) < 1e-12
    good, one = (80 + 0.02) / 100, (50 + 0.02) / 100
    want = [100 * p * q for q in (one, 1 - one) for p in (good, 1 - good)]
    chi = sum((v + 0.01 - w) ** 2 / w for v, w in zip((45, 5, 35, 15), want))
    assert abs(B.chi_cost(*bins) - math.erf(math.sqrt(chi / 2))) < 1e-12
    # a bin of exactly `least` rows, with a fraction for its larger neighbour, costs more than `least`
    assert [b.cnt for b in B.merge_small(of((10, 0), (100, 0), (50, 50)), 10)] == [10, 100, 100]
    assert [b.cnt for b in B.merge_small(of((9, 0), (100, 0), (50, 50)), 10)] == [109, 100]
    # directions up, up, down: steps 0 and 1 have one neighbour of their direction, step 2 none
    bins = of((90, 10), (80, 20), (70, 30), (75, 25))
    bins.strategy = B.Woe("y", monotone=True)
    plain = [B.chi_cost(a, b) for a, b in zip(bins, bins[1:])]
    mono = [1 - (1 - c) * (k + 2) / 2 ** (k + 1) for c, k in zip(plain, (1, 1, 0))]
    assert [bins.strategy.cost(bins, k) for k in range(3)] == pytest.approx(mono)
    first = min(mono)
    assert len(B.merge_alike(bins, first)) <= 3 and B.merge_alike(bins, first - 1e-9) == bins
    assert B.chi_cost(*of((0, 0), (0, 0))) == 0.0


def test_splits():
    names = lambda *a, **k: [b.name for b in B.intervals(*a, **k)]
    assert names([1, 2, 4]) == ["[1,2]", "(2,4]"]
    assert names([4, 1, 2, 2]) == ["[1,2]", "(2,4]"]
    assert names([1, 1, 2, 2, 4]) == ["[1,1]", "(1,2]", "(2,4]"]
    assert names([1, 2, 4], single=True) == ["[1,1]", "(1,2)", "[2,2]", "(2,4)", "[4,4]"]
    assert names([1, 1, 2], single=True) == ["[1,1]", "(1,2)", "[2,2]"]
    assert names([1, 2, 4], stable=[2]) == ["[1,2)", "[2,2]", "(2,4]"]
    assert names([1, 2, 4], stable=[1, 3]) == ["[1,1]", "(1,2]", "(2,3)", "[3,3]", "(3,4]"]
    assert names([1, 1, 4], stable=[1]) == ["[1,1]", "(1,4]"]
    assert names([3]) == names([3, 3]) == names([3], single=True) == ["[3,3]"]
    assert names([]) == []
    assert [b.barrier for b in B.intervals([1, 2, 4], single=True, stable=[2])] == [False, False, True, False, False]


def test_nothing_merges_over_a_barrier():
    # the case of the review: [0,5) 4 rows, [5,5] 50, (5,10] 4, (10,20] 90, least 10
    bins = B.intervals([0, 10, 20], stable=[5])
    for b, n in zip(bins, (4, 50, 4, 90), strict=True):
        b.stats = {"cnt": n, "good": n, "bad": 0}
    merged = B.merge_small(B.Fitted(bins, B.Woe("y"), {"cnt": 148, "good": 148, "bad": 0}), 10)
    assert [(b.name, b.cnt) for b in merged] == [("[0,5)", 4), ("[5,5]", 50), ("(5,20]", 94)]
    # a point that is no barrier merges
    plain = B.intervals([0, 5, 20], single=True)
    for b in plain:
        b.stats = {"cnt": 1, "good": 1, "bad": 0}
    assert [b.name for b in B.merge_small(B.Fitted(plain, B.Woe("y"), {}), 10)] == ["[0,20]"]
    ends = B.open_ends(B.merge_small(B.Fitted(B.intervals([5, 6, 9], stable=[5]), B.Woe("y"), {}), -1))
    assert [b.name for b in ends] == ["[5,5]", "(5,6]", "(6,inf]"]


def plain_merge(bins, limit, cost, wide):
    """Costs of all pairs anew after each join."""
    bins = [dict(b) for b in bins]
    while len(bins) > 1:
        costs = [math.inf if bins[k]["w"] or bins[k + 1]["w"] else cost(bins, k) for k in range(len(bins) - 1)]
        k = costs.index(min(costs))
        if costs[k] > limit:
            break
        a, b = bins[k], bins.pop(k + 1)
        bins[k] = {"g": a["g"] + b["g"], "b": a["b"] + b["b"], "w": False}
    return [(b["g"], b["b"]) for b in bins]


@pytest.mark.parametrize("monotone", [False, True])
def test_merging_equals_costs_anew(monotone):
    rng = random.Random(3)
    for _ in range(25):
        counts = [(rng.randint(0, 60), rng.randint(0, 25)) for _ in range(14)]
        barriers = {rng.randrange(14)}
        bins = of(*counts, barriers=barriers)
        bins.strategy = B.Woe("y", monotone)

        def chi(rows, k):
            two = [B.Bin(0, 1, stats={"cnt": r["g"] + r["b"], "good": r["g"], "bad": r["b"]}) for r in rows]
            return bins.strategy.cost(two, k)

        want = plain_merge([{"g": g, "b": b, "w": k in barriers} for k, (g, b) in enumerate(counts)], 0.9, chi, monotone)
        assert [(b.good, b.bad) for b in B.merge_alike(bins, 0.9)] == want


def test_woe_bins_with_single_ticks_and_points(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.uniform(size=3000) < 0.3, 0.0, rng.normal(size=3000))
    y = (rng.uniform(size=3000) < 1 / (1 + np.exp(-2 * x + (x == 0) * 3))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)] + [(None, 1), (float("nan"), 0)], "x double, y int").repartition(4)
    bins = B.woe_bins(df, "x", "y", 20, 60, stable=[0.0])
    point = [b for b in bins if b.barrier]
    assert [b.name for b in point] == ["[0,0]"] and point[0].cnt == int((x == 0).sum()) and point[0].bad == int(y[x == 0].sum())
    assert sum(b.cnt for b in bins) == 3000 and bins.total["cnt"] == 3002
    assert B.base_rate(bins) == pytest.approx(math.log((y.sum() + 1 + 0.5) / (3002 - y.sum() - 1)))
    for b in bins:
        held = (x > b.low if b.low_open else x >= b.low) & (x < b.high if b.high_open else x <= b.high)
        assert b.cnt == held.sum() and b.bad == y[held].sum()
    coded = B.apply_woe(df, "x", bins, "w").filter("x = 0").select("w").distinct().collect()
    assert [r["w"] for r in coded] == pytest.approx([B.woe(point[0], B.base_rate(bins))])


def test_partials_equal_a_plain_median(spark):
    rng = np.random.default_rng(8)
    x, y = rng.uniform(size=2000), rng.integers(0, 40, 2000)
    df = spark.createDataFrame([(float(a), int(b) if b else None) for a, b in zip(x, y)], "x double, y int").repartition(70)
    bins = B.binned(df, "x", B.Medians("y"), 5)
    for b, row in zip(bins, bins.rows(), strict=True):
        held = ((x > b.low) if b.low_open else (x >= b.low)) & (x <= b.high) & (y > 0)
        assert row["cnt"] == held.sum() and row["median"] == np.median(y[held])


def test_tables_of_any_measure(spark):
    df = spark.createDataFrame([(float(k), k * 2) for k in range(10)], "x double, y int")
    assert B.binned(df, "x", B.Means("y"), 2).rows()[0] == {"bin": 0, "bin_name": "[0,4]", "cnt": 5, "sum_y": 20, "mean_y": 4.0}
    assert {r["bin_name"]: r["top"] for r in B.custom_table(df, "x", {"top": F.max("y")}, 2).collect()} == {"[0,4]": 8, "(4,9]": 18}
    assert [r["cnt"] for r in B.masked_table(df, "x", "y", F.col("x") > 3, 2).orderBy("bin").collect()] == [3, 3]
    coded = B.apply_attribute(df, "x", B.intervals([0, 4, 9]), [1.5, 2.5], "v").select("v").distinct().collect()
    assert sorted(r["v"] for r in coded) == [1.5, 2.5]
    none = df.filter("x > 99")
    assert B.bin_table(none, "x", ["y"]).count() == 0 and B.woe_bins(none.withColumn("z", F.lit(1)), "x", "z") == []
