import numpy as np
import pytest
from pyspark.sql import functions as F

from ticktide.operators import binning, model


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = (rng.uniform(size=3000) < 1 / (1 + np.exp(1 - 1.5 * x[:, 0] - 0.8 * x[:, 1]))).astype(int)
    rows = [(i, *map(float, r), f"{r[0]:.3f}" if i % 50 else "", "odd" if i % 2 else "even", int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, text string, word string, y int").repartition(4).cache()


def test_angles_equal_numpy(people):
    xs = ["a", "b", "c", "d"]
    coef = model.logistic(people, ["b"], "y", 0.1)
    got = model.angles(people, xs, "y", ["b"], coef)
    rows = np.array(people.select(*xs, "y").collect(), dtype=float)
    p = 1 / (1 + np.exp(-rows[:, 1] * coef[0] - coef[1]))
    g, h = rows[:, :4].T @ (rows[:, 4] - p), (rows[:, :4].T * (p * (1 - p))) @ rows[:, :4]
    best = np.linalg.pinv(h) @ g
    want = h @ best / np.sqrt(best @ h @ best * np.diag(h))
    assert np.allclose([got[x] for x in xs], want)


def test_scaled_steps_end_at_a_zero_gradient(people):
    valid = [people.filter("id % 3 = 0"), people.filter("id % 3 = 1")]
    steps = model.stepwise_scaled(people, ["a", "b", "c", "d"], "y", 0.6, valid, c=0.1)
    assert [s["added"] for s in steps] == ["a", "b"] and all(s["angle"] >= 0.6 for s in steps)
    last = steps[-1]
    grad, _ = model.moments(people, last["columns"], "y", last["coefficients"])
    assert np.abs(grad - np.append(last["coefficients"][:-1] / 0.1, 0)).max() < 1e-6
    assert model.stepwise_scaled(people, ["a", "b"], "y", 99.0) == []


def test_logistic_ends_at_a_zero_gradient(people):
    coef = model.logistic(people, ["a", "b"], "y")
    grad, _ = model.moments(people, ["a", "b"], "y", coef)
    assert np.abs(grad).max() < 1e-3


def plain_auc(y, s):
    good, bad = s[y == 0], s[y == 1]
    return ((bad[:, None] > good).sum() + 0.5 * (bad[:, None] == good).sum()) / (len(good) * len(bad))


def plain_ks(y, s):
    cuts = np.unique(s)
    return max(0.0, max((s[y == 0] <= c).mean() - (s[y == 1] <= c).mean() for c in cuts))


@pytest.mark.parametrize("angle", [None, 0.5])
def test_scorecard_on_two_levels(people, angle):
    samples = {"low": F.col("id") < 900, "even": F.col("word") == "even"}
    card = model.scorecard(people, ["a", "b", "c", "text", "word"], "y", "id", 12, 40, 3, angle, samples)
    assert "word" not in card["bins"] and {"text", "b"} <= set(card["bins"]) and card["columns"]
    for name, part in card["coded"].items():
        rows = np.array(part.select("y", card["score"].alias("s")).collect(), dtype=float)
        assert card["report"][name]["auc"] == pytest.approx(plain_auc(rows[:, 0], rows[:, 1]))
        assert card["report"][name]["ks"] == pytest.approx(plain_ks(rows[:, 0], rows[:, 1]))
    grad, _ = model.moments(card["coded"]["train"], card["columns"], "y", card["coefficients"])
    ridge = card["coefficients"] / (1e6 if angle is None else 0.1)
    assert np.abs(grad - np.append(ridge[:-1], 0)).max() < 1e-2
    rows = card["counts"].collect()
    assert {r["sample"] for r in rows} == {"all", "low", "even"}
    people_ = people.collect()
    for r in rows:
        b = card["bins"][r["column"]][r["bin"]]
        if r["column"] == "b":
            own = [p for p in people_ if (p["b"] > b.low if b.low_open else p["b"] >= b.low) and (p["b"] < b.high if b.high_open else p["b"] <= b.high)]
            own = [p for p in own if r["sample"] == "all" or (p["id"] < 900 if r["sample"] == "low" else p["word"] == "even")]
            assert (r["cnt"], r["bad"]) == (len(own), sum(p["y"] for p in own)) and r["bin_name"] == b.name
    assert sum(r["share"] for r in rows if r["column"] == "b" and r["sample"] == "low") == pytest.approx(1)


def test_counts_of_nothing(people):
    assert model.sample_counts(people, {}, "y", {}).count() == 0
    bins = {"a": binning.binned(people, "a", binning.Woe("y"), 3)}
    whole = model.sample_counts(people.withColumn("a", F.when(F.col("id") > 9, F.col("a"))), bins, "y", {}).filter("bin is null").collect()
    assert [(r["sample"], r["cnt"]) for r in whole] == [("all", 3000)]
