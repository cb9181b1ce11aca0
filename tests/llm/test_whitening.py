from collections import Counter

import numpy as np
import pytest

from ticktide.llm.whitening import Spectrum, _deviations, integers, rank_one, secular_roots, spectrum, Centre, sums, whitened


def test_secular_roots():
    rng = np.random.default_rng(0)
    for m in (1, 2, 7, 64):
        d, z = np.sort(rng.normal(size=m)) * 100, rng.normal(size=m)
        base, mu = secular_roots(d, z * z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.abs(d[base] + mu - want).max() < 1e-11 * np.abs(want).max()


@pytest.mark.parametrize("case", ["plain", "ties", "nothing", "close", "graded"])
def test_rank_one(case):
    rng, m = np.random.default_rng(5), 24
    values = np.sort(rng.uniform(0, 9, m))
    q, _ = np.linalg.qr(rng.normal(size=(m, m)))
    u = rng.normal(size=m)
    if case == "ties":
        values[3:11] = values[3]
    if case == "nothing":
        u = q[:, 4] * 2.0
    if case == "close":
        values[5:9] = values[5] + np.arange(4) * 1e-13
    if case == "graded":
        values = np.logspace(-14, 6, m)
    got, vectors = rank_one(values, q, u)
    want = (q * values) @ q.T + np.outer(u, u)
    top = np.abs(want).max()
    assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-12
    assert np.abs((vectors * got) @ vectors.T - want).max() < 1e-12 * top
    assert (np.diff(got) >= 0).all()


def scatter(x):
    y = x - x.mean(axis=0)
    return y.T @ y


def test_spectra_add_and_merge():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 9)) * np.arange(1, 10)
    x[40:60] = x[40]  # copies
    parts = [x[:3], x[3:80], x[80:81], x[81:]]
    whole = Spectrum.empty(9)
    for p in parts:
        s = Spectrum.empty(9)
        for row in p:
            s = s.add(row)
        whole = whole.merge(s)
    want = scatter(x)
    assert whole.n == 150 and np.abs(whole.mean - x.mean(axis=0)).max() < 1e-12
    assert np.abs((whole.vectors * whole.values) @ whole.vectors.T - want).max() < 1e-11 * want.max()


def brute(rows, k):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    most = Counter(len(v) for _, v in kept)
    dims = max(most, key=lambda d: (most[d], d))
    kept = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in kept if len(v) == dims]
    n, s = len(kept), [sum(c) for c in zip(*(v for _, v in kept))]
    y = np.array([[float(c * n - t) / n for c, t in zip(v, s)] for _, v in kept])
    e, q = np.linalg.eigh(y.T @ y / n)
    return kept, n, s, y, e[::-1][:k], q[:, ::-1][:, :k]


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_equals_brute_force_with_odd_rows(spark, parts):
    rng = np.random.default_rng(11)
    mixed = rng.normal(size=(300, 8)) @ rng.normal(size=(8, 8))
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(mixed)] + [(900 + i, [0.25] * 8) for i in range(90)]
    rows += [(7, [3.0] * 8), (None, [1.0] * 8), (400, None), (401, []), (402, [1.0] * 5), (403, [float("nan")] * 8), (404, [None] + [1.0] * 7), (405, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, X int").repartition(parts)
    kept, n, s, y, e, q = brute(rows, 5)
    out = whitened(df, 5).collect()
    assert len(out) == 5 * n and {r["n"] for r in out} == {n}
    assert max(r["identity_error"] for r in out) < 1e-10
    sign, by = {}, {}
    for r in out:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
        assert abs(r["explained"] / (e[r["component"] - 1] / np.trace(y.T @ y / n)) - 1) < 1e-10
    for (i, v), own in zip(kept, y):
        if i in (None, 7):
            continue
        assert by[i][1]["deviation"] == sum((n * c - t) ** 2 for c, t in zip(v, s))
        for j in range(5):
            want, got = own @ q[:, j] / np.sqrt(e[j]), by[i][j + 1]["whitened"]
            sign.setdefault(j, np.sign(want * got))
            assert abs(want - sign[j] * got) < 1e-9


def test_updates_alone_come_near(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(rng.normal(size=(200, 6)))], "vec_id long, embedding array<double>").repartition(20)
    vectors, dims = integers(df)
    n, totals = sums(vectors, dims)
    found = spectrum(vectors, dims, Centre(n, totals))
    x = np.array([r["x"] for r in vectors.collect()], dtype=float)
    assert found.n == 200 and np.abs(found.values - np.linalg.eigvalsh(scatter(x))).max() < 1e-6


def test_few_none_and_flat(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, None)], [(1, []), (2, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitened(spark.createDataFrame(rows, kind))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(6)], kind)
    assert {(r["component"], round(r["explained"], 9)) for r in whitened(flat).collect()} == {(1, 1.0)}


def test_deviations_stay_exact():
    x = np.array([[1 << 40, -5], [3, 1 << 39]])
    totals = [int(c) for c in x.sum(axis=0)]
    assert list(_deviations(x, 2, totals)) == [(1 << 63) - 1] * 2
    x = np.array([[10, 20], [13, 25], [11, 0]])
    totals = [34, 45]
    assert list(_deviations(x, 3, totals)) == [sum((3 * int(c) - t) ** 2 for c, t in zip(r, totals)) for r in x]
