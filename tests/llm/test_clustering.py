import hashlib

import numpy as np
import pytest

from ticktide.llm.clustering import Search, cluster, integers, summarised


def full(v, c):
    d = ((v[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("spread", [3, 200, 1 << 27])
def test_search_is_a_full_search(spread):
    rng = np.random.default_rng(spread)
    v, c = rng.integers(-spread, spread, (700, 16)), rng.integers(-spread, spread, (50, 16))
    c[7] = c[31]  # equal centroids: the smaller number
    v[:20] = c[7]
    who, best = Search(c).nearest(v)
    low, least = full(v, c)
    assert (who == low).all() and (best == least).all() and (who[:20] == 7).all()


def test_search_passes_over_far_centroids():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (64, 1)) * np.ones((1, 16), dtype=np.int64) + rng.integers(-9, 9, (64, 16))
    search = Search(centres)
    v = centres[rng.integers(0, 64, 500)] + rng.integers(-2, 2, (500, 16))
    search.nearest(v)
    assert search.computed < 500 * 8


def brute(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = np.array([v for _, v in order[:k]])
    x = np.array([v for _, v in kept])
    for _ in range(rounds):
        who, _ = full(x, c)
        for j in set(who):
            c[j] = [int(s) // int((who == j).sum()) for s in x[who == j].sum(axis=0)]
    who, best = full(x, c)
    digest = [hashlib.sha256(",".join(map(str, r.tolist())).encode()).hexdigest() for r in c]
    return sorted((i if i is not None else -1, int(w), int(b), int(best[who == w].sum()), int(best.sum()), digest[w]) for (i, _), w, b in zip(kept, who, best))


def test_rounds_equal_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(90)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 240)] + [(7, [1.0, 2.0, 3.0, 4.0]), (None, [0.1, 0.2, 0.3, 0.4]), (None, None)]
    rows += [(300, []), (301, [1.0]), (302, [1.0, None, 1.0, 1.0]), (303, [1.0, float("nan"), 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, `clus.ter` int, Distance int").repartition(5)
    got = sorted(tuple(-1 if x is None else x for x in r) for r in summarised(cluster(df, 6, 3, 4)).collect())
    assert got == brute(rows, 6, 3, 4)
    assert summarised(cluster(df.filter("vec_id < 3"), 6, 2, 4)).select("cluster").distinct().count() == 3


def test_empty_and_huge(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    out = summarised(cluster(none, 4, 2, 3))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    big = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0]), (3, [-0.001, 0.001])], "vec_id long, embedding array<double>")
    assert {r["id"]: r["v"] for r in integers(big, 2).collect()} == {1: [1 << 27, -(1 << 27)], 2: [0, 0], 3: [-1, 0]}
    assert summarised(cluster(big, 2, 2, 2)).count() == 3
