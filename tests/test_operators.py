"""Operators against hand fixtures and plain Python."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticktide.functions import pvmap as pv
from ticktide.functions import sql
from ticktide.operators import backtest, binning, book, corr, indicators, mapsums, microstructure, model, relational, scan
from ticktide.sources import readers, sinks
from ticktide.streaming.bars import streaming_bars
from ticktide.streaming.state import streaming_ema, streaming_jump

COND = [0, 1, 0, 1, 0, 0, 1]


def series(spark, values, cond=None):
    cond = cond or [0] * len(values)
    return spark.createDataFrame([("s", i, float(v), bool(c)) for i, (v, c) in enumerate(zip(values, cond, strict=True))], "k string, t long, v double, c boolean")


def column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


def test_segments(spark):
    df = scan.segment_scans(series(spark, [5, 3, 4, 1, 7, -2, 6], COND), ["k"], ["t"], "c", "v")
    assert column(df, "seg_sum") == [5, 3, 7, 1, 8, 6, 6]
    assert column(df, "seg_max") == [5, 3, 4, 1, 7, 7, 6]
    assert column(df, "seg_min") == [0, 3, 3, 1, 1, -2, 6]
    df = scan.split_index(series(spark, COND, COND), ["k"], ["t"], "c")
    assert [column(df, n) for n in ("to_front", "to_end", "front_idx", "end_idx")] == [[0, 0, 1, 0, 1, 2, 0], [0, 1, 0, 2, 1, 0, 0], [0, 1, 1, 3, 3, 3, 6], [0, 2, 2, 5, 5, 5, 6]]


def test_jump_and_ema(spark):
    cond = [1, 1, 0, 1, 0, 0, 1]
    taken = column(scan.jump(series(spark, cond, cond), ["k"], ["t"], "c", 3), "taken")
    assert [i for i, x in enumerate(taken) if x] == [0, 3, 6]
    assert column(scan.ema(series(spark, [4, 8, 0]), ["k"], ["t"], "v", 4.0), "ema") == [4, 5, 3.75]


def test_running_totals_and_ranks_over_ranges(spark):
    rng = random.Random(3)
    values = [rng.randrange(300) for _ in range(2000)]
    df = spark.createDataFrame([(i, v if i % 7 else None) for i, v in enumerate(values)], "i long, v long")
    got = {r.i: r.r for r in scan.global_rank(df, "v", "r").collect()}
    want = pd.Series([v if i % 7 else None for i, v in enumerate(values)], dtype=float).rank()
    assert all(math.isnan(want[i]) if got[i] is None else got[i] == want[i] for i in got)
    sums = scan.running_totals(spark.createDataFrame([(v, v % 5) for v in range(500)], "v long, n long"), "v", ["n"], 7)
    for r in sums.collect():
        assert r.n_before == sum(x % 5 for x in range(r.v)) and r.n_whole == 1000
    empty = scan.running_totals(spark.createDataFrame([], "v long, n long"), "v", ["n"])
    assert empty.count() == 0


def maps(spark, *rows):
    return spark.createDataFrame(rows, "a map<bigint,bigint>, b map<bigint,bigint>")


def test_map_algebra(spark):
    a, b = F.col("a"), F.col("b")
    row = maps(spark, ({1: 5, 2: 3}, {2: 4, 3: 9})).select(
        pv.minimum(a, b).alias("min"), pv.add(a, b).alias("sum"), pv.subtract(a, b).alias("dif"), pv.populate(F.create_map(F.lit(1).cast("long"), F.lit(10).cast("long"), F.lit(4).cast("long"), F.lit(20).cast("long"))).alias("pop"),
        pv.cumulate(b, True).alias("down"), pv.total(a).alias("total"), pv.turnover(a).alias("turnover"), microstructure.merged_ladders(a, b).alias("ladder"),
        pv.from_levels([F.lit(3), F.lit(0), F.lit(3), F.lit(None).cast("long")], [F.lit(7), F.lit(9), F.lit(1), F.lit(2)]).alias("levels"),
    ).first()
    assert row["min"] == {2: 3, 3: 0} and row["sum"] == {1: 5, 2: 7, 3: 9} and row["dif"] == {1: 5, 2: -1, 3: -9} and row["pop"] == {1: 10, 2: 0, 3: 0, 4: 20}
    assert row["down"] == {3: 9, 2: 13} and row["total"] == 8 and row["turnover"] == 11 and row["ladder"] == {1: 5, 2: -1} and row["levels"] == {3: 8}
    nothing = maps(spark, (None, {1: 2}), ({}, None)).select(pv.add(a, b).alias("s"), pv.total(a).alias("t"), pv.populate(a).alias("p"), pv.cumulate(a).alias("c")).collect()
    assert nothing[0].s == {1: 2} and nothing[1].s == {} and nothing[0].t == nothing[1].t == 0 and nothing[1].p == nothing[1].c == {}


def test_maps_in_sql(spark):
    sql.register(spark)
    assert sql.register(spark) == []
    row = spark.sql("SELECT pv_total(pv_add(map(1L, 2L), map(1L, 3L, 5L, 1L))) AS t, pv_clip(map(1L, 2L, 5L, 1L), 2L, 9L) AS c, pv_at(map(1L, 2L), 9L) AS z, dot_product(array(1D, 2D), array(3D, 4D)) AS d").first()
    assert row.t == 6 and row.c == {5: 1} and row.z == 0 and row.d == 11


def test_trailing_map_sum(spark):
    df = spark.createDataFrame([("s", i, {p: 1 if i < 2 else i + 1}) for i, p in enumerate([10, 11, 10])], "k string, t long, m map<bigint,bigint>")
    got = {(r.t, r.price): r.volume for r in mapsums.trailing(df, ["k"], "t", "m", 2).collect()}
    assert got == {(0, 10): 1, (1, 10): 1, (1, 11): 1, (2, 10): 3, (2, 11): 1}


ASK, BID = {4228: 100, 4229: 1000, 4230: 800, 4231: 700, 4232: 600}, {4227: 1000, 4226: 500, 4225: 400, 4224: 300, 4223: 200}


@pytest.mark.parametrize("ask,bid,vol,amt,bounds,want", [
    (ASK, BID | {4227: 500}, 500, 500 * 4227, (4230, 4226), {4227: 500}),
    (ASK | {4228: 60}, BID | {4227: 950}, 90, 40 * 4228 + 50 * 4227, (4229, 4227), {4227: 50, 4228: 40}),
    ({4229: 700, 4230: 800, 4231: 700, 4232: 600, 4233: 500}, BID | {4227: 980}, 420, 20 * 4227 + 100 * 4228 + 300 * 4229, (4229, 4227), {4227: 20, 4228: 100, 4229: 300}),
    (ASK, BID, 0, 0, (4229, 4227), {}),
])
def test_trade_search(spark, ask, bid, vol, amt, bounds, want):
    books = spark.createDataFrame([(ask, bid, ASK, BID, vol, amt, *bounds)], "D_ask map<long,long>, D_bid map<long,long>, D_ask_last map<long,long>, D_bid_last map<long,long>, vol long, amt long, ask_bound long, bid_bound long")
    diffs = books.withColumns({f"D_{s}_diff": pv.subtract(F.col(f"D_{s}_last"), F.col(f"D_{s}")) for s in ("ask", "bid")})
    assert book.with_trades(book.with_sums(diffs)).first()["D_exch"] == want


def plain_search(vol, amt, ask, bid, ask_last, bid_last, ask_bound, bid_bound):
    """All pairs of borders, one after the other."""
    if not vol:
        return {}
    below = lambda m, p: sum(n for q, n in m.items() if q <= p) if p in m else 0
    above = lambda m, p: sum(n for q, n in m.items() if q >= p) if p in m else 0
    left = lambda p: max(ask_last.get(p, 0) - ask.get(p, 0), 0) + max(bid_last.get(p, 0) - bid.get(p, 0), 0)
    found = []
    for low in range(min(amt // vol, bid_bound), amt // vol + 1):
        for high in range(max(low, -(-amt // vol)), max(-(-amt // vol), ask_bound) + 1):
            got = {p: ask_last.get(p, 0) + bid_last.get(p, 0) for p in range(low + 1, high)}
            v, a = vol - sum(got.values()), amt - sum(p * n for p, n in got.items())
            if low == high:
                if amt != vol * low:
                    continue
                v1 = v2 = vol
                got, standing = {low: vol}, 0
            else:
                if v <= 0 or not low * v < a < high * v:
                    continue
                v1 = (high * v - a) // (high - low)
                v2 = v - v1
                got |= {low: v1, high: v2}
                standing = max(ask_last.get(low, 0) - v1, 0) + max(bid_last.get(high, 0) - v2, 0)
            prize = min(v1, left(low)) + (min(v2, left(high)) if high > low else 0) + sum(left(p) for p in range(low + 1, high))
            fine = below(ask_last, low - 1) + above(bid_last, high + 1) + below(ask, high - 1) + above(bid, low + 1)
            found.append((-(prize - fine - standing), high - low, low, {p: n for p, n in got.items() if n}))
    return min(found, key=lambda x: x[:3])[3] if found else {}


def test_trade_search_equals_all_pairs(spark):
    from ticktide.plans import registry

    full = book.with_trades(book.with_bounds(book.with_sums(book.with_maps(registry.books(spark, "/root/testdata/sf0.001")))))
    rows = full.select("vol", "amt", "D_ask", "D_bid", "D_ask_last", "D_bid_last", "ask_bound", "bid_bound", "D_exch").collect()
    assert len({len(r["D_exch"]) for r in rows}) > 3
    assert all(dict(r["D_exch"]) == plain_search(*r[:8]) for r in rows)


def test_trade_search_does_each_step_once(spark):
    """The maps of orders are merged four times in all, and the rows are dealt evenly before the search."""
    from ticktide.plans import registry

    plan = registry.trade_reconstruction(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_zip_with(") == 4
    assert "RepartitionByExpression [event_id#" in plan and registry.relational.spread(spark.range(9), "id").rdd.getNumPartitions() == 16 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("vol,amt,bounds", [(7, 7 * 4800 + 3, (4230, 4226)), (7, 7 * 3700 + 3, (4230, 4226)), (2000, 2000 * 4229 + 900, (4235, 4221)), (2000, 2000 * 4228, (4235, 4221))])
def test_trade_search_far_from_the_book(spark, vol, amt, bounds):
    """Means far off, negative volumes (a wider pair may fit again) and gaps: the same as all pairs."""
    ask, bid, ask_last, bid_last = {4229: 5, 4232: 40}, {4227: 30, 4225: 1}, ASK | {4230: -900}, BID | {4225: -300}
    books = spark.createDataFrame([(ask, bid, ask_last, bid_last, vol, amt, *bounds)], "D_ask map<long,long>, D_bid map<long,long>, D_ask_last map<long,long>, D_bid_last map<long,long>, vol long, amt long, ask_bound long, bid_bound long")
    sums = {f"D_{s}{t}_cumsum": pv.cumulate(F.col(f"D_{s}{t}"), s == "bid") for s in ("ask", "bid") for t in ("", "_last")}
    row = book.with_trades(books.withColumns(sums)).first()
    assert row["D_exch"] == plain_search(vol, amt, ask, bid, ask_last, bid_last, *bounds)


def test_orders_of_odd_books(spark):
    """Old and new orders as differences of maps, with negative volumes and prices of one side alone."""
    rows = [({1: 5, 2: 3, 9: 4}, {1: 2, 2: -1, 3: 7}, {2: 6, 3: 1}), ({}, {1: 2}, {}), ({4: 2}, None, {4: -3, 5: 1}), ({2: 1, 3: 8}, {3: 8}, {3: 9})]
    df = spark.createDataFrame([(i, x, now, last, now, last, 2, 9, 9, 1, 1, 1) for i, (x, last, now) in enumerate(rows)], """i long, D_exch map<long,long>, D_ask map<long,long>, D_ask_last map<long,long>, D_bid map<long,long>, D_bid_last map<long,long>,
        AP1_last long, AP5_last long, AP5 long, BP1_last long, BP5_last long, BP5 long""")
    for r in book.with_orders(df).collect():
        x, last, now = rows[r.i]
        last, above = last or {}, {p: v for p, v in x.items() if p >= 2}
        old = {p: min(v, last.get(p, 0)) for p, v in x.items() if min(v, last.get(p, 0)) > 0}
        change = {p: x.get(p, 0) + now.get(p, 0) - last.get(p, 0) for p in {*x, *now, *last} if p <= 9}
        assert (r.D_ask_old, r.D_bid_old, r.D_ask_exch) == (old, old, above)
        assert r.D_ask_new == {p: v - old.get(p, 0) for p, v in above.items() if v > old.get(p, 0)}
        assert r.D_ask_add == {p: v for p, v in change.items() if v > 0} and r.D_ask_cancel == {p: -v for p, v in change.items() if v < 0}


def test_levels_rising_falling_and_with_gaps(spark):
    rows = [(5, 6, 7), (7, 6, 5), (5, 7, 8), (5, 5, 6), (None, 6, 7), (0, 1, 2), (-1, 0, 1), (None, None, None), (9, 8, 6)]
    df = spark.createDataFrame([(*r, 10, None, 30) for r in rows], "a long, b long, c long, x long, y long, z long")
    prices, volumes = [F.col(c) for c in "abc"], [F.col(c) for c in "xyz"]
    for r in df.select(pv.populated_levels(prices, volumes).alias("got"), pv.populate(pv.from_levels(prices, volumes)).alias("want")).collect():
        assert r.got == r.want


def test_trades_conserve_volume(spark):
    from ticktide.plans import registry

    rows = registry.trade_reconstruction(spark, "/root/testdata/sf0.001").collect()
    full = [r for r in rows if r.d_exch]
    assert full and all(r.d_exch == r.vol for r in full) and sum(abs(r.turnover - r.amt) <= 8 for r in full) > 0.9 * len(full)


def test_binning(spark):
    x = [1, 1, 1, *range(2, 11)]
    y = [0, 1, 0, 0, 1, 0, 1, 1, 0, 1, 1, 1]
    df = spark.createDataFrame(list(zip(map(float, x), y, strict=True)), "x double, y int")
    assert binning.nearest_ticks(df, "x", 4) == [1, 2, 5, 7, 10]
    got = {r.bin_name: (r.cnt, round(r.mean_y, 6)) for r in binning.bin_table(df, "x", ["y"], 4).collect()}
    assert got == {"[1,2]": (4, 0.25), "(2,5]": (3, 0.666667), "(5,7]": (2, 0.5), "(7,10]": (3, 1.0)}
    low = spark.createDataFrame([(float(v),) for v in [-999] * 5 + list(range(7))], "x double")
    rows = binning.bin_table(low, "x", ["x"], 4).collect()
    assert {r.bin_name: r.cnt for r in rows} == {"[-999,-999]": 5, "(-999,1]": 2, "(1,3]": 2, "(3,6]": 3}
    points = binning.with_points([1, 5, 10], [5])
    assert [(b.name, b.barrier) for b in points] == [("[1,5)", False), ("[5,5]", True), ("(5,10]", False)]
    assert [r.k for r in df.select(binning.bin_index(F.col("x"), points).alias("k")).collect()][3:8] == [0, 0, 0, 1, 2]
    bins = binning.open_ends(binning.fit(low.withColumn("y", F.lit(1)), "x", binning.intervals([-999, 1, 6]), binning.Woe("y")))
    back = binning.from_json(binning.to_json(bins))
    assert list(back) == list(bins) and binning.base_rate(back) == binning.base_rate(bins)
    total = binning.sum_table(df, "x", "y", 4).agg(F.sum("sum")).first()[0]
    assert total == sum(y)


def test_ks_auc_tsi(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.3, 1), (0.4, 1), (None, 1)], "s double, y int")
    assert model.ks(df, "s", "y").first()[0] == 1.0 and model.auc(df, "s", "y").first()[0] == 1.0
    rng = random.Random(1)
    rows = [(rng.gauss(0, 1), rng.random() < 0.3, "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame([(a, int(b), c) for a, b, c in rows], "s double, y int, part string")
    order = sorted((a, int(b)) for a, b, _ in rows)
    bad, good = sum(y for _, y in order), sum(1 - y for _, y in order)
    wins = sum(sum(1 - q for _, q in order[:i]) for i, (_, y) in enumerate(order) if y)
    assert model.auc(df, "s", "y").first()[0] == pytest.approx(wins / bad / good)
    assert model.tsi(df, "s", "y", "part", binning.intervals([-9.0, 0.0, 9.0])).first()[0] > 0


def test_logistic_and_stepwise_find_the_signal(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 3))
    y = rng.random(1500) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.5)))
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, c double, y int")
    coef = model.logistic(df, ["a", "b", "c"], "y")
    p = 1 / (1 + np.exp(-(np.c_[x, np.ones(1500)] @ coef)))
    assert np.abs(np.c_[x, np.ones(1500)].T @ (y - p)).max() < 1e-3
    used, _ = model.stepwise(df, ["a", "b", "c"], "y", 3, 4.0)
    assert used == ["a"]
    angles = model.cross_validated_angles(df, [], ["a", "b"], "y", "i")
    assert angles["a"] > 4 > abs(angles["b"])
    parts = model.split(df, "i")
    assert sum(p.count() for p in parts) == 1500


def test_pearson_and_spearman_match_pandas(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"d": np.arange(300) % 5, "TX1": rng.integers(0, 40, 300).astype(float), "RT1": rng.normal(size=300)})
    frame.loc[::11, "TX1"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "d long, TX1 double, RT1 double")
    assert corr.matrix(df, ["TX1"], ["RT1"]).first()["corr"] == pytest.approx(frame["TX1"].corr(frame["RT1"]))
    ranks = pd.DataFrame({"x": frame["TX1"].rank(), "y": frame["RT1"].rank()})
    assert corr.spearman(df, ["TX1"], ["RT1"]).first()["corr"] == pytest.approx(ranks["x"].corr(ranks["y"]))
    assert corr.matrix(df.withColumn("k", F.lit(1.0)), ["k"], ["RT1"]).first()["corr"] is None
    report = corr.factor_report(df, "d").first()
    assert report["days"] == 5 and report["null_rate"] == pytest.approx(frame["TX1"].isna().mean())


def test_backtest(spark):
    df = series(spark, [1, -2, 3, -1])
    row = backtest.stats(df, ["k"], ["t"], "v").first()
    assert row.max_drawdown == 2 and row.calmar == 0.5 and row.n_plays == 4
    spaced = backtest.spaced_backtest(df.withColumn("g", F.lit(1)), ["k"], ["t"], "g", "v", 2).first()
    assert spaced.n_plays == 2 and spaced.r_sum == 4 and spaced.exch_ratio == 0.5


def bars_of(spark, n=120, seed=3):
    rng = np.random.default_rng(seed)
    c = 1000 + np.cumsum(rng.normal(0, 5, n))
    o = np.concatenate([[1000], c[:-1]])
    h, low = np.maximum(o, c) + rng.random(n), np.minimum(o, c) - rng.random(n)
    rows = [("s", i, *map(float, r)) for i, r in enumerate(zip(o, h, low, c, rng.integers(1, 99, n), strict=True))]
    return spark.createDataFrame(rows, "k string, t long, open double, high double, low double, close double, volume double")


def test_indicators(spark):
    df = bars_of(spark)
    frame = df.toPandas()
    rec = indicators.with_recursive(df, ["k"], ["t"]).orderBy("t").toPandas()
    fin = indicators.with_finite(df, ["k"], ["t"]).orderBy("t").toPandas()
    c = frame["close"]
    want = c.rolling(30).mean()
    assert np.allclose(fin["SMA"].astype(float), want, equal_nan=True)
    step = c.diff()
    up, down = step.clip(lower=0), (-step).clip(lower=0)
    a, b = up[1:15].mean(), down[1:15].mean()
    assert rec["RSI"][14] == pytest.approx(100 * a / (a + b)) and math.isnan(float(rec["RSI"].astype(float)[13]))
    assert rec["EMA"][29] == pytest.approx(c[:30].mean())
    assert rec[["HT_DCPERIOD", "MAMA_mama"]].iloc[32:].notna().all().all() and rec["HT_DCPERIOD"].dropna().between(5, 50).all()
    hi, lo = frame["high"].rolling(5).max(), frame["low"].rolling(5).min()
    fast = 100 * (c - lo) / (hi - lo)
    assert np.allclose(fin["STOCH_slowd"].astype(float), fast.rolling(3).mean().rolling(3).mean(), equal_nan=True)
    patterns = indicators.with_patterns(df, ["k"], ["t"])
    names = [n for n in patterns.columns if n.startswith("CDL")]
    assert len(names) == 61 and set(patterns.select(F.explode(F.array(*names)).alias("m")).distinct().toPandas()["m"]) <= {-100, 0, 100}
    sweep = indicators.with_sweep(df, ["k"], ["t"], (5, 14)).orderBy("t").toPandas()
    assert np.allclose(sweep["ADX_14"].astype(float), rec["ADX"].astype(float), equal_nan=True)


def test_hand_made_patterns(spark):
    flat = [(100, 102, 98, 101)] * 11
    rows = [*flat, (101, 103.1, 99, 103), (103, 103.2, 98, 99.4)]
    df = spark.createDataFrame([("s", i, *map(float, r), 1.0) for i, r in enumerate(rows)], "k string, t long, open double, high double, low double, close double, volume double")
    out = indicators.with_patterns(df, ["k"], ["t"]).orderBy("t").collect()
    assert out[-1]["CDLENGULFING"] == -100 and out[3]["CDLENGULFING"] == 0


def test_relational(spark):
    df = spark.createDataFrame([("1", "a"), ("", "b"), (None, None), ("2.5", "3")], "n string, m string")
    got = relational.fill_missing(df, ["n", "m"]).collect()
    assert [r.n for r in got] == [1.0, -999999.0, -1.0, 2.5] and [r.m for r in got] == ["a", "b", "null", "3"]
    wide = relational.append(df, F.struct(F.lit(1).alias("n"), F.lit(2).alias("z")))
    assert wide.columns == ["n", "m", "z"] and wide.first().n == 1
    t = series(spark, range(10))
    parts = relational.quantile_parts(t, "v", [0.0, 0.5, 1.0])
    assert [t.filter(p).count() for p in parts] == [4, 5]
    assert [r.t for r in relational.rows_around(t, [F.col("t")], -1, 2, 0).collect()] == [7, 8, 9]
    assert relational.natural_order(["a10", "a2", "b", "a"]) == ["a", "a2", "a10", "b"]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", "rb1", 1.0, "{4228: 10, 4229: -5}", float("nan")), ("2024-01-02", "cu1", 2.0, "{}", 1.0)], "date string, Symbol string, time double, MX_m string, x double")
    plain, had = readers.strip_prefix(df)
    parsed = readers.nan_to_null(readers.parse_maps(plain, had))
    assert [r.m for r in parsed.orderBy("date").collect()] == [{4228: 10, 4229: -5}, {}] and parsed.filter("x IS NULL").count() == 1
    sinks.write_days(parsed.drop("m"), f"{tmp_path}/days")
    assert readers.read_days(spark, f"{tmp_path}/days", "2024-01-01", "2024-01-01", "^rb").count() == 1
    assert readers.new_days(df, df.filter("date = '2024-01-01'"), least=1).count() == 1
    sinks.write_heat_table(df.select("Symbol", "time"), f"{tmp_path}/heat.html", ["time"])
    assert "background" in (tmp_path / "heat.html").read_text()
    df.createOrReplaceTempView("seen_view")
    assert readers.catalogue(spark).filter("table = 'seen_view'").count() == 5


def test_streams(spark, tmp_path):
    rows = [("s", i, float(v), bool(c)) for i, (v, c) in enumerate(zip([4, 8, 0, 1, 2, 3, 4], [1, 1, 0, 1, 0, 0, 1], strict=True))]
    schema = "k string, t long, v double, c boolean"
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")

    def run(build, name):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
        q = build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).orderBy("t").collect()

    assert [r.ema for r in run(lambda s: streaming_ema(s, "k", ["t"], "v", 4.0), "ema")][:3] == [4, 5, 3.75]
    assert [r.t for r in run(lambda s: streaming_jump(s, "k", ["t"], "c", 3), "jumps") if r.taken] == [0, 3, 6]
    bars = run(lambda s: streaming_bars(s.withColumn("ts", F.timestamp_seconds(F.col("t") * 3600)), "ts", "k", "v").withColumn("t", F.unix_timestamp("start")), "bars")
    assert bars and bars[0].open == 4


def test_signal_without_reward_takes_no_slot(spark):
    df = spark.createDataFrame([(1, 1, None, 1), (1, 2, 5, 1), (1, 3, 1, 0), (1, 4, 7, 1)], "k int, t int, v int, g int")
    got = backtest.spaced_backtest(df, ["k"], ["t"], "g", "v", 2).first()
    assert (got.n_plays, got.r_sum, got.exch_count) == (2, 12, 2)
