"""Small functions that no query covers, against values by hand or plain Python."""


import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktide.functions import pvmap as pv
from ticktide.functions import vectors
from ticktide.operators import backtest, book, corr, indicators, microstructure as ms, model, relational as rel, scan
from ticktide.sources import readers, sinks


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- sources and sinks


def test_sql_csv_and_hive_readers(spark, tmp_path):
    spark.createDataFrame([(1, 2.5)], "`a b` int, `c-d` double").createOrReplaceTempView("odd_names")
    assert readers.read_sql(spark, "SELECT * FROM odd_names").columns == ["a_b", "c_d"] == readers.read_hive(spark, "SELECT * FROM odd_names").columns
    (tmp_path / "x.csv").write_text("n,s\n1,one\n2,\n")
    assert rows(readers.read_csv(spark, str(tmp_path / "x.csv"), T._parse_datatype_string("n int, s string"))) == [(1, "one"), (2, None)]
    assert "odd_names" in readers.tables(spark) and readers.has_function(spark, "abs") and not readers.has_function(spark, "no_such_thing")
    assert readers.is_empty(spark.range(0)) and not readers.is_empty(spark.range(1))


def test_jdbc_both_ways(spark):
    url = "jdbc:derby:memory:ticktide;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    sinks.write_jdbc(spark.createDataFrame([(1, 2.5), (2, 3.5)], "n int, x double"), url, "prices", "overwrite", **driver)
    sinks.write_jdbc(spark.createDataFrame([(3, 4.5)], "n int, x double"), url, "prices", **driver)
    assert sorted(rows(readers.read_jdbc(spark, url, 'SELECT "n", "x" FROM prices WHERE "x" > 3', **driver))) == [(2, 3.5), (3, 4.5)]


def test_instruments_multiplier_and_servers(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"symbol": "rb", "exchange": "A", "multiplier": 10}, {"symbol": "cu", "exchange": "B", "multiplier": 5}]')
    listed = readers.instruments(spark, str(tmp_path / "list.json"))
    ticks = spark.createDataFrame([("rb",), ("zz",)], "Symbol string")
    assert sorted(rows(readers.with_multiplier(ticks, listed).select("Symbol", "vMult"))) == [("rb", 10.0), ("zz", 1.0)]
    stamps = spark.createDataFrame([(1, '{"a": "t1", "b": "t2"}'), (2, '{"b": "t3"}'), (3, '{"a": "t4"}'), (4, '{"b": "t5"}'), (5, None)], "i int, j string")
    assert sorted(rows(readers.busiest_server(stamps, "j").select("i", "server_time"))) == [(1, "t2"), (2, "t3"), (4, "t5")]


def test_raw_snapshots(spark, tmp_path):
    full = {f.name: (7 if isinstance(f.dataType, T.LongType) else 32400.0 if isinstance(f.dataType, T.DoubleType) else "x") for f in readers.SNAPSHOT_COUNTS.fields}
    spark.createDataFrame([full], readers.SNAPSHOT_COUNTS).write.parquet(f"{tmp_path}/full")
    spark.createDataFrame([{c: full[c] for c in readers.SNAPSHOT.names}], readers.SNAPSHOT).write.parquet(f"{tmp_path}/plain")
    assert readers.raw_snapshots(spark, f"{tmp_path}/full").columns == readers.SNAPSHOT.names
    assert readers.raw_snapshots(spark, f"{tmp_path}/full", counts=True).first()["AskCount5"] == 7
    assert readers.raw_snapshots(spark, f"{tmp_path}/plain", counts=True).first()["BidCount1"] is None
    assert readers.snapshots(readers.raw_snapshots(spark, f"{tmp_path}/full"), "x", "x").first()["Session"] == "day1"


def test_tables_and_sheets(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2, "y")], "n int, s string")
    sinks.drop(spark, "small_table")
    sinks.insert_or_create(a, "small_table")
    sinks.insert_or_create(b, "small_table")
    assert sorted(rows(spark.table("small_table"))) == [(1, "x"), (2, "y")]
    assert sinks.rebuild(spark, "small_table", b) and rows(spark.table("small_table")) == [(2, "y")]
    assert not sinks.rebuild(spark, "small_table", b.limit(0)) and not sinks.rebuild(spark, "small_table", None) and spark.table("small_table").count() == 1
    sinks.drop(spark, "small_table")
    assert "small_table" not in readers.tables(spark)
    sinks.write_sheets({"one": a, "two": b}, str(tmp_path / "sheets"))
    assert (tmp_path / "sheets" / "two.csv").read_text().split() == ["n,s", "2,y"]
    with pytest.raises(ValueError, match="more than 1"):
        sinks.write_sheets({"one": a.union(b)}, str(tmp_path / "sheets"), most=1)


def test_maps_as_text_and_back(spark):
    df = spark.createDataFrame([(1, {4229: 5, 4228: -10}), (2, {}), (3, None)], "i int, m map<long,long>")
    sinks.drop(spark, "map_table")
    sinks.insert_or_create(df, "map_table", maps_as_text=True)
    text = spark.table("map_table")
    assert text.columns == ["i", "MX_m"] and sorted(rows(text.select("i", "MX_m"))) == [(1, "{4228: -10, 4229: 5}"), (2, "{}"), (3, None)]
    plain, had = readers.strip_prefix(text)
    assert sorted(rows(readers.parse_maps(plain, had)), key=str) == sorted(rows(df), key=str)
    sinks.drop(spark, "map_table")


# --- relations


def test_joins_by_name(spark):
    factors = spark.createDataFrame([(1, 0.5), (2, 0.6)], "t int, f double")
    returns = spark.createDataFrame([(1, 9.0, 8.0, "z"), (3, 1.0, 1.0, "z")], "t int, ORM5 double, WAP double, note string")
    assert rel.join_returns(factors, returns, ["t"]).columns == ["t", "f", "ORM5", "WAP"] and rows(rel.join_returns(factors, returns, ["t"])) == [(1, 0.5, 9.0, 8.0)]
    all_ = rel.merge_all({"a": factors, "b": factors.filter("t = 2"), "c": factors}, ["t"])
    assert all_.columns == ["t", "a_f", "b_f", "c_f"] and rows(all_) == [(2, 0.6, 0.6, 0.6)]
    assert rel.columns_like(returns, "^O|W") == ["ORM5", "WAP"] and rel.columns_like(returns, "^O|W", exclude=True) == ["t", "note"]
    assert rel.with_prefix(factors, "p_", ["t"]).columns == ["t", "p_f"]
    with pytest.raises(ValueError):
        rel.merge_all({}, ["t"])


def test_added_columns_give_way(spark):
    df = spark.createDataFrame([(1, 2, "a"), (3, 4, None)], "x int, y int, s string")
    out = rel.append_last(df, {"x": F.col("y") * 10, "z": F.lit(0)})
    assert out.columns == ["y", "s", "x", "z"] and rows(out) == [(2, "a", 20, 0), (4, None, 40, 0)]
    out = rel.append_rows(df, lambda r: {"y": r["x"] + r["y"], "t": r["s"] and r["s"] * 2}, "y long, t string")
    assert out.columns == ["x", "s", "y", "t"] and rows(out) == [(1, "a", 3, "aa"), (3, None, 7, None)]
    assert rel.append_rows(df.limit(0), lambda r: {}, "t string").count() == 0
    assert rows(rel.append_rows(df, lambda r: None, "t string").select("t")) == [(None,), (None,)]


def test_erasing_near_edges(spark):
    df = spark.createDataFrame([(1, 9, 5.0, 6.0), (30, 2, 5.0, 6.0), (31, 31, 5.0, 6.0)], "b int, e int, x double, y double")
    assert rows(rel.erase_edges(df, "b", "e", {"x": 60}, {"y": 10}).select("x", "y")) == [(None, 6.0), (None, None), (5.0, 6.0)]
    assert [rows(spark.createDataFrame([(s,) for s in ("day0", "day1", "day2", "day3", "?")], "s string").select(rel.part_of_day(F.col("s"), k))) for k in range(3)] == [
        [("",)] * 5, [("night",), ("morning",), ("morning",), ("afternoon",), ("?",)], [("night",), ("day",), ("day",), ("day",), ("?",)]]


# --- scans and statistics


def test_lags_and_first_in_wave(spark):
    df = spark.createDataFrame([("a", i, v, w) for i, (v, w) in enumerate([(5, 0), (6, 0), (7, 1), (8, 1)])], "k string, t int, v int, wave int")
    assert rows(scan.lags(df, ["k"], ["t"], ["v"], 2).orderBy("t").select("v_lag1", "v_lag2")) == [(None, None), (5, None), (6, 5), (7, 6)]
    assert rows(df.select("t", scan.first_in_wave(F.col("v"), ["k"], ["t"]).alias("f")).orderBy("t")) == [(0, 5), (1, 5), (2, 7), (3, 7)]


def test_pair_means_and_periods(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None), (5.0, 4.0), (None, 9.0)], "x double, y double")
    assert rows(corr.pair_means(df, ["x"], ["y"])) == [("x", "y", 3.0, 3.0)]
    rng = np.random.default_rng(0)
    frames = {p: spark.createDataFrame([(float(a), float(a * p + b)) for a, b in rng.normal(size=(50, 2))], "x double, y double") for p in (1, 5)}
    got = {r["period"]: r["corr"] for r in corr.by_period(frames, ["x"], ["y"]).collect()}
    assert {p: pytest.approx(np.corrcoef(*np.array(rows(f)).T)[0, 1]) for p, f in frames.items()} == got
    with_days = {p: f.withColumn("d", F.lit(p)) for p, f in frames.items()}
    for r in corr.by_period(with_days, ["x"], ["y"], "d").collect():
        assert r["mean"] == pytest.approx(r["corr"]) and (r["days"], r["std"]) == (1, 0.0)
    with pytest.raises(ValueError):
        corr.by_period({}, ["x"], ["y"])


def test_vectors_and_first_rows(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], [])], "a array<double>, b array<float>")
    a, b = F.col("a"), F.col("b")
    assert rows(df.select(vectors.dot(a, b), vectors.norm(a), vectors.cosine(a, b))) == [(24.0, 5.0, 0.96), (0.0, 0.0, None), (None, 1.0, None), (None, None, None), (0.0, 0.0, None)]
    marks = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 9), ("b", 1, 1)], "k string, t int, v int")
    assert sorted(rows(backtest.top_k(marks, ["k"], [F.desc("v"), F.col("t")], 2))) == [("a", 2, 9), ("a", 3, 9), ("b", 1, 1)]


def test_lift_and_score_bands(spark):
    df = spark.createDataFrame([(float(k), int(k >= 6), k // 5) for k in range(10)], "s double, y int, b int")
    assert sorted(rows(model.lift(df, "b", "y"))) == [(0, 5, 0, 0.5, 0.0, 0.0), (1, 5, 4, 0.5, 1.0, 2.0)]
    bands = {r["bin"]: (r["cnt"], r["mean_y"], r["lift"]) for r in model.score_bands(df, "s", "y", 2).collect()}
    assert bands == {0: (5, 0.0, 0.0), 1: (5, 0.8, 2.0)}


def test_samples_with_odd_names(spark):
    df = spark.createDataFrame([(k % 3, "a`b" if k % 2 else "c.d") for k in range(60)], "bin int, s string")
    assert len(rows(model.psi(df, "bin", "s", "c.d"))) == 1


def test_linear_and_tree_models(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.01 * rng.normal(size=400)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "i long, a double, b double, c double, y double").withColumn("t", F.timestamp_seconds("i"))
    fitted = model.lasso(df, ["a", "b", "c"], "y", 0.05)
    assert abs(fitted.coefficients[2]) < 1e-6 and fitted.coefficients[0] > 1.5 and fitted.coefficients[1] < -0.5
    trees, valid, test = model.boosted_trees(df, ["a", "b", "c"], "y", ["t"], rounds=5, depth=3)
    assert valid.count() == 80 and test.count() == 80
    miss = test.agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    assert miss < 0.5 * float(np.var(y))
    sinks.save_model(trees, df.select("y").limit(3), test.select("y", "prediction"), str(tmp_path / "model"))
    from pyspark.ml.regression import GBTRegressionModel

    assert GBTRegressionModel.load(f"{tmp_path}/model/model").numFeatures == 3 and spark.read.parquet(f"{tmp_path}/model/report").count() == 3
    assert spark.read.option("header", True).csv(f"{tmp_path}/model/sample").count() == 80


def test_column_clusters():
    corr_ = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    first, second = model.cluster_columns(corr_.copy(), ["a", "b", "c"])
    assert first == ("a", "b", pytest.approx(0.19)) and second == ("(a,b)", "c", pytest.approx((0.99 + 0.96) / 2))
    assert model.cluster_columns(corr_.copy(), ["a", "b", "c"], "min")[1][2] == pytest.approx(0.96)


# --- the book


LEVELS = {f"{s}P{i}": 100 + i if s == "A" else 101 - i for s in "AB" for i in range(1, 6)} | {f"{s}V{i}": 10 * i for s in "AB" for i in range(1, 6)}


def test_market_sides(spark):
    df = spark.createDataFrame([("s", 0, 10, 1004, 101, 100), ("s", 1, 5, 600, 101, 100), ("s", 2, 4, 300, 101, 101)], "k string, t int, vol long, amt long, AP1_last long, BP1_last long")
    out = rows(book.with_market_sides(df, ["k"], ["t"]).orderBy("t").select("market_buy", "market_sell", "market_buy_sum", "market_sell_sum"))
    assert out == [(4.0, 6.0, 4.0, 6.0), (5.0, 0.0, 9.0, 6.0), (None, None, 9.0, 6.0)]


def test_quality_report(spark):
    low = {f"{s}P{i}": LEVELS[f"{s}P{i}"] for s in "AB" for i in range(1, 6)}
    data = [{"k": "s", "t": t, **low, **extra} for t, extra in ((0.0, {}), (0.5, {"AP1": 100}), (2.0, {"AP1": 100, "BP3": 97}), (2.5, {"AP1": 100}))]
    df = spark.createDataFrame(data)
    assert rows(book.quality_report(df, ["k"], "t").select("n", "gap", "moved", "uneven")) == [(4, 1, 1, 3)]


def maps(spark):
    return spark.createDataFrame([(101, 100, {101: 5, 102: 3, 100: 2, 99: 1}, 7)], "AP1 long, BP1 long, D_x map<long,long>, AV1 long")


def test_volumes_by_side(spark):
    df = maps(spark)
    sides = ms.side_volumes(["x"])
    assert rows(df.select(sides["x_above"], sides["x_below"], ms.side_ratios(["x"])["x_ratio"])) == [(8, 3, 9 / 13)]
    flags = ms.can_trade("u", "v")
    assert rows(spark.createDataFrame([(8, 7, 7, 7)], "u long, v long, AV1 long, BV1 long").select(flags["can_trade_ask"], flags["can_trade_bid"])) == [(True, False)]
    assert rows(df.select(ms.centred("D_x", F.col("BP1"), 1))) == [([1, 2, 5],)]


def test_neighbours_and_price_totals(spark):
    data = [("s", i, u, v, {10: v} if v else {}) for i, (u, v) in enumerate([(False, 1), (True, 2), (False, 4), (False, 0), (True, 8), (False, 16)])]
    df = spark.createDataFrame(data, "k string, t int, u boolean, v long, m map<long,long>")
    got = rows(ms.to_neighbours(df, ["k"], ["t"], "u", ["v"]).orderBy("t").select("v_difflast", "v_diffnext"))
    assert got == [(None, -1), (0, 0), (-2, -4), (2, -8), (0, 0), (-8, None)]
    totals = rows(ms.price_totals(df, ["k"], "t", "m", "u").orderBy("t").select("t", "price", "total", "since_unstable", "until_unstable"))
    assert totals == [(0, 10, 1, 1, 2), (1, 10, 3, 0, 0), (2, 10, 7, 4, 8), (4, 10, 15, 0, 0), (5, 10, 31, 16, None)]
    assert rows(df.select("t", ms.next_map("m", ["k"], ["t"]).alias("n")).filter("t = 2").select("n")) == [({},)]


def test_swept_splits(spark):
    df = spark.createDataFrame([(10, 1004), (10, 990), (10, 1015), (0, 0)], "vol long, amt long").withColumns({"BP1": F.lit(100), "AP1": F.lit(101)})
    assert rows(df.select(ms.swept_split(F.col("vol"), F.col("amt")))) == [({100: 6, 101: 4},), ({99: 10},), ({101: 5, 102: 5},), ({},)]


def test_rolling_differences(spark):
    names = ["ask_old", "bid_old", "exch", "moment", "ask_add", "ask_cancel", "bid_add", "bid_cancel"]
    cells = {f"{n}_{k}_5": F.lit(float(10 * (i + 1) + (k == "vmean"))) for i, n in enumerate(names) for k in ("pmean", "vmean")}
    out = spark.range(1).select(*[c.alias(n) for n, c in cells.items()]).select(*[c.alias(n) for n, c in ms.rolling_differences([5]).items()]).first()
    assert (out["askbid_pdiff_5"], out["askbid_vdiff_5"], out["askbid_share_5"]) == (-10, -10, -10 / 31)
    assert (out["moment_pdiff_5"], out["moment_share_5"]) == (10, 41 / 31)
    assert (out["ask_addcancel_pdiff_5"], out["ask_addcancel_vdiff_5"], out["ask_addcancel_share_5"]) == (-10, -10, -10 / 112)


def test_moments_and_measures(spark):
    df = spark.createDataFrame([({5: 2}, {5: 1, 6: 4})], "D_bid_new map<long,long>, D_ask_old map<long,long>")
    moment = ms.with_moment(df)
    assert rows(moment.select("D_moment")) == [({5: 1, 6: -4},)]
    found = ms.map_measures(["bid_new"])
    assert rows(df.select(*[found[f"bid_new_{k}"] for k in ("max", "min", "volume", "amt", "avgp")])) == [(5, 5, 2, 10, 5.0)]
    assert rows(df.select(pv.negate_keys(F.col("D_bid_new")), pv.negate(F.col("D_bid_new")), pv.average_price(F.col("D_ask_old")))) == [({-5: 2}, {5: -2}, 29 / 5)]


# --- indicators


def test_open_and_means_by_period(spark):
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate([1.0, None, 3.0, 5.0])], "k string, t int, close double")
    assert rows(indicators.with_open(df, ["k"], ["t"]).orderBy("t").select("open")) == [(None,), (1.0,), (1.0,), (3.0,)]
    full = df.filter("close is not null")
    assert rows(indicators.sma_sweep(full, ["k"], ["t"], (2,)).orderBy("t").select("SMA_2")) == [(None,), (-1.0,), (-1.0,)]
    assert indicators.macd_grid((3, 5, 10)) == [(3, 10, 2), (5, 10, 3)]
