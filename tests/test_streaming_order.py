import pytest
from pyspark.sql import functions as F

from ticktide.operators import scan
from ticktide.streaming.ordered import PROVIDER, streaming_grid, streaming_wave

KIND = "k string, tick long, v double, c boolean"


@pytest.fixture(scope="module")
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, folder, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(folder)


def drain(spark, build, folder, out, check):
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.timestamp_seconds("tick"))
    query = build(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(out)


def test_grid_equals_the_batch_one_with_late_rows_and_a_restart(store, tmp_path):
    spark, (folder, out, check) = store, (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    first = [("a", 10, 1.0, True), ("a", 13, None, False), ("b", 11, 5.0, False), ("a", 12, 2.0, False)]
    second = [("a", 11, 9.0, False), ("b", 15, None, True), ("a", 18, 3.0, True), ("b", 14, 6.0, False)]
    third = [("a", 2, 99.0, False), ("a", 20, 4.0, False), ("b", 21, 7.0, False), ("z", 60, 0.0, False)]  # tick 2 is late
    build = lambda s: streaming_grid(s, "k", "ts", "tick", ["v"], late="8 seconds")
    put(spark, folder, first)
    drain(spark, build, folder, out, check)
    put(spark, folder, second)
    drain(spark, build, folder, out, check)
    put(spark, folder, third)
    put(spark, folder, [("z", 90, 1.0, False)])
    got = drain(spark, build, folder, out, check).filter("k <> 'z'")
    kept = [r for r in first + second + third if r[1] != 2 and r[0] != "z"]
    want = scan.grid_fill(spark.createDataFrame(kept, KIND), ["k"], "tick", ["v"])
    key = lambda r: (r["k"], r["tick"])
    assert [tuple(r) for r in sorted(got.select("k", "tick", "v", "filled").collect(), key=key)] == [tuple(r) for r in sorted(want.select("k", "tick", "v", "filled").collect(), key=key)]


def test_idle_series_start_anew(store, tmp_path):
    spark, (folder, out, check) = store, (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    build = lambda s: streaming_grid(s, "k", "ts", "tick", ["v"], late="0 seconds", idle_ms=20_000)
    for rows in ([("a", 1, 1.0, True)], [("z", 100, 0.0, True)], [("z", 101, 0.0, True)], [("a", 110, 2.0, True)], [("z", 200, 0.0, True)], [("z", 201, 0.0, True)]):
        put(spark, folder, rows)
        got = drain(spark, build, folder, out, check)
    assert sorted(tuple(r) for r in got.filter("k = 'a'").select("tick", "v", "filled").collect()) == [(1, 1.0, False), (110, 2.0, False)]


def test_waves_equal_the_batch_ones(store, tmp_path):
    spark, (folder, out, check) = store, (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    rows = [("ab"[i % 2], i, float(i), i % 5 == 0) for i in range(1, 41)]
    for k in (3, 0, 1, 2):
        put(spark, folder, rows[k::4])
    put(spark, folder, [("z", 500, 0.0, False)])
    put(spark, folder, [("z", 501, 0.0, False)])
    got = drain(spark, lambda s: streaming_wave(s, "k", "ts", ["tick"], "c", late="60 seconds"), folder, out, check).filter("k <> 'z'")
    want = scan.wave_id(spark.createDataFrame(rows, KIND), ["k"], ["tick"], "c")
    assert sorted((r["k"], r["tick"], r["wave"]) for r in got.collect()) == sorted((r["k"], r["tick"], r["wave"]) for r in want.collect())
