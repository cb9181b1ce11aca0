"""Every query of the library on the driver's tables, with the SQL that gives the same rows.

The ticks come from `events`: the symbol is the event type, the day the date of `ts`, the price the
value in whole hundredths, the volume and the five-level book are derived from the event id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticktide.functions import pvmap as pv
from ticktide.functions import vectors
from ticktide.operators import backtest, bars, binning, book, corr, indicators, mapsums, microstructure, model, relational, scan
from ticktide.streaming.bars import streaming_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BY, DAY, ORDER = ["symbol"], ["symbol", "day"], ["ts", "event_id"]

#: The SQL twin of `ticks`.
TICKS = """
    SELECT event_id, ts, CAST(ts AS DATE) AS day, event_type AS symbol, user_id, CAST(floor(value * 100) AS BIGINT) AS px,
           event_id * 5 % 120 AS vol, event_type = 'error' AS is_error, event_id % 7 = 0 AS cond
    FROM events
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql.replace("$TICKS", f"({TICKS})").replace("$BOOK", f"({BOOK})")
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", F.col("ts").cast("date").alias("day"), F.col("event_type").alias("symbol"), "user_id",
        F.floor(F.col("value") * 100).cast("long").alias("px"), (F.col("event_id") * 5 % 120).alias("vol"),
        (F.col("event_type") == "error").alias("is_error"), (F.col("event_id") % 7 == 0).alias("cond"),
    )


#: A synthetic book; the SQL twin of `snapshots`.
BOOK = f"""
    SELECT *, 4000 + event_id * 7 % 11 AS mid, {", ".join(f"4000 + event_id * 7 % 11 + {i} AS AP{i}, 4000 + event_id * 7 % 11 - {i} + 1 - CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS BP{i}, 50 + (event_id * 13 + {i} * 17) % 200 AS AV{i}, 50 + (event_id * 19 + {i} * 23) % 200 AS BV{i}" for i in range(1, 6))}
    FROM ({TICKS}) AS t
"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    r, mid = F.col("event_id"), 4000 + F.col("event_id") * 7 % 11
    new = {"mid": mid}
    for i in range(1, 6):
        new |= {f"AP{i}": mid + i, f"BP{i}": mid - i + 1 - F.when(r % 4 == 0, 1).otherwise(0), f"AV{i}": 50 + (r * 13 + i * 17) % 200, f"BV{i}": 50 + (r * 19 + i * 23) % 200}
    return t.withColumns(new)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir).withColumn("amt", F.col("vol") * F.col("mid") + F.col("event_id") * 3 % (F.col("vol") + 1))
    prices, volumes = ([f"{s}{k}{i}" for s in "AB" for i in range(1, 6)] for k in "PV")
    return scan.lag_reset(s, DAY, ORDER, prices, volumes)


@query("bars_tumbling", """
    SELECT day, CAST(floor(epoch_us(ts) / 3e8) AS BIGINT) AS bucket, arg_min(px, (ts, event_id)) AS open, max(px) AS high, min(px) AS low,
           arg_max(px, (ts, event_id)) AS close, count(*) AS n_ticks, CAST(sum(vol) AS BIGINT) AS volume
    FROM $TICKS GROUP BY ALL
""")
def bars_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("bucket", bars.time_bucket(F.col("ts"), 300))
    return bars.bars(t, ["day", "bucket"], ORDER, "px", "vol")


@query("bars_by_tick_period", """
    SELECT symbol, day, CAST(floor((2 * (epoch_us(ts) / 1e6 - floor(epoch_us(ts) / 864e8) * 86400) - 1) / 1800) AS INT) AS bucket, arg_min(px, (ts, event_id)) AS open, max(px) AS high,
           min(px) AS low, arg_max(px, (ts, event_id)) AS close, count(*) AS n_ticks, CAST(sum(vol) AS BIGINT) AS volume
    FROM $TICKS GROUP BY ALL
""")
def bars_by_tick_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of 1,800 half-second ticks of a day."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    t = ticks(spark, sf_dir).withColumn("bucket", bars.tick_bucket(seconds - F.floor(seconds / 86400) * 86400, 1800))
    return bars.bars(t, [*DAY, "bucket"], ORDER, "px", "vol")


@query("bars_by_symbol", """
    SELECT symbol, day, CAST(floor(epoch_us(ts) / 36e8) AS BIGINT) AS bucket, arg_min(px, (ts, event_id)) AS open, max(px) AS high, min(px) AS low,
           arg_max(px, (ts, event_id)) AS close, count(*) AS n_ticks, CAST(sum(vol) AS BIGINT) AS volume, CAST(sum(px * vol) AS BIGINT) AS amount
    FROM $TICKS GROUP BY ALL
""")
def bars_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumns({"bucket": bars.time_bucket(F.col("ts"), 3600), "amt": F.col("px") * F.col("vol")})
    return bars.bars(t, [*DAY, "bucket"], ORDER, "px", "vol", "amt")


@query("forward_returns", """
    SELECT event_id, nullif(lead(px, 1) OVER d, 0) - px AS RT1, nullif(lead(px, 5) OVER d, 0) - px AS RT5, nullif(lead(px, 120) OVER d, 0) - px AS RM1,
           nullif(lead(px, 1) OVER s, 0) - px AS ORT1, nullif(lead(px, 5) OVER s, 0) - px AS ORT5, nullif(lead(px, 120) OVER s, 0) - px AS ORM1
    FROM $TICKS WINDOW d AS (PARTITION BY symbol, day ORDER BY ts, event_id), s AS (PARTITION BY symbol ORDER BY ts, event_id)
""")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bars.forward_returns(ticks(spark, sf_dir), BY, "day", ORDER, {False: "px"}, [("T1", 1), ("T5", 5), ("M1", 120)])
    return out.select("event_id", "RT1", "RT5", "RM1", "ORT1", "ORT5", "ORM1")


@query("rolling_bars", """
    SELECT event_id, max(px) OVER w AS high_n, min(px) OVER w AS low_n, CAST(sum(vol) OVER w AS BIGINT) AS vol_n, count(*) OVER w AS count_n
    FROM $TICKS WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
""")
def rolling_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.rolling_bars(ticks(spark, sf_dir), BY, ORDER, 20, "px", "vol").select("event_id", "high_n", "low_n", "vol_n", "count_n")


@query("lag_reset", """
    SELECT event_id, coalesce(lag(px) OVER w, px) AS px_last, coalesce(lag(vol) OVER w, 0) AS vol_last, px - coalesce(lag(px, 3) OVER w, 0) AS px_diff
    FROM $TICKS WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id)
""")
def lag_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan.difference(scan.lag_reset(ticks(spark, sf_dir), DAY, ORDER, ["px"], ["vol"]), DAY, ORDER, ["px"], 3)
    return out.select("event_id", "px_last", "vol_last", "px_diff")


@query("fill", """
    SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS forward,
           first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward
    FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN px END AS v FROM $TICKS)
""")
def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 5 != 0, F.col("px"))
    return ticks(spark, sf_dir).select("event_id", scan.forward_fill(v, BY, ORDER).alias("forward"), scan.backward_fill(v, BY, ORDER).alias("backward"))


@query("wave_id", """
    SELECT event_id, CAST(coalesce(sum(cond::INT) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wave
    FROM $TICKS
""")
def wave_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.wave_id(ticks(spark, sf_dir), BY, ORDER, "cond").select("event_id", "wave")


@query("segment_scans", """
    WITH s AS (SELECT *, sum(cond::INT) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS seg, px - 5000 AS v FROM $TICKS)
    SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS seg_sum, CASE WHEN seg = 0 THEN greatest(max(v) OVER w, 0) ELSE max(v) OVER w END AS seg_max,
           CASE WHEN seg = 0 THEN least(min(v) OVER w, 0) ELSE min(v) OVER w END AS seg_min
    FROM s WINDOW w AS (PARTITION BY symbol, seg ORDER BY ts, event_id)
""")
def segment_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("v", F.col("px") - 5000)
    return scan.segment_scans(t, BY, ORDER, "cond", "v").select("event_id", "seg_sum", "seg_max", "seg_min")


@query("split_index", """
    WITH s AS (SELECT *, sum(cond::INT) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS seg, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS p FROM $TICKS)
    SELECT event_id, p - min(p) OVER w AS to_front, max(p) OVER w - p AS to_end, min(p) OVER w AS front_idx, max(p) OVER w AS end_idx FROM s WINDOW w AS (PARTITION BY symbol, seg)
""")
def split_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.split_index(ticks(spark, sf_dir), BY, ORDER, "cond").select("event_id", "to_front", "to_end", "front_idx", "end_idx")


@query("stable_run", """
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS p FROM $TICKS),
    r AS (SELECT event_id, p, max(CASE WHEN cond THEN p END) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS last_unstable,
                 min(CASE WHEN cond THEN p END) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_unstable FROM s)
    SELECT event_id, last_unstable, next_unstable, p - last_unstable AS since_unstable, next_unstable - p AS until_unstable FROM r
""")
def stable_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("stable", ~F.col("cond"))
    return scan.stable_run(t, BY, ORDER, "stable").select("event_id", "last_unstable", "next_unstable", "since_unstable", "until_unstable")


@query("jump", """
    WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts, event_id) AS p FROM $TICKS),
    c AS (SELECT * FROM s WHERE cond),
    walk AS (
        SELECT symbol, day, min(p) AS p FROM c GROUP BY symbol, day
        UNION ALL
        SELECT w.symbol, w.day, (SELECT min(c.p) FROM c WHERE c.symbol = w.symbol AND c.day = w.day AND c.p >= w.p + 10) AS p FROM walk AS w WHERE w.p IS NOT NULL
    )
    SELECT event_id, w.p IS NOT NULL AS taken FROM s LEFT JOIN walk AS w USING (symbol, day, p)
""")
def jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.jump(ticks(spark, sf_dir), DAY, ORDER, "cond", 10).select("event_id", "taken")


@query("ema", """
    WITH RECURSIVE s AS (SELECT event_id, symbol, day, px::DOUBLE AS x, row_number() OVER (PARTITION BY symbol, day ORDER BY ts, event_id) AS p FROM $TICKS),
    walk AS (
        SELECT event_id, symbol, day, p, x AS m FROM s WHERE p = 1
        UNION ALL
        SELECT s.event_id, s.symbol, s.day, s.p, w.m + (s.x - w.m) / 4.0 FROM walk AS w JOIN s ON s.symbol = w.symbol AND s.day = w.day AND s.p = w.p + 1
    )
    SELECT event_id, round(m, 4) AS ema FROM walk
""")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.ema(ticks(spark, sf_dir), DAY, ORDER, "px", 4.0).select("event_id", F.round("ema", 4).alias("ema"))


@query("phase_sample", """
    SELECT event_id, CAST((row_number() OVER w - 1) % 4 AS INT) AS phase, (row_number() OVER w - 1) // 4 AS phase_row FROM $TICKS WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)
""")
def phase_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.phases(ticks(spark, sf_dir), BY, ORDER, 4).select("event_id", "phase", "phase_row")


@query("average_rank", """
    SELECT event_id, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY symbol ORDER BY v) + (count(*) OVER (PARTITION BY symbol, v) - 1) / 2.0 END AS rnk
    FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN px % 500 END AS v FROM $TICKS)
""")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 5 != 0, F.col("px") % 500)
    t = ticks(spark, sf_dir).withColumn("v", v)
    return t.select("event_id", scan.average_rank(F.col("v"), BY).cast("double").alias("rnk"))


@query("grid_fill", """
    WITH h AS (SELECT symbol, CAST(floor(epoch_us(ts) / 36e8) AS BIGINT) AS tick, arg_max(px, (ts, event_id)) AS px FROM $TICKS GROUP BY ALL),
    g AS (SELECT symbol, unnest(range(min(tick), max(tick) + 1)) AS tick FROM h GROUP BY symbol)
    SELECT symbol, tick, last_value(px IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY tick) AS px, px IS NULL AS filled FROM g LEFT JOIN h USING (symbol, tick)
""")
def grid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("tick", bars.time_bucket(F.col("ts"), 3600))
    hourly = t.groupBy("symbol", "tick").agg(F.max_by("px", F.struct(*ORDER)).alias("px"))
    return scan.grid_fill(hourly, BY, "tick", ["px"]).select("symbol", "tick", "px", "filled")


@query("direction_runs", """
    WITH d AS (SELECT *, px - coalesce(lag(px) OVER (PARTITION BY symbol ORDER BY ts, event_id), 0) AS px_diff FROM $TICKS),
    m AS (SELECT *, sign(px_diff)::INT AS sg FROM d WHERE px_diff <> 0),
    t AS (SELECT *, coalesce(lag(sg) OVER (PARTITION BY symbol ORDER BY ts, event_id) <> sg, false) AS turned FROM m)
    SELECT event_id, sg AS sign, turned, CAST(sum(turned::INT) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS BIGINT) AS run FROM t
""")
def direction_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scan.difference(ticks(spark, sf_dir), BY, ORDER, ["px"])
    return scan.direction_runs(t, BY, ORDER, "px_diff").select("event_id", "sign", "turned", "run")


@query("drawdown", """
    SELECT event_id, px - min(px) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS drawdown FROM $TICKS
""")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select("event_id", scan.drawdown(F.col("px"), BY, ORDER).alias("drawdown"))


XY_SQL = """(SELECT *, px % 1000 AS x1, CASE WHEN event_id % 5 <> 0 THEN vol + px % 7 END AS x2, px % 333 + vol AS y1 FROM $TICKS)"""


def xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).withColumns({"x1": F.col("px") % 1000, "x2": F.when(F.col("event_id") % 5 != 0, F.col("vol") + F.col("px") % 7), "y1": F.col("px") % 333 + F.col("vol")})


@query("pearson", f"""
    SELECT 'x1' AS x, 'y1' AS y, count(*) AS n, round(corr(x1, y1), 6) AS corr FROM {XY_SQL}
    UNION ALL SELECT 'x2', 'y1', count(x2), round(corr(x2, y1), 6) FROM {XY_SQL}
""")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corr.matrix(xy(spark, sf_dir), ["x1", "x2"], ["y1"]).withColumn("corr", F.round("corr", 6))


@query("spearman", f"""
    WITH r AS (SELECT symbol,
        CASE WHEN x2 IS NOT NULL THEN rank() OVER (PARTITION BY symbol ORDER BY x2) + (count(*) OVER (PARTITION BY symbol, x2) - 1) / 2.0 END AS rx,
        rank() OVER (PARTITION BY symbol ORDER BY y1) + (count(*) OVER (PARTITION BY symbol, y1) - 1) / 2.0 AS ry FROM {XY_SQL})
    SELECT symbol, 'x2' AS x, 'y1' AS y, count(rx) AS n, round(corr(rx, ry), 6) AS corr FROM r GROUP BY symbol
""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corr.spearman(xy(spark, sf_dir), ["x2"], ["y1"], BY).withColumn("corr", F.round("corr", 6))


@query("daywise_corr", f"""
    WITH c AS (SELECT day, corr(x1, y1) AS c FROM {XY_SQL} GROUP BY day)
    SELECT 'x1' AS x, 'y1' AS y, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, count(c) AS days, round(avg(c) / stddev_pop(c), 6) AS sharpe FROM c
""")
def daywise_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corr.daywise(xy(spark, sf_dir), "day", ["x1"], ["y1"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "sharpe")})


@query("self_corr", f"""
    WITH c AS (SELECT day, coalesce(corr(x1, y1), 0) AS c FROM {XY_SQL} GROUP BY day), l AS (SELECT c, lag(c) OVER (ORDER BY day) AS b FROM c)
    SELECT 'x1' AS x, 'y1' AS y, round(sum(c * b) / (count(*) - 1) / (sum(c * c) / count(*)), 6) AS self_corr FROM l
""")
def self_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corr.self_correlation(xy(spark, sf_dir), "day", ["x1"], ["y1"]).withColumn("self_corr", F.round("self_corr", 6))


@query("null_rates", f"SELECT 'x1' AS name, 0.0::DOUBLE AS null_rate UNION ALL SELECT 'x2', avg((x2 IS NULL)::INT) FROM {XY_SQL}")
def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corr.null_rates(xy(spark, sf_dir), ["x1", "x2"])


@query("main_contract", "SELECT symbol, max(vol) AS max_volume FROM $TICKS WHERE regexp_matches(symbol, '^[a-p]') GROUP BY symbol ORDER BY 2 DESC, 1 LIMIT 1")
def main_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.main_contract(ticks(spark, sf_dir), "symbol", "vol", "^[a-p]")


@query("session_tag", """
    WITH s AS (SELECT event_id, date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + floor(date_part('second', ts)) AS x FROM $TICKS)
    SELECT event_id, CASE WHEN x BETWEEN 32400 AND 36900 THEN 'day1' WHEN x BETWEEN 37800 AND 41400 THEN 'day2' WHEN x BETWEEN 48600 AND 54000 THEN 'day3' ELSE '' END AS session FROM s
""")
def session_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return ticks(spark, sf_dir).select("event_id", relational.session_of(seconds).alias("session"))


@query("book_state", """
    WITH b AS (SELECT *, AP1 - BP1 AS s, lag(AP1 - BP1) OVER w AS s0, AP1 - lag(AP1) OVER w AS a, BP1 - lag(BP1) OVER w AS b FROM $BOOK WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id))
    SELECT event_id, CASE WHEN s = 1 AND s0 = 1 AND a = 0 AND b = 0 THEN 0 WHEN s = 1 AND s0 = 1 AND a > 0 AND b > 0 THEN 1 WHEN s = 1 AND s0 = 1 AND a < 0 AND b < 0 THEN 2
        WHEN s > 1 AND s0 = 1 AND a > 0 THEN 3 WHEN s > 1 AND s0 = 1 AND b < 0 THEN 4 WHEN s = 1 AND s0 > 1 AND a < 0 THEN 5 WHEN s = 1 AND s0 > 1 AND b > 0 THEN 6 ELSE -1 END AS state
    FROM b
""")
def book_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = scan.series(DAY, ORDER)
    spread = F.col("AP1") - F.col("BP1")
    b = snapshots(spark, sf_dir).withColumns({"s": spread, "s0": F.lag(spread).over(w), "a": F.col("AP1") - F.lag("AP1").over(w), "b": F.col("BP1") - F.lag("BP1").over(w)})
    return b.select("event_id", relational.book_states("s", "s0", "a", "b").alias("state"))


@query("prices", """
    SELECT event_id, (AP1 + BP1) / 2.0 AS mid1, round((AP1 * BV1 + BP1 * AV1) / (AV1 + BV1)::DOUBLE, 6) AS wap FROM $BOOK
""")
def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).select("event_id", book.mid_price().alias("mid1"), F.round(book.weighted_price(), 6).alias("wap"))


#: Volumes per order and price level, from lineitem.
LEVELS_SQL = """(SELECT l_orderkey AS k, l_linenumber::BIGINT AS p, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS a,
    sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END)::BIGINT AS b, bool_or(l_returnflag = 'R') AS has_a, bool_or(l_returnflag <> 'R') AS has_b FROM lineitem GROUP BY ALL)"""


def level_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("price"), F.col("l_quantity").cast("long").alias("volume"), (F.col("l_returnflag") == "R").alias("r"))
    sums = items.groupBy("k", "price", "r").agg(F.sum("volume").alias("volume"))
    rows = sums.groupBy("k").agg(F.collect_list(F.struct("price", "volume", "r")).alias("l"))
    one = lambda r: F.map_from_entries(F.transform(F.filter("l", lambda x: x["r"] == r), lambda x: F.struct(x["price"], x["volume"])))
    return rows.select("k", one(F.lit(True)).alias("a"), one(F.lit(False)).alias("b"))


@query("pvmap_algebra", f"""
    WITH m AS (SELECT *, CASE WHEN has_b THEN least(a, b) END AS mn FROM {LEVELS_SQL})
    SELECT k, sum(a + b)::BIGINT AS sum_total, sum(p * (a - b))::BIGINT AS diff_turnover, sum(CASE WHEN p BETWEEN 2 AND 4 THEN a ELSE 0 END)::BIGINT AS clip_total,
           coalesce(sum(mn), 0)::BIGINT AS min_total, min(CASE WHEN a > 0 THEN p END) AS lowest_a, max(CASE WHEN b > 0 THEN p END) AS highest_b,
           (CASE WHEN max(CASE WHEN has_a THEN 1 ELSE 0 END) = 1 THEN max(CASE WHEN has_a THEN p END) - min(CASE WHEN has_a THEN p END) + 1 ELSE 0 END)::BIGINT AS populated
    FROM m GROUP BY k
""")
def pvmap_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return level_maps(spark, sf_dir).select(
        "k", pv.total(pv.add(a, b)).alias("sum_total"), pv.turnover(pv.subtract(a, b)).alias("diff_turnover"), pv.total(pv.clip(a, F.lit(2), F.lit(4))).alias("clip_total"),
        pv.total(pv.minimum(a, b)).alias("min_total"), pv.lowest(a).alias("lowest_a"), pv.highest(b).alias("highest_b"), F.size(pv.populate(a)).cast("long").alias("populated"),
    )


@query("pvmap_cumsum", f"""
    WITH c AS (SELECT k, p, sum(b) OVER (PARTITION BY k ORDER BY p) AS up, sum(b * p) OVER (PARTITION BY k ORDER BY p DESC) AS down FROM {LEVELS_SQL} WHERE has_b)
    SELECT k, p AS price, up::BIGINT AS up, down::BIGINT AS down FROM c
""")
def pvmap_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = level_maps(spark, sf_dir).withColumns({"u": pv.cumulate(F.col("b")), "d": pv.cumulate(F.col("b"), True, amount=True)})
    return m.select("k", F.explode("u").alias("price", "up"), "d").select("k", "price", "up", pv.get(F.col("d"), F.col("price")).alias("down"))


@query("rolling_map_sum", """
    WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, px // 2000 AS price, vol + 1 AS volume FROM $TICKS)
    SELECT a.user_id, a.place, b.price, sum(b.volume)::BIGINT AS volume FROM s AS a JOIN s AS b ON a.user_id = b.user_id AND b.place BETWEEN a.place - 9 AND a.place GROUP BY ALL
""")
def rolling_map_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)).cast("long")
    t = ticks(spark, sf_dir).select("user_id", place.alias("place"), F.create_map(F.floor(F.col("px") / 2000).cast("long"), F.col("vol") + 1).alias("m"))
    return mapsums.trailing(t, ["user_id"], "place", "m", 10)


@query("book_maps", """
    WITH l AS (SELECT event_id, vol, unnest([AP1, AP2, AP3, AP4, AP5]) AS ap, unnest([AV1, AV2, AV3, AV4, AV5]) AS av, unnest([BP1, BP2, BP3, BP4, BP5]) AS bp, unnest([BV1, BV2, BV3, BV4, BV5]) AS bv FROM $BOOK)
    SELECT event_id, sum(av)::BIGINT AS ask_total, sum(ap * av)::BIGINT AS ask_turnover, sum(bv)::BIGINT AS bid_total, min(ap) AS ask_low, max(bp) AS bid_high FROM l GROUP BY event_id
""")
def book_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = book.with_maps(books(spark, sf_dir))
    return b.select(
        "event_id", pv.total(F.col("D_ask")).alias("ask_total"), pv.turnover(F.col("D_ask")).alias("ask_turnover"), pv.total(F.col("D_bid")).alias("bid_total"),
        pv.lowest(F.col("D_ask")).alias("ask_low"), pv.highest(F.col("D_bid")).alias("bid_high"),
    )


@query("book_bounds", """
    WITH g AS (SELECT *, coalesce(lag(AP1) OVER w, AP1) AS a1, coalesce(lag(AP5) OVER w, AP5) AS a5, coalesce(lag(BP1) OVER w, BP1) AS b1, coalesce(lag(BP5) OVER w, BP5) AS b5,
        coalesce(lag(AV1) OVER w, 0) AS v1, coalesce(lag(AV2) OVER w, 0) AS v2, coalesce(lag(AV3) OVER w, 0) AS v3, coalesce(lag(AV4) OVER w, 0) AS v4, coalesce(lag(AV5) OVER w, 0) AS v5,
        coalesce(lag(BV1) OVER w, 0) AS u1, coalesce(lag(BV2) OVER w, 0) AS u2, coalesce(lag(BV3) OVER w, 0) AS u3, coalesce(lag(BV4) OVER w, 0) AS u4, coalesce(lag(BV5) OVER w, 0) AS u5
        FROM $BOOK WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id)),
    s AS (SELECT *, least(greatest(a1, AP1), least(a5, AP5)) AS sa, greatest(least(b1, BP1), greatest(b5, BP5)) AS sb, [v1, v1 + v2, v1 + v2 + v3, v1 + v2 + v3 + v4, v1 + v2 + v3 + v4 + v5] AS ca,
        [u1, u1 + u2, u1 + u2 + u3, u1 + u2 + u3 + u4, u1 + u2 + u3 + u4 + u5] AS cb FROM g),
    e AS (SELECT *, least(sa + 4, least(a5, AP5) + 1) AS ea, greatest(sb - 4, greatest(b5, BP5) - 1) AS eb FROM s)
    SELECT event_id, sa + len(list_filter(range(sa, ea), lambda q: coalesce(CASE WHEN q BETWEEN a1 AND a1 + 4 THEN ca[q - a1 + 1] END, 0) <= 2 * vol + 150)) AS ask_bound,
           sb - len(list_filter(range(eb + 1, sb + 1), lambda q: coalesce(CASE WHEN q BETWEEN b1 - 4 AND b1 THEN cb[b1 - q + 1] END, 0) <= 2 * vol + 150)) AS bid_bound FROM e
""")
def book_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.with_bounds(book.with_sums(book.with_maps(books(spark, sf_dir)))).select("event_id", "ask_bound", "bid_bound")


#: Every pair of borders is scored; the sums between them are differences of running sums.
TRADES_SQL = """
    WITH g AS (
        SELECT event_id, vol, vol * mid + event_id * 3 % (vol + 1) AS amt, AP1 AS an, BP1 AS bn, coalesce(lag(AP1) OVER w, AP1) AS ap, coalesce(lag(BP1) OVER w, BP1) AS bp,
               [AV1, AV2, AV3, AV4, AV5] AS av, [BV1, BV2, BV3, BV4, BV5] AS bv,
               coalesce(lag([AV1, AV2, AV3, AV4, AV5]) OVER w, [0, 0, 0, 0, 0]) AS au, coalesce(lag([BV1, BV2, BV3, BV4, BV5]) OVER w, [0, 0, 0, 0, 0]) AS bu
        FROM $BOOK WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id)
    ),
    s AS (SELECT *, least(greatest(ap, an), least(ap, an) + 4) AS sa, greatest(least(bp, bn), greatest(bp, bn) - 4) AS sb FROM g),
    e AS (
        SELECT *, sa + len(list_filter(range(sa, least(sa + 4, least(ap, an) + 5)), lambda q: CASE WHEN q BETWEEN ap AND ap + 4 THEN list_sum(au[1:q - ap + 1]) ELSE 0 END <= 2 * vol + 150)) AS ask_bound,
               sb - len(list_filter(range(greatest(sb - 4, greatest(bp, bn) - 5) + 1, sb + 1), lambda q: CASE WHEN q BETWEEN bp - 4 AND bp THEN list_sum(bu[1:bp - q + 1]) ELSE 0 END <= 2 * vol + 150)) AS bid_bound
        FROM s
    ),
    f AS (SELECT *, amt // vol AS mean, (amt + vol - 1) // vol AS up FROM e WHERE vol > 0),
    p AS (SELECT *, unnest(range(least(mean, bid_bound), greatest(up, ask_bound) + 1)) AS p FROM f),
    c AS (
        SELECT event_id, vol, amt, mean, up, p, CASE WHEN p BETWEEN ap AND ap + 4 THEN au[p - ap + 1] ELSE 0 END AS asks, CASE WHEN p BETWEEN bp - 4 AND bp THEN bu[bp - p + 1] ELSE 0 END AS bids,
               CASE WHEN p BETWEEN an AND an + 4 THEN av[p - an + 1] ELSE 0 END AS asks_now, CASE WHEN p BETWEEN bn - 4 AND bn THEN bv[bn - p + 1] ELSE 0 END AS bids_now,
               CASE WHEN p - 1 BETWEEN ap AND ap + 4 THEN list_sum(au[1:p - ap]) ELSE 0 END + CASE WHEN p + 1 BETWEEN bn - 4 AND bn THEN list_sum(bv[1:bn - p]) ELSE 0 END AS below,
               CASE WHEN p + 1 BETWEEN bp - 4 AND bp THEN list_sum(bu[1:bp - p]) ELSE 0 END + CASE WHEN p - 1 BETWEEN an AND an + 4 THEN list_sum(av[1:p - an]) ELSE 0 END AS above
        FROM p
    ),
    d AS (SELECT *, asks + bids AS rest, greatest(asks - asks_now, 0) + greatest(bids - bids_now, 0) AS gone FROM c),
    r AS (SELECT *, sum(rest) OVER u AS rs, sum(rest * p) OVER u AS qs, sum(gone) OVER u AS gs FROM d WINDOW u AS (PARTITION BY event_id ORDER BY p)),
    pairs AS (
        SELECT x.event_id, x.p AS lo, y.p AS hi, x.vol, x.amt, CASE WHEN x.p = y.p THEN x.vol ELSE x.vol - (y.rs - y.rest - x.rs) END AS v, x.amt - (y.qs - y.rest * y.p - x.qs) AS a, x.gone AS g1, y.gone AS g2,
               y.gs - y.gone - x.gs AS g, x.asks AS a1, y.bids AS b2, x.below + y.above AS fine
        FROM r AS x JOIN r AS y ON x.event_id = y.event_id AND y.p >= x.p WHERE x.p <= x.mean AND y.p >= y.up
    ),
    cand AS (SELECT *, CASE WHEN lo = hi THEN vol ELSE (hi * v - a) // (hi - lo) END AS v1 FROM pairs WHERE CASE WHEN lo = hi THEN amt = vol * lo ELSE v > 0 AND lo * v < a AND a < hi * v END),
    scored AS (
        SELECT *, v - v1 AS v2, least(v1, g1) + CASE WHEN lo = hi THEN 0 ELSE least(v - v1, g2) + g - greatest(a1 - v1, 0) - greatest(b2 - (v - v1), 0) END - fine AS score FROM cand
    ),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, hi - lo, lo) = 1),
    w AS (
        SELECT e.*, b.lo, b.hi, b.v1, b.v2, unnest(range(least(bn - 4, bp - 4, coalesce(b.lo, bn)), greatest(an + 4, ap + 4, coalesce(b.hi, an)) + 1)) AS p FROM e LEFT JOIN best AS b USING (event_id)
    ),
    n AS (
        SELECT event_id, vol, amt, ap, bp, an, bn, p, CASE WHEN p BETWEEN ap AND ap + 4 THEN au[p - ap + 1] ELSE 0 END AS asks, CASE WHEN p BETWEEN bp - 4 AND bp THEN bu[bp - p + 1] ELSE 0 END AS bids,
               CASE WHEN p BETWEEN an AND an + 4 THEN av[p - an + 1] ELSE 0 END AS asks_now, CASE WHEN p BETWEEN bn - 4 AND bn THEN bv[bn - p + 1] ELSE 0 END AS bids_now,
               CASE WHEN p = lo THEN v1 WHEN p = hi THEN v2 WHEN p > lo AND p < hi THEN CASE WHEN p BETWEEN ap AND ap + 4 THEN au[p - ap + 1] ELSE 0 END + CASE WHEN p BETWEEN bp - 4 AND bp THEN bu[bp - p + 1] ELSE 0 END ELSE 0 END AS x
        FROM w
    )
    SELECT event_id, vol, sum(x)::BIGINT AS d_exch, sum(CASE WHEN p <= least(ap, an) + 4 THEN greatest(x + asks_now - asks, 0) ELSE 0 END)::BIGINT AS d_ask_add,
           sum(CASE WHEN p <= least(ap, an) + 4 THEN greatest(asks - x - asks_now, 0) ELSE 0 END)::BIGINT AS d_ask_cancel, sum(CASE WHEN p >= ap THEN x ELSE 0 END)::BIGINT AS d_ask_exch,
           sum(least(x, asks))::BIGINT AS d_ask_old, sum(greatest(CASE WHEN p >= ap THEN x ELSE 0 END - least(x, asks), 0))::BIGINT AS d_ask_new,
           sum(CASE WHEN p >= greatest(bp, bn) - 4 THEN greatest(x + bids_now - bids, 0) ELSE 0 END)::BIGINT AS d_bid_add, sum(CASE WHEN p >= greatest(bp, bn) - 4 THEN greatest(bids - x - bids_now, 0) ELSE 0 END)::BIGINT AS d_bid_cancel,
           sum(CASE WHEN p <= bp THEN x ELSE 0 END)::BIGINT AS d_bid_exch, sum(CASE WHEN p BETWEEN bp + 1 AND ap - 1 THEN x ELSE 0 END)::BIGINT AS d_mid_exch, sum(x * p)::BIGINT AS turnover, amt
    FROM n GROUP BY event_id, vol, amt
"""


@query("trade_reconstruction", TRADES_SQL)
def trade_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traded volume per price, and what it says of orders."""
    rows = relational.spread(books(spark, sf_dir), "event_id")
    full = book.with_orders(book.with_trades(book.with_bounds(book.with_sums(book.with_maps(rows)))))
    names = ["D_exch", "D_ask_add", "D_ask_cancel", "D_ask_exch", "D_ask_old", "D_ask_new", "D_bid_add", "D_bid_cancel", "D_bid_exch", "D_mid_exch"]
    return full.select("event_id", "vol", *[pv.total(F.col(n)).alias(n.lower()) for n in names], pv.turnover(F.col("D_exch")).alias("turnover"), "amt")


@query("dedupe_latest", """
    SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) = 1
""")
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return relational.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_totalprice"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("eav_pivot", """
    SELECT user_id, arg_min(px, (ts, event_id)) FILTER (symbol = 'click') AS click, arg_min(px, (ts, event_id)) FILTER (symbol = 'error') AS error,
           arg_min(px, (ts, event_id)) FILTER (symbol = 'view') AS view FROM $TICKS WHERE symbol IN ('click', 'error', 'view') GROUP BY user_id
""")
def eav_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.pivot_first(ticks(spark, sf_dir), ["user_id"], "symbol", "px", ORDER, ["click", "error", "view"])


@query("compound_join", """
    SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey AND o_orderstatus <> '' AND (o_totalprice > 100000 OR c_custkey IN (1, 2, 3)) WHERE o_orderdate >= DATE '1995-01-01'
""")
def compound_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("date"))
    c = table(spark, sf_dir, "customer")
    on = (o["o_custkey"] == c["c_custkey"]) & (o["o_orderstatus"] != "") & ((o["o_totalprice"] > 100000) | c["c_custkey"].isin(1, 2, 3))
    return o.join(c, on).select("o_orderkey", "c_name", "o_totalprice")


@query("three_way_join", """
    SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
""")
def three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"))


def _sides(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    a = t.filter("symbol = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    b = t.filter("symbol = 'error' AND vol > 60").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return relational.merge(a, b, ["user_id"], how)


for _how in ("left", "right", "full"):
    query(f"{_how}_join", f"""
        WITH a AS (SELECT user_id, count(*) AS n FROM $TICKS WHERE symbol = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM $TICKS WHERE symbol = 'error' AND vol > 60 GROUP BY 1)
        SELECT user_id, a.n AS n_x, b.n AS n_y FROM a {_how.upper()} JOIN b USING (user_id)
    """)(lambda spark, sf_dir, how=_how: _sides(spark, sf_dir, how))


@query("missing_days", """
    SELECT DISTINCT day FROM $TICKS AS t WHERE NOT EXISTS (SELECT 1 FROM events AS e WHERE CAST(e.ts AS DATE) = t.day AND day(e.ts) % 3 = 0)
""")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = ticks(spark, sf_dir).select("day").distinct()
    return relational.missing_in(days, days.filter(F.dayofmonth("day") % 3 == 0), ["day"])


@query("value_counts", "SELECT symbol, vol % 10 AS digit, count(*) AS n, avg(px) AS mean FROM $TICKS GROUP BY ALL")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("symbol", (F.col("vol") % 10).alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.avg("px").alias("mean"))


@query("bins_equal_frequency", """
    WITH v AS (SELECT l_quantity::DOUBLE AS x, (l_returnflag = 'R')::INT AS y, row_number() OVER (ORDER BY l_quantity) - 1 AS p, count(*) OVER () AS n FROM lineitem),
    t AS (SELECT DISTINCT x FROM v, range(0, 6) AS q(k) WHERE p = round_even((n - 1) * k / 5.0, 0)),
    e AS (SELECT x AS hi, lag(x) OVER (ORDER BY x) AS lo, row_number() OVER (ORDER BY x) - 2 AS bin FROM t),
    b AS (SELECT * FROM e WHERE lo IS NOT NULL)
    SELECT bin::INT AS bin, count(*) AS cnt, avg(y) AS mean_y FROM v JOIN b ON (x > lo OR bin = 0 AND x >= lo) AND x <= hi GROUP BY bin
""")
def bins_equal_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return binning.bin_table(items, "x", ["y"], 5).drop("bin_name")


#: The greedy merges as loops over a list of bins; costs are chi squares, 3.841458820694124 is their 0.95 quantile.
WOE_SQL = """
    WITH RECURSIVE v AS MATERIALIZED (SELECT l_extendedprice AS x, (l_returnflag = 'R')::INT AS y, row_number() OVER (ORDER BY l_extendedprice) - 1 AS p, count(*) OVER () AS n FROM lineitem),
    t AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY x) AS i FROM (SELECT DISTINCT x FROM v, range(0, 21) AS q(k) WHERE p = round_even((n - 1) * k / 20.0, 0))),
    e AS (SELECT 2 * i - 1 AS k, x AS lo, x AS hi FROM t UNION ALL SELECT 2 * a.i, a.x, b.x FROM t AS a JOIN t AS b ON b.i = a.i + 1),
    m AS (SELECT k, lo, hi, lo < hi AS o, lo < hi AS c, count(x) AS cnt, coalesce(sum(y), 0)::BIGINT AS bad FROM e LEFT JOIN v ON CASE WHEN lo = hi THEN x = lo ELSE x > lo AND x < hi END GROUP BY ALL),
    small AS (
        SELECT 0 AS step, list({'lo': lo, 'hi': hi, 'o': o, 'c': c, 'cnt': cnt, 'bad': bad} ORDER BY k) AS b FROM m
        UNION ALL
        SELECT step + 1, list_concat(list_append(b[1:pos - 1], {'lo': b[pos].lo, 'hi': b[pos + 1].hi, 'o': b[pos].o, 'c': b[pos + 1].c, 'cnt': b[pos].cnt + b[pos + 1].cnt, 'bad': b[pos].bad + b[pos + 1].bad}), b[pos + 2:])
        FROM (SELECT *, list_position(costs, list_min(costs)) AS pos FROM (
            SELECT *, list_transform(range(1, len(b)), lambda i: least(b[i].cnt, b[i + 1].cnt) + least(greatest(b[i].cnt, b[i + 1].cnt) / 100000.0, 1)) AS costs FROM small WHERE len(b) > 1
        )) WHERE list_min(costs) <= 50
    ),
    alike AS (
        SELECT 0 AS step, b FROM (SELECT b FROM small ORDER BY step DESC LIMIT 1)
        UNION ALL
        SELECT step + 1, list_concat(list_append(b[1:pos - 1], {'lo': b[pos].lo, 'hi': b[pos + 1].hi, 'o': b[pos].o, 'c': b[pos + 1].c, 'cnt': b[pos].cnt + b[pos + 1].cnt, 'bad': b[pos].bad + b[pos + 1].bad}), b[pos + 2:])
        FROM (SELECT *, list_position(costs, list_min(costs)) AS pos FROM (
            SELECT step, b, list_transform(cells, lambda z: (z.ag - z.n * z.g * z.a) ** 2 / (z.n * z.g * z.a) + (z.ab - z.n * (1 - z.g) * z.a) ** 2 / (z.n * (1 - z.g) * z.a)
                       + (z.bg - z.n * z.g * (1 - z.a)) ** 2 / (z.n * z.g * (1 - z.a)) + (z.bb - z.n * (1 - z.g) * (1 - z.a)) ** 2 / (z.n * (1 - z.g) * (1 - z.a))) AS costs
            FROM (
                SELECT step, b, list_transform(raw, lambda r: {'n': r.n, 'ag': r.ag + r.s, 'ab': r.ab + r.s, 'bg': r.bg + r.s, 'bb': r.bb + r.s, 'g': (r.ag + r.bg + 2 * r.s) / r.n, 'a': (r.ag + r.ab + 2 * r.s) / r.n}) AS cells FROM (
                    SELECT step, b, list_transform(range(1, len(b)), lambda i: {'n': (b[i].cnt + b[i + 1].cnt)::DOUBLE, 's': least(0.5::DOUBLE, (b[i].cnt + b[i + 1].cnt)::DOUBLE / 10000), 'ag': (b[i].cnt - b[i].bad)::DOUBLE, 'ab': b[i].bad::DOUBLE, 'bg': (b[i + 1].cnt - b[i + 1].bad)::DOUBLE, 'bb': b[i + 1].bad::DOUBLE}) AS raw
                    FROM alike WHERE len(b) > 1
                )
            )
        )) WHERE list_min(costs) <= 3.841458820694124
    ),
    last AS (SELECT b FROM alike ORDER BY step DESC LIMIT 1),
    rows AS (SELECT unnest(range(1, len(b) + 1)) AS i, len(b) AS k, b FROM last),
    base AS (SELECT ln((sum(y) + 0.5) / (count(*) - sum(y))) AS base FROM v)
    SELECT CASE WHEN i = 1 THEN '[-inf' WHEN b[i].o THEN printf('(%g', round(b[i].lo, 3)) ELSE printf('[%g', round(b[i].lo, 3)) END || ',' || CASE WHEN i = k THEN 'inf]' WHEN b[i].c THEN printf('%g)', round(b[i].hi, 3)) ELSE printf('%g]', round(b[i].hi, 3)) END AS bin_name,
           b[i].cnt AS cnt, b[i].bad AS bad, b[i].cnt - b[i].bad AS good, round(b[i].bad / (b[i].cnt + 0.5), 9) AS mean, round(ln((b[i].bad + 0.5) / (b[i].cnt - b[i].bad + 0.5)) - base, 9) AS woe FROM rows, base
"""


@query("bins_woe", WOE_SQL)
def bins_woe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins and single ticks, joined until they are large enough and differ, with their weight of evidence."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    out = binning.bin_frame(binning.woe_bins(items, "x", "y", 20, 50), items, "bin_name string, cnt long, bad long, good long, mean double, woe double")
    return out.withColumns({"mean": F.round("mean", 9), "woe": F.round("woe", 9)})


class MedianSteps(binning.Medians):
    """A caller's own strategy: neighbours whose medians lie at most a limit apart are joined, the nearest first."""

    def cost(self, bins: list[binning.Bin], k: int) -> float:
        a, b = (self.row(x.stats, None)["median"] for x in (bins[k], bins[k + 1]))
        return 0.0 if a is None or b is None else abs(a - b)


@query("bins_median", """
    WITH RECURSIVE v AS MATERIALIZED (SELECT l_extendedprice AS x, l_quantity AS y, row_number() OVER (ORDER BY l_extendedprice) - 1 AS p, count(*) OVER () AS n FROM lineitem),
    t AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT x FROM v, range(0, 41) AS q(k) WHERE p = round_even((n - 1) * k / 40.0, 0))),
    m AS MATERIALIZED (SELECT a.i AS k, v.y FROM t AS a JOIN t AS b ON b.i = a.i + 1 JOIN v ON (v.x > a.x OR a.i = 0 AND v.x >= a.x) AND v.x <= b.x),
    loop AS (
        SELECT 0 AS step, list([k] ORDER BY k) AS b FROM (SELECT DISTINCT k FROM m)
        UNION ALL
        SELECT step + 1, list_concat(list_append(b[1:pos - 1], list_concat(b[pos], b[pos + 1])), b[pos + 2:])
        FROM (SELECT step, b, list_position(costs, list_min(costs)) AS pos, list_min(costs) AS low FROM (
            SELECT step, b, list_transform(range(1, len(meds)), lambda i: abs(meds[i] - meds[i + 1])) AS costs FROM (
                SELECT step, any_value(b) AS b, list(med ORDER BY g) AS meds FROM (
                    SELECT step, any_value(b) AS b, g, median(m.y) AS med FROM (SELECT step, b, unnest(range(1, len(b) + 1)) AS g FROM loop WHERE len(b) > 1) AS s JOIN m ON list_contains(s.b[s.g], m.k) GROUP BY step, g
                ) GROUP BY step
            )
        )) WHERE low <= 1
    ),
    last AS (SELECT b FROM loop ORDER BY step DESC LIMIT 1),
    g AS (SELECT unnest(range(1, len(b) + 1)) AS g, b FROM last)
    SELECT (g - 1)::INT AS bin, count(*) AS cnt, median(m.y)::DOUBLE AS median FROM g JOIN m ON list_contains(g.b[g.g], m.k) GROUP BY g
""")
def bins_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller-made strategy on partial results: medians of a target by bin, close ones joined."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    found = binning.binned(items, "x", MedianSteps("y"), 40, limit=1.0)
    return binning.bin_frame(found, items, "bin int, cnt long, median double")


@query("category_woe", """
    WITH c AS (SELECT l_linestatus AS category, count(*) AS cnt, sum((l_returnflag = 'R')::INT)::BIGINT AS bad, sum((l_returnflag <> 'R')::INT)::BIGINT AS good FROM lineitem GROUP BY 1)
    SELECT category, cnt, bad, good, round(bad / (cnt + 0.5), 6) AS mean, round(ln((bad + 0.5) / (good + 0.5)) - ln((sum(bad) OVER () + 0.5) / sum(good) OVER ()), 6) AS woe FROM c
""")
def category_woe(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return binning.category_table(items, "l_linestatus", "y").withColumns({"mean": F.round("mean", 6), "woe": F.round("woe", 6)})


@query("ks", """
    WITH s AS (SELECT px AS s, sum((vol > 60)::INT) AS bad, sum((vol <= 60)::INT) AS good FROM $TICKS GROUP BY px),
    c AS (SELECT sum(bad) OVER (ORDER BY s) / (sum(bad) OVER ()) AS b, sum(good) OVER (ORDER BY s) / (sum(good) OVER ()) AS g FROM s)
    SELECT round(greatest(max(g - b), 0), 6) AS ks FROM c
""")
def ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.ks(ticks(spark, sf_dir).withColumn("y", (F.col("vol") > 60).cast("int")), "px", "y").select(F.round("ks", 6).alias("ks"))


@query("auc", """
    WITH s AS (SELECT px AS s, sum((vol > 60)::INT) AS bad, sum((vol <= 60)::INT) AS good FROM $TICKS GROUP BY px),
    c AS (SELECT bad, good, coalesce(sum(good) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
    SELECT round(sum(bad * (2 * below + good)) / (2 * sum(bad) * sum(good)), 6) AS auc FROM c
""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.auc(ticks(spark, sf_dir).withColumn("y", (F.col("vol") > 60).cast("int")), "px", "y").select(F.round("auc", 6).alias("auc"))


@query("psi", """
    WITH g AS (SELECT unnest(range(0, 10)) AS bin), s AS (SELECT DISTINCT symbol FROM $TICKS),
    c AS (SELECT bin, symbol, count(t.px) + 0.5 AS n FROM g CROSS JOIN s LEFT JOIN (SELECT px % 10 AS b, symbol AS sy, px FROM $TICKS) AS t ON t.b = bin AND t.sy = symbol GROUP BY ALL),
    p AS (SELECT bin, symbol, n / sum(n) OVER (PARTITION BY symbol) AS share FROM c)
    SELECT p.symbol, round(sum((p.share - r.share) * ln(p.share / r.share)), 6) AS psi FROM p JOIN p AS r ON p.bin = r.bin AND r.symbol = 'click' WHERE p.symbol <> 'click' GROUP BY 1
""")
def psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.psi(ticks(spark, sf_dir).withColumn("bin", F.col("px") % 10), "bin", "symbol", "click").withColumn("psi", F.round("psi", 6))


@query("psi_largest", """
    WITH g AS (SELECT unnest(range(0, 10)) AS bin), s AS (SELECT DISTINCT symbol FROM $TICKS),
    c AS (SELECT bin, symbol, count(t.px) + 0.5 AS n FROM g CROSS JOIN s LEFT JOIN (SELECT px % 10 AS b, symbol AS sy, px FROM $TICKS) AS t ON t.b = bin AND t.sy = symbol GROUP BY ALL),
    w AS (SELECT px % 10 AS bin, count(*) + 0.5 AS n FROM $TICKS GROUP BY 1),
    p AS (SELECT bin, symbol, n / sum(n) OVER (PARTITION BY symbol) AS share FROM c), r AS (SELECT bin, n / sum(n) OVER () AS share FROM w),
    i AS (SELECT symbol, sum((p.share - r.share) * ln(p.share / r.share)) AS psi FROM p JOIN r USING (bin) GROUP BY 1)
    SELECT round(max(psi), 6) AS psi FROM i
""")
def psi_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.largest_psi(ticks(spark, sf_dir).withColumn("bin", F.col("px") % 10), "bin", "symbol").withColumn("psi", F.round("psi", 6))


@query("mutual_information", """
    WITH j AS (SELECT symbol, vol % 4 AS v, count(*)::DOUBLE AS c FROM $TICKS GROUP BY ALL), t AS (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY symbol) AS a, sum(c) OVER (PARTITION BY v) AS b FROM j)
    SELECT round(sum(c / n * ln(c * n / (a * b))), 6) AS mutual_information FROM t
""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("v", F.col("vol") % 4)
    return model.mutual_information(t, "symbol", "v").select(F.round("mutual_information", 6).alias("mutual_information"))


@query("entropy", "WITH c AS (SELECT count(*)::DOUBLE AS c FROM $TICKS GROUP BY symbol, vol % 4), p AS (SELECT c / sum(c) OVER () AS p FROM c) SELECT round(-sum(p * ln(p)), 6) AS entropy FROM p")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.entropy(ticks(spark, sf_dir).withColumn("v", F.col("vol") % 4), ["symbol", "v"]).select(F.round("entropy", 6).alias("entropy"))


#: Newton steps: sums of the gradient and the Hessian with the present coefficients, solved by determinants.
LOGISTIC_SQL = """
    WITH RECURSIVE v AS MATERIALIZED (SELECT l_quantity::DOUBLE / 50 AS q, l_extendedprice::DOUBLE / 100000 AS e, (l_returnflag = 'R')::INT::DOUBLE AS y FROM lineitem),
    n AS (
        SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS moved
        UNION ALL
        SELECT step + 1, a + da, b + db, c + dc, greatest(abs(da), abs(db), abs(dc)) FROM (
            SELECT step, a, b, c, (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / d AS da,
                   (h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / d AS db, (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / d AS dc
            FROM (
                SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS d FROM (
                    SELECT step, a, b, c, sum(q * (y - p)) - 1e-6 * a AS g1, sum(e * (y - p)) - 1e-6 * b AS g2, sum(y - p) AS g3, sum(q * q * p * (1 - p)) + 1e-6 AS h11, sum(q * e * p * (1 - p)) AS h12, sum(q * p * (1 - p)) AS h13,
                           sum(e * e * p * (1 - p)) + 1e-6 AS h22, sum(e * p * (1 - p)) AS h23, sum(p * (1 - p)) AS h33
                    FROM (SELECT n.*, v.*, 1 / (1 + exp(-(a * q + b * e + c))) AS p FROM n, v WHERE moved > 1e-9 AND step < 25) GROUP BY step, a, b, c
                )
            )
        )
    ),
    last AS (SELECT * FROM n ORDER BY step DESC LIMIT 1)
    SELECT unnest(['q', 'e', 'intercept']) AS name, unnest([round(a, 6), round(b, 6), round(c, 6)]) AS coef FROM last
"""


@query("logistic", LOGISTIC_SQL)
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of a logistic model by Newton steps."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("q"), (F.col("l_extendedprice") / 100000).alias("e"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    coef = model.logistic(items, ["q", "e"], "y")
    return spark.createDataFrame([(n, round(float(c), 6)) for n, c in zip(["q", "e", "intercept"], coef, strict=True)], "name string, coef double")


PLAYS_SQL = "(SELECT *, CASE WHEN s > 0 THEN r WHEN s < 0 THEN -r END AS play FROM (SELECT *, event_id % 3 - 1 AS s, lead(px, 5) OVER (PARTITION BY symbol ORDER BY ts, event_id) - px AS r FROM $TICKS))"


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("r", F.lead("px", 5).over(scan.series(BY, ORDER)) - F.col("px"))
    return t.withColumn("play", backtest.play(F.col("event_id") % 3 - 1, F.col("r")))


@query("backtest_stats", f"""
    WITH p AS (SELECT * FROM {PLAYS_SQL} WHERE play IS NOT NULL), c AS (SELECT *, sum(play) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS cs FROM p),
    d AS (SELECT *, cs - min(cs) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS dd FROM c)
    SELECT symbol, count(*) AS n_plays, round(avg(play), 4) AS r_mean, sum(play)::BIGINT AS r_sum, round(stddev_samp(play), 4) AS r_std, round(avg((play > 0)::INT), 6) AS win_rate,
           round(avg(CASE WHEN play > 0 THEN play END), 4) AS win_mean, round(avg((play < 0)::INT), 6) AS lose_rate, round(avg(CASE WHEN play < 0 THEN play END), 4) AS lose_mean,
           max(dd)::BIGINT AS max_drawdown, round(sum(play) / nullif(max(dd), 0), 6) AS calmar, round(avg(play) / nullif(stddev_samp(play), 0), 6) AS sharpe
    FROM d GROUP BY symbol
""")
def backtest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backtest.stats(plays(spark, sf_dir), BY, ORDER, "play")
    return out.withColumns({c: F.round(c, 4) for c in ("r_mean", "r_std", "win_mean", "lose_mean")} | {c: F.round(c, 6) for c in ("win_rate", "lose_rate", "calmar", "sharpe")})


@query("quantile_backtest", f"""
    WITH q AS (SELECT list_distinct(quantile_cont(px % 977, [0.25, 0.5, 0.75])) AS c FROM $TICKS),
    p AS (SELECT len(list_filter(c, lambda e: e < px % 977))::INT AS bucket, r FROM {PLAYS_SQL}, q WHERE r IS NOT NULL)
    SELECT bucket, count(*) AS n_plays, sum(r)::BIGINT AS r_sum, round(avg(r), 4) AS r_mean FROM p GROUP BY bucket
""")
def quantile_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = plays(spark, sf_dir).withColumn("f", F.col("px") % 977)
    return backtest.quantile_backtest(t, "f", "r", 4, ORDER).select("bucket", "n_plays", "r_sum", F.round("r_mean", 4).alias("r_mean"))


@query("tail_backtest", f"""
    WITH q AS (SELECT quantile_cont(px % 977, 0.05) AS lo, quantile_cont(px % 977, 0.95) AS hi FROM $TICKS), p AS (SELECT *, px % 977 AS f FROM {PLAYS_SQL}, q),
    s AS (SELECT 'long' AS side, CASE WHEN f <= lo THEN r END AS play FROM p UNION ALL SELECT 'short', CASE WHEN f >= hi THEN -r END FROM p UNION ALL SELECT 'both', CASE WHEN f <= lo THEN r WHEN f >= hi THEN -r END FROM p)
    SELECT side, count(play) AS n_plays, sum(play)::BIGINT AS r_sum FROM s GROUP BY side
""")
def tail_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = plays(spark, sf_dir).withColumn("f", F.col("px") % 977)
    return backtest.tail_backtest(t, "f", "r", 0.05, ORDER).select("side", "n_plays", "r_sum")


@query("dot_product", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS dot FROM embeddings")
def dot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot(e, e), 4).alias("dot"))


BARS_SQL = """(SELECT symbol, CAST(floor(epoch_us(ts) / 36e8) AS BIGINT) AS bucket, arg_min(px, (ts, event_id)) AS open, max(px) AS high, min(px) AS low,
    arg_max(px, (ts, event_id)) AS close, CAST(sum(vol) AS BIGINT) AS volume FROM $TICKS GROUP BY ALL)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("bucket", bars.time_bucket(F.col("ts"), 3600))
    return bars.bars(t, ["symbol", "bucket"], ORDER, "px", "vol")


@query("indicators_finite", f"""
    WITH b AS (SELECT *, row_number() OVER w AS p, (high + low + close) / 3.0 AS tp FROM {BARS_SQL} WINDOW w AS (PARTITION BY symbol ORDER BY bucket)),
    c AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bucket) AS pc FROM b)
    SELECT symbol, bucket, CASE WHEN p >= 30 THEN round(avg(close) OVER w30, 4) END AS SMA, CASE WHEN p >= 14 THEN (max(close) OVER w14 + min(close) OVER w14) / 2.0 END AS MIDPOINT,
           CASE WHEN p >= 5 THEN round(avg(close) OVER w5 + 2 * stddev_pop(close) OVER w5, 4) END AS BBANDS_upper, close - lag(close, 10) OVER w AS MOM,
           CASE WHEN p >= 14 THEN round(-100.0 * (max(high) OVER w14 - close) / nullif(max(high) OVER w14 - min(low) OVER w14, 0), 4) END AS WILLR,
           CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS TRANGE,
           CAST(sum(CASE WHEN pc IS NULL OR close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS OBV,
           round((close / nullif(lag(close, 10) OVER w, 0)::DOUBLE - 1) * 100, 4) AS ROC
    FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bucket), w30 AS (PARTITION BY symbol ORDER BY bucket ROWS 29 PRECEDING), w14 AS (PARTITION BY symbol ORDER BY bucket ROWS 13 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY bucket ROWS 4 PRECEDING)
""")
def indicators_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = indicators.with_finite(hourly(spark, sf_dir), ["symbol"], ["bucket"])
    rounded = {c: F.round(c, 4) for c in ("SMA", "BBANDS_upper", "WILLR", "ROC")} | {"OBV": F.col("OBV").cast("long")}
    return out.withColumns(rounded).select("symbol", "bucket", "SMA", "MIDPOINT", "BBANDS_upper", "MOM", "WILLR", "TRANGE", "OBV", "ROC")


@query("indicators_recursive")
def indicators_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive indicators, checked by unit tests."""
    return indicators.with_recursive(hourly(spark, sf_dir), ["symbol"], ["bucket"]).select("symbol", "bucket", *indicators.RECURSIVE)


#: Per pattern: when, and the mark. z is the present bar, y the one before, then x, v, u; marks of the plain means (L, S_, D, a, b) and of full windows.
CANDLES = {
    "CDLDOJI": ("z.D", "100"), "CDLDRAGONFLYDOJI": ("z.D AND z.a AND NOT z.b", "100"), "CDLGRAVESTONEDOJI": ("z.D AND z.b AND NOT z.a", "100"),
    "CDLLONGLEGGEDDOJI": ("z.D AND (z.us > z.body OR z.ls > z.body) AND NOT z.a", "100"), "CDLMARUBOZU": ("z.L AND z.a AND z.b", "100 * z.s"), "CDLLONGLINE": ("z.L AND z.us < z.body AND z.ls < z.body", "100 * z.s"),
    "CDLSHORTLINE": ("z.S_ AND z.us < z.body AND z.ls < z.body", "100 * z.s"), "CDLSPINNINGTOP": ("z.S_ AND z.us > z.body AND z.ls > z.body", "100 * z.s"), "CDLHIGHWAVE": ("z.S_ AND z.us > 2 * z.body AND z.ls > 2 * z.body", "100 * z.s"),
    "CDLCLOSINGMARUBOZU": ("z.L AND CASE WHEN z.s > 0 THEN z.a ELSE z.b END", "100 * z.s"), "CDLBELTHOLD": ("z.L AND CASE WHEN z.s > 0 THEN z.b ELSE z.a END", "100 * z.s"),
    "CDLHAMMER": ("z.S_ AND z.ls > 2 * z.body AND z.a AND z.bot <= y.low + 0.2 * z.wr", "100"), "CDLHANGINGMAN": ("z.S_ AND z.ls > 2 * z.body AND z.a AND z.bot >= y.high - 0.2 * z.wr", "-100"),
    "CDLINVERTEDHAMMER": ("z.S_ AND z.us > 2 * z.body AND z.b AND z.top < y.bot", "100"), "CDLSHOOTINGSTAR": ("z.S_ AND z.us > 2 * z.body AND z.b AND z.bot > y.top", "-100"),
    "CDLENGULFING": ("z.s <> y.s AND z.top >= y.top AND z.bot <= y.bot AND (z.top > y.top OR z.bot < y.bot)", "100 * z.s"), "CDLHARAMI": ("y.L AND z.S_ AND z.top <= y.top AND z.bot >= y.bot", "-100 * y.s"),
    "CDLHARAMICROSS": ("y.L AND z.D AND z.top <= y.top AND z.bot >= y.bot", "-100 * y.s"), "CDLPIERCING": ("y.s < 0 AND z.s > 0 AND y.L AND z.o < y.low AND z.c > (y.o + y.c) / 2 AND z.c < y.o", "100"),
    "CDLDARKCLOUDCOVER": ("y.s > 0 AND z.s < 0 AND y.L AND z.o > y.high AND z.c < (y.o + y.c) / 2 AND z.c > y.o", "-100"), "CDLMORNINGSTAR": ("x.s < 0 AND x.L AND y.S_ AND y.top < x.c AND z.s > 0 AND z.c > (x.o + x.c) / 2", "100"),
    "CDLEVENINGSTAR": ("x.s > 0 AND x.L AND y.S_ AND y.bot > x.c AND z.s < 0 AND z.c < (x.o + x.c) / 2", "-100"),
    "CDL3WHITESOLDIERS": ("z.s > 0 AND y.s > 0 AND x.s > 0 AND z.c > y.c AND y.c > x.c AND z.o > y.o AND z.o < y.c AND y.o > x.o AND y.o < x.c AND z.a", "100"),
    "CDL3BLACKCROWS": ("z.s < 0 AND y.s < 0 AND x.s < 0 AND z.c < y.c AND y.c < x.c AND z.o < y.o AND z.o > y.c AND y.o < x.o AND y.o > x.c AND z.b", "-100"),
    "CDL3INSIDE": ("x.L AND y.S_ AND y.top <= x.top AND y.bot >= x.bot AND z.s <> x.s AND CASE WHEN z.s > 0 THEN z.c > x.o ELSE z.c < x.o END", "100 * z.s"),
    "CDL3OUTSIDE": ("y.s <> x.s AND y.top >= x.top AND y.bot <= x.bot AND CASE WHEN y.s > 0 THEN z.c > y.c ELSE z.c < y.c END", "100 * y.s"),
    "CDLTRISTAR": ("z.D AND y.D AND x.D AND (y.bot > x.top AND z.top < y.top OR y.top < x.bot AND z.bot > y.bot)", "CASE WHEN z.top < y.top THEN -100 ELSE 100 END"),
    "CDLMATCHINGLOW": ("z.s < 0 AND y.s < 0 AND abs(z.c - y.c) <= 0.05 * z.wr", "100"), "CDLDOJISTAR": ("y.L AND z.D AND CASE WHEN y.s > 0 THEN z.bot > y.top ELSE z.top < y.bot END", "-100 * y.s"),
    "CDL2CROWS": ("x.s > 0 AND x.long AND y.s < 0 AND y.bot > x.top AND z.s < 0 AND z.o < y.o AND z.o > y.c AND z.c > x.o AND z.c < x.c", "-100"),
    "CDLUPSIDEGAP2CROWS": ("x.s > 0 AND x.long AND y.s < 0 AND y.bot > x.top AND z.s < 0 AND y.short AND z.o > y.o AND z.c < y.c AND z.c > x.c", "-100"),
    "CDL3LINESTRIKE": ("v.s = x.s AND x.s = y.s AND z.s = -y.s AND x.o >= v.bot - v.near AND x.o <= v.top + v.near AND y.o >= x.bot - x.near AND y.o <= x.top + x.near AND CASE WHEN y.s > 0 THEN y.c > x.c AND x.c > v.c AND z.o > y.c AND z.c < v.o ELSE y.c < x.c AND x.c < v.c AND z.o < y.c AND z.c > v.o END", "100 * y.s"),
    "CDL3STARSINSOUTH": ("x.s < 0 AND y.s < 0 AND z.s < 0 AND x.long AND x.ls > x.body AND y.body < x.body AND y.o > x.c AND y.o <= x.high AND y.low < x.c AND y.low >= x.low AND NOT y.nl AND z.short AND z.nu AND z.nl AND z.low > y.low AND z.high < y.high", "100"),
    "CDLABANDONEDBABY": ("x.long AND y.doji AND (x.s > 0 AND z.s < 0 AND z.c < x.c - 0.3 * x.body AND y.low > x.high AND z.high < y.low OR x.s < 0 AND z.s > 0 AND z.c > x.c + 0.3 * x.body AND y.high < x.low AND z.low > y.high)", "100 * z.s"),
    "CDLMORNINGDOJISTAR": ("x.long AND y.doji AND x.s < 0 AND y.top < x.bot AND z.s > 0 AND z.c > x.c + 0.3 * x.body", "100"), "CDLEVENINGDOJISTAR": ("x.long AND y.doji AND x.s > 0 AND y.bot > x.top AND z.s < 0 AND z.c < x.c - 0.3 * x.body", "-100"),
    "CDLADVANCEBLOCK": ("x.s > 0 AND y.s > 0 AND z.s > 0 AND z.c > y.c AND y.c > x.c AND y.o > x.o AND y.o <= x.c + x.near AND z.o > y.o AND z.o <= y.c + y.near AND x.long AND x.su AND (y.body < x.body - x.far AND z.body < y.body + y.near OR z.body < y.body - y.far OR z.body < y.body AND y.body < x.body AND (NOT z.su OR NOT y.su) OR z.body < y.body AND z.us > z.body)", "-100"),
    "CDLSTALLEDPATTERN": ("x.s > 0 AND y.s > 0 AND z.s > 0 AND z.c > y.c AND y.c > x.c AND x.long AND y.long AND y.nu AND y.o > x.o AND y.o <= x.c + x.near AND z.short AND z.o >= y.c - z.body - y.near", "-100"),
    "CDLBREAKAWAY": ("u.long AND u.s = v.s AND v.s = y.s AND y.s = -z.s AND CASE WHEN u.s < 0 THEN v.top < u.bot AND x.high < v.high AND x.low < v.low AND y.high < x.high AND y.low < x.low AND z.c > v.o AND z.c < u.c ELSE v.bot > u.top AND x.high > v.high AND x.low > v.low AND y.high > x.high AND y.low > x.low AND z.c < v.o AND z.c > u.c END", "100 * z.s"),
    "CDLCONCEALBABYSWALL": ("v.s < 0 AND x.s < 0 AND y.s < 0 AND z.s < 0 AND v.nu AND v.nl AND x.nu AND x.nl AND y.top < x.bot AND NOT y.nu AND y.high > x.c AND z.high > y.high AND z.low < y.low", "100"),
    "CDLCOUNTERATTACK": ("y.s = -z.s AND y.long AND z.long AND abs(z.c - y.c) <= y.eq", "100 * z.s"), "CDLSEPARATINGLINES": ("y.s = -z.s AND z.long AND abs(z.o - y.o) <= y.eq AND CASE WHEN z.s > 0 THEN z.nl ELSE z.nu END", "100 * z.s"),
    "CDLGAPSIDESIDEWHITE": ("y.s > 0 AND z.s > 0 AND (y.bot > x.top AND z.bot > x.top OR y.top < x.bot AND z.top < x.bot) AND abs(z.body - y.body) <= y.near AND abs(z.o - y.o) <= y.eq", "CASE WHEN y.bot > x.top THEN 100 ELSE -100 END"),
    "CDLHIKKAKE": ("y.high < x.high AND y.low > x.low AND (z.high < y.high AND z.low < y.low OR z.high > y.high AND z.low > y.low)", "CASE WHEN z.high < y.high AND z.low < y.low THEN 100 ELSE -100 END"),
    "CDLHIKKAKEMOD": ("y.high < x.high AND y.low > x.low AND (z.high < y.high AND z.low < y.low OR z.high > y.high AND z.low > y.low) AND x.high < v.high AND x.low > v.low AND CASE WHEN z.high < y.high AND z.low < y.low THEN x.c <= x.low + x.near ELSE x.c >= x.high - x.near END", "CASE WHEN z.high < y.high AND z.low < y.low THEN 100 ELSE -100 END"),
    "CDLHOMINGPIGEON": ("y.s < 0 AND z.s < 0 AND y.long AND z.short AND z.o < y.o AND z.c > y.c", "100"),
    "CDLIDENTICAL3CROWS": ("x.s < 0 AND y.s < 0 AND z.s < 0 AND y.c < x.c AND z.c < y.c AND x.nl AND y.nl AND z.nl AND abs(y.o - x.c) <= x.eq AND abs(z.o - y.c) <= y.eq", "-100"),
    "CDLINNECK": ("y.s < 0 AND y.long AND z.s > 0 AND z.o < y.low AND z.c <= y.c + y.eq AND z.c >= y.c", "-100"), "CDLONNECK": ("y.s < 0 AND y.long AND z.s > 0 AND z.o < y.low AND abs(z.c - y.low) <= y.eq", "-100"),
    "CDLTHRUSTING": ("y.s < 0 AND y.long AND z.s > 0 AND z.o < y.low AND z.c > y.c + y.eq AND z.c <= (y.o + y.c) / 2", "-100"),
    "CDLKICKING": ("y.s <> z.s AND y.long AND y.nu AND y.nl AND z.long AND z.nu AND z.nl AND CASE WHEN y.s < 0 THEN z.low > y.high ELSE z.high < y.low END", "100 * z.s"),
    "CDLKICKINGBYLENGTH": ("y.s <> z.s AND y.long AND y.nu AND y.nl AND z.long AND z.nu AND z.nl AND CASE WHEN y.s < 0 THEN z.low > y.high ELSE z.high < y.low END", "100 * CASE WHEN z.body > y.body THEN z.s ELSE y.s END"),
    "CDLLADDERBOTTOM": ("u.s < 0 AND v.s < 0 AND x.s < 0 AND u.o > v.o AND v.o > x.o AND u.c > v.c AND v.c > x.c AND y.s < 0 AND NOT y.nu AND z.s > 0 AND z.o > y.o AND z.c > y.high", "100"),
    "CDLMATHOLD": ("u.long AND u.s > 0 AND v.short AND x.short AND y.short AND v.s < 0 AND z.s > 0 AND v.bot > u.top AND x.bot < u.c AND y.bot < u.c AND x.bot > u.c - 0.5 * u.body AND y.bot > u.c - 0.5 * u.body AND x.top < v.o AND y.top < x.top AND z.o > y.c AND z.c > greatest(v.high, x.high, y.high)", "100"),
    "CDLRISEFALL3METHODS": ("u.long AND v.short AND x.short AND y.short AND z.long AND v.s = -u.s AND x.s = -u.s AND y.s = -u.s AND z.s = u.s AND greatest(v.bot, x.bot, y.bot) < u.high AND least(v.top, x.top, y.top) > u.low AND CASE WHEN u.s > 0 THEN x.c < v.c AND y.c < x.c AND z.o > y.c AND z.c > u.c ELSE x.c > v.c AND y.c > x.c AND z.o < y.c AND z.c < u.c END", "100 * u.s"),
    "CDLRICKSHAWMAN": ("z.doji AND z.ls > z.body AND z.us > z.body AND z.bot <= z.low + z.rng / 2 + z.near AND z.top >= z.low + z.rng / 2 - z.near", "100"), "CDLTAKURI": ("z.doji AND z.nu AND z.ls > 2 * z.body", "100"),
    "CDLSTICKSANDWICH": ("x.s < 0 AND y.s > 0 AND z.s < 0 AND y.low > x.c AND abs(z.c - x.c) <= x.eq", "100"),
    "CDLTASUKIGAP": ("CASE WHEN y.s > 0 THEN y.bot > x.top AND z.s < 0 AND z.o < y.c AND z.o > y.o AND z.c < y.o AND z.c > x.top ELSE y.top < x.bot AND z.s > 0 AND z.o < y.o AND z.o > y.c AND z.c > y.o AND z.c < x.bot END AND abs(y.body - z.body) <= y.near", "100 * y.s"),
    "CDLUNIQUE3RIVER": ("x.long AND x.s < 0 AND y.s < 0 AND y.c > x.c AND y.o <= x.o AND y.low < x.low AND z.short AND z.s > 0 AND z.o > y.low", "100"),
    "CDLXSIDEGAP3METHODS": ("x.s = y.s AND z.s = -y.s AND z.o < y.top AND z.o > y.bot AND z.c < x.top AND z.c > x.bot AND CASE WHEN x.s > 0 THEN y.bot > x.top ELSE y.top < x.bot END", "100 * x.s"),
}

CANDLES_SQL = f"""
    WITH b AS (SELECT symbol, bucket, open::DOUBLE AS o, high::DOUBLE AS h, low::DOUBLE AS l, close::DOUBLE AS c FROM {BARS_SQL}),
    f AS (SELECT *, abs(c - o) AS body, h - l AS rng, h - greatest(o, c) AS us, least(o, c) - l AS ls, CASE WHEN c >= o THEN 1 ELSE -1 END AS s, greatest(o, c) AS top, least(o, c) AS bot FROM b),
    m AS (
        SELECT *, avg(body) OVER ten AS wb, avg(rng) OVER ten AS wr, CASE WHEN count(*) OVER ten = 10 THEN avg(body) OVER ten END AS ab, CASE WHEN count(*) OVER ten = 10 THEN avg(rng) OVER ten END AS ar,
               CASE WHEN count(*) OVER ten = 10 THEN avg(us + ls) OVER ten END AS ash, CASE WHEN count(*) OVER five = 5 THEN avg(rng) OVER five END AS an
        FROM f WINDOW ten AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), five AS (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
    ),
    k AS (
        SELECT symbol, bucket, {{'o': o, 'high': h, 'low': l, 'c': c, 'body': body, 'rng': rng, 'us': us, 'ls': ls, 's': s, 'top': top, 'bot': bot, 'wr': wr, 'L': body > wb, 'S_': body < wb, 'D': body <= 0.1 * wr, 'a': us < 0.1 * wr, 'b': ls < 0.1 * wr,
               'long': body > ab, 'short': body < ab, 'doji': body <= 0.1 * ar, 'nu': us < 0.1 * ar, 'nl': ls < 0.1 * ar, 'su': us < ash / 2, 'near': 0.2 * an, 'far': 0.6 * an, 'eq': 0.05 * an}} AS z FROM m
    ),
    w AS (SELECT symbol, bucket, z, lag(z) OVER o AS y, lag(z, 2) OVER o AS x, lag(z, 3) OVER o AS v, lag(z, 4) OVER o AS u FROM k WINDOW o AS (PARTITION BY symbol ORDER BY bucket))
    SELECT symbol, bucket, {", ".join(f"(CASE WHEN {rule} THEN {mark} ELSE 0 END)::INT AS {name}" for name, (rule, mark) in CANDLES.items())} FROM w
"""


@query("candle_patterns", CANDLES_SQL)
def candle_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candle patterns."""
    out = indicators.with_patterns(hourly(spark, sf_dir), ["symbol"], ["bucket"])
    return out.select("symbol", "bucket", *[c for c in out.columns if c.startswith("CDL")])


@query("trade_prices", """
    WITH t AS (SELECT *, sum(vol) OVER w AS vs, sum(vol * mid) OVER w AS ts_ FROM $BOOK WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id)),
    d AS (SELECT *, vs - coalesce(lag(vs) OVER w, 0) AS v, ts_ - coalesce(lag(ts_) OVER w, 0) AS a FROM t WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id))
    SELECT event_id, v::BIGINT AS vol, (a / 10.0)::DOUBLE AS amt, round(last_value(CASE WHEN v > 0 THEN a / 10.0 / v END IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY ts, event_id), 6) AS vwap, (AP1 + BP1) / 2.0 AS mid_price FROM d
""")
def trade_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = scan.running(DAY, ORDER)
    s = snapshots(spark, sf_dir).withColumns({"vol_sum": F.sum("vol").over(up), "amt_sum": F.sum(F.col("vol") * F.col("mid")).over(up)})
    out = microstructure.trade_prices(s, DAY, ORDER, "vol_sum", "amt_sum", F.lit(10))
    return out.select("event_id", "vol", F.col("amt").cast("double").alias("amt"), F.round("VWAP", 6).alias("vwap"), F.col("MID").alias("mid_price"))


@query("spread_states", """
    WITH b AS (SELECT event_id, AP1 - BP1 AS s, coalesce(lag(AP1) OVER w, AP1) - coalesce(lag(BP1) OVER w, BP1) AS s0, AP1 - coalesce(lag(AP1) OVER w, AP1) AS a, BP1 - coalesce(lag(BP1) OVER w, BP1) AS b FROM $BOOK WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id))
    SELECT event_id, s AS spread, CASE WHEN (s, s0, a, b) = (1, 1, 0, 0) THEN 'one' WHEN (s, s0, a, b) = (2, 1, 0, -1) THEN 'one_down_half' WHEN (s, s0, a, b) = (1, 1, -1, -1) THEN 'one_down' WHEN (s, s0, a, b) = (2, 1, 1, 0) THEN 'one_up_half'
        WHEN (s, s0, a, b) = (1, 1, 1, 1) THEN 'one_up' WHEN (s, s0, a, b) = (2, 2, 0, 0) THEN 'two' WHEN (s, s0, a, b) = (1, 2, -1, 0) THEN 'two_down_half' WHEN (s, s0, a, b) = (2, 2, -1, -1) THEN 'two_down' WHEN (s, s0, a, b) = (1, 2, -2, -1) THEN 'two_down_more'
        WHEN (s, s0, a, b) = (1, 2, 0, 1) THEN 'two_up_half' WHEN (s, s0, a, b) = (2, 2, 1, 1) THEN 'two_up' WHEN (s, s0, a, b) = (1, 2, 1, 2) THEN 'two_up_more' END AS state
    FROM b
""")
def spread_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = books(spark, sf_dir).withColumn("s", microstructure.spread_state())
    return b.select("event_id", "s.spread", microstructure.named_state(F.col("s")).alias("state"))


@query("added_limit", """
    WITH g AS (SELECT *, coalesce(lag(AP1) OVER w, AP1) AS l1, coalesce(lag(AP2) OVER w, AP2) AS l2, coalesce(lag(AP3) OVER w, AP3) AS l3, coalesce(lag(AP4) OVER w, AP4) AS l4, coalesce(lag(AP5) OVER w, AP5) AS l5,
        coalesce(lag(AV1) OVER w, 0) AS w1, coalesce(lag(AV2) OVER w, 0) AS w2, coalesce(lag(AV3) OVER w, 0) AS w3, coalesce(lag(AV4) OVER w, 0) AS w4, coalesce(lag(AV5) OVER w, 0) AS w5 FROM $BOOK WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id))
    SELECT event_id, CASE WHEN AP2 < l1 THEN AV2 WHEN AP2 > l5 THEN 0 ELSE AV2 - CASE AP2 WHEN l1 THEN w1 WHEN l2 THEN w2 WHEN l3 THEN w3 WHEN l4 THEN w4 WHEN l5 THEN w5 ELSE 0 END + CASE WHEN AP2 = l1 THEN vol ELSE 0 END END AS added FROM g
""")
def added_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).select("event_id", microstructure.added_limit("A", 2, "vol").alias("added"))


@query("two_price_split", """
    WITH s AS (SELECT event_id, vol, vol * mid + event_id * 3 % (vol + 1) AS amt, mid FROM $BOOK), p AS (SELECT *, CASE WHEN vol > 0 AND amt <> 0 THEN amt // vol END AS p FROM s)
    SELECT event_id, CASE WHEN p IS NULL THEN 0 WHEN p > mid + 2 OR p < mid - 2 THEN vol ELSE vol - (amt - p * vol) END::BIGINT AS low_volume, CASE WHEN p IS NULL OR p > mid + 2 OR p < mid - 2 THEN 0 ELSE amt - p * vol END::BIGINT AS high_volume FROM p
""")
def two_price_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = books(spark, sf_dir).withColumn("m", microstructure.two_price_split(F.col("vol"), F.col("amt"), F.col("mid") - 2, F.col("mid") + 2))
    low = F.floor(F.try_divide("amt", "vol")).cast("bigint")
    return b.select("event_id", pv.get(F.col("m"), F.coalesce(low, F.lit(-1))).alias("low_volume"), pv.get(F.col("m"), F.coalesce(low + 1, F.lit(-1))).alias("high_volume"))


@query("level_flow", """
    WITH g AS (SELECT *, lag(event_id) OVER w IS NOT NULL AS known, lag([AP1, AP2, AP3, AP4, AP5]) OVER w AS lp, lag([AV1, AV2, AV3, AV4, AV5]) OVER w AS lv FROM $BOOK WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id)),
    n AS (SELECT event_id, BP1 + 2 AS edge, unnest([AP1, AP2, AP3, AP4, AP5]) AS p, unnest([AV1, AV2, AV3, AV4, AV5]) AS v FROM g),
    o AS (SELECT event_id, BP1 + 2 AS edge, unnest(lp) AS p, -unnest(lv) AS v FROM g WHERE known),
    d AS (SELECT event_id, edge, p, sum(v) AS v FROM (SELECT * FROM n UNION ALL SELECT * FROM o) GROUP BY ALL)
    SELECT event_id, coalesce(sum(v) FILTER (p <= edge), 0)::BIGINT AS flow, coalesce(sum(v) FILTER (p <= edge AND v > 0), 0)::BIGINT AS flow_pos, coalesce(sum(v) FILTER (p <= edge AND v < 0), 0)::BIGINT AS flow_neg FROM d GROUP BY event_id
""")
def level_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = microstructure.level_flow(1)
    return book.with_maps(books(spark, sf_dir)).select("event_id", flow["ask1_flow"].alias("flow"), flow["ask1_flow_pos"].alias("flow_pos"), flow["ask1_flow_neg"].alias("flow_neg"))


@query("rolling_prices", """
    WITH t AS (SELECT event_id, symbol, ts, vol, (vol * px)::DOUBLE AS a FROM $TICKS)
    SELECT event_id, round(sum(a) OVER w / nullif(sum(vol) OVER w, 0), 3) AS pmean, round(sum(vol) OVER w / count(*) OVER w::DOUBLE, 6) AS vmean FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id ROWS 19 PRECEDING)
""")
def rolling_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("amt", F.col("vol") * F.col("px"))
    out = microstructure.rolling_prices(t, BY, ORDER, "vol", "amt", [20], "t")
    return out.select("event_id", F.round("t_pmean_20", 3).alias("pmean"), F.round("t_vmean_20", 6).alias("vmean"))


@query("value_at", """
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS p FROM $TICKS) SELECT a.event_id, b.px AS there FROM s AS a LEFT JOIN s AS b ON a.symbol = b.symbol AND b.p = a.event_id % 50
""")
def value_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("place", F.col("event_id") % 50)
    return scan.value_at(t, BY, ORDER, "px", "place", "there").select("event_id", "there")


@query("global_rank", "SELECT event_id, rank() OVER (ORDER BY px % 500) + (count(*) OVER (PARTITION BY px % 500) - 1) / 2.0 AS rnk FROM $TICKS")
def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).select("event_id", (F.col("px") % 500).alias("v"))
    return scan.global_rank(t, "v", "rnk").select("event_id", F.col("rnk").cast("double").alias("rnk"))


@query("daily_ends", "SELECT symbol, day, arg_min(px, (ts, event_id)) AS px_first, arg_max(px, (ts, event_id)) AS px_last FROM $TICKS GROUP BY ALL")
def daily_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.ends(ticks(spark, sf_dir), DAY, ORDER, ["px"])


@query("long_quantile", "SELECT 'px' AS name, quantile_cont(px::DOUBLE, 0.95) AS quantile FROM $TICKS UNION ALL SELECT 'vol', quantile_cont(vol::DOUBLE, 0.95) FROM $TICKS")
def long_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.long_quantile(ticks(spark, sf_dir), ["event_id"], ["px", "vol"], 0.95)


@query("fact_scan", "SELECT event_id, symbol, vol FROM $TICKS WHERE symbol IN ('click', 'view') AND day BETWEEN '2024-01-03' AND '2024-01-09' AND (vol > 100 OR user_id % 7 = 0)")
def fact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relational.facts(ticks(spark, sf_dir), {"symbol": ["click", "view"], "user_id": "all"}, "day", "2024-01-03", "2024-01-09", [F.col("vol") > 100, F.col("user_id") % 7 == 0])
    return t.select("event_id", "symbol", "vol")


@query("interaction", """
    WITH j AS (SELECT symbol AS a, vol % 4 AS b, px % 3 AS c, count(*)::DOUBLE AS n FROM $TICKS GROUP BY ALL),
    t AS (SELECT n, sum(n) OVER () AS w, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER (PARTITION BY a, b) AS ab, sum(n) OVER (PARTITION BY a, c) AS ac, sum(n) OVER (PARTITION BY b, c) AS bc FROM j)
    SELECT round(sum(n / w * (ln(n) - ln(ab) - ln(ac) - ln(bc) + ln(na) + ln(nb) + ln(nc) - ln(w))), 6) AS interaction FROM t
""")
def interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumns({"b": F.col("vol") % 4, "c": F.col("px") % 3})
    return model.interaction(t, "symbol", "b", "c").select(F.round("interaction", 6).alias("interaction"))


@query("spaced_backtest", f"""
    WITH RECURSIVE s AS (
        SELECT *, CASE WHEN r IS NULL OR NOT cond THEN 0 ELSE event_id % 3 - 1 END AS signal, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS p FROM {PLAYS_SQL}
    ),
    c AS (SELECT symbol, p FROM s WHERE signal <> 0),
    walk AS (
        SELECT symbol, min(p) AS p FROM c GROUP BY symbol
        UNION ALL
        SELECT w.symbol, (SELECT min(c.p) FROM c WHERE c.symbol = w.symbol AND c.p >= w.p + 10) AS p FROM walk AS w WHERE w.p IS NOT NULL
    ),
    t AS (SELECT s.symbol, s.p, w.p IS NOT NULL AS taken, CASE WHEN w.p IS NOT NULL THEN sign(signal) * r END AS y FROM s LEFT JOIN walk AS w USING (symbol, p))
    SELECT symbol, count(y) AS n_plays, sum(y)::BIGINT AS r_sum, round(avg(y), 4) AS r_mean, count_if(taken) AS exch_count, round(avg(taken::INT), 6) AS exch_ratio FROM t GROUP BY symbol
""")
def spaced_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-overlapping plays per series."""
    t = plays(spark, sf_dir).withColumn("signal", F.when(F.col("cond"), F.col("event_id") % 3 - 1).otherwise(0))
    out = backtest.spaced_backtest(t, BY, ORDER, "signal", "r", 10)
    return out.select("symbol", "n_plays", "r_sum", F.round("r_mean", 4).alias("r_mean"), F.col("exch_count").cast("long").alias("exch_count"), F.round("exch_ratio", 6).alias("exch_ratio"))


@query("scorecard")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KS and AUC of a fitted scorecard on its three parts; the stepwise fit has no SQL twin."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("e"), F.col("l_discount").cast("double").alias("d"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
    card = model.scorecard(items, ["q", "e", "d"], "y", "l_orderkey", 10, 50, 2)
    return spark.createDataFrame([(part, float(m["ks"] or 0), float(m["auc"] or 0)) for part, m in card["report"].items()], "part string, ks double, auc double")


@query("scorecard_counts", """
    WITH v AS (SELECT l_quantity AS q, l_extendedprice AS e, (l_returnflag = 'R')::INT AS y, l_linenumber AS n, l_discount AS d FROM lineitem),
    r AS (SELECT 'q' AS c, q AS x, row_number() OVER (ORDER BY q) - 1 AS p, count(*) OVER () AS n FROM v WHERE n <= 3 UNION ALL SELECT 'e', e, row_number() OVER (ORDER BY e) - 1, count(*) OVER () FROM v WHERE n <= 3),
    t AS (SELECT DISTINCT c, x FROM r, range(0, 6) AS k(k) WHERE p = round_even((n - 1) * k / 5.0, 0)),
    b AS (SELECT c, lag(x) OVER w AS lo, x AS hi, (row_number() OVER w - 2)::INT AS bin FROM t WINDOW w AS (PARTITION BY c ORDER BY x)),
    long AS (SELECT 'q' AS c, q AS x, y, n, d FROM v UNION ALL SELECT 'e', e, y, n, d FROM v),
    placed AS (SELECT long.c, bin, y, n, d FROM long LEFT JOIN b ON b.c = long.c AND lo IS NOT NULL AND (x > lo OR bin = 0 AND x >= lo) AND x <= hi),
    s AS (SELECT c, 'all' AS sample, bin, y FROM placed UNION ALL SELECT c, 'fit', bin, y FROM placed WHERE n <= 3 UNION ALL SELECT c, 'cheap', bin, y FROM placed WHERE d > 0.05)
    SELECT c AS column, sample, bin, count(*) AS cnt, sum(y)::BIGINT AS bad, (count(*) - sum(y))::BIGINT AS good FROM s GROUP BY GROUPING SETS ((c, sample, bin), (c, sample)) HAVING GROUPING(bin) = 1 OR bin IS NOT NULL
""")
def scorecard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges fitted on one sample, counted for every overlapping sample in one pass by grouping sets."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("e"), (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_linenumber", "l_discount"
    )
    fitted = items.filter("l_linenumber <= 3")
    bins = {c: binning.binned(fitted, c, binning.Woe("y"), 5) for c in ("q", "e")}
    return model.sample_counts(items, bins, "y", {"fit": F.col("l_linenumber") <= 3, "cheap": F.col("l_discount") > 0.05})


def steady(name: str) -> Column:
    """Four digits, after a shift that takes halves, which a last bit decides otherwise, to one side."""
    return F.round(F.col(name) + 1e-7, 4).alias(name)


def sweep_sql(periods: tuple[int, ...]) -> str:
    """Recursive rows with a state per period: the means, then what is made of them, then the means of that."""
    grid, one = indicators.macd_grid(periods), "1.0::DOUBLE"
    signals = sorted({max(g, 1) for _, _, g in grid})
    rate = lambda k, n, alpha: f"CASE WHEN {k} <= {n} THEN {one} / ({k}) ELSE {alpha}::DOUBLE END"
    first = [f"r.e{n} + (x.c - r.e{n}) * {rate('x.i', n, 2 / (n + 1))} AS e{n}" for n in periods]
    first += [f"r.{k} + (x.c - r.{k}) * {rate('x.i', n, alpha)} AS {k}" for k, n, alpha in (("fa", 12, 0.15), ("fb", 26, 0.075))]
    first += [f"r.{k}{n} + (x.{v} - r.{k}{n}) / least(x.i - 1, {n})::DOUBLE AS {k}{n}" for n in periods for k, v in (("t", "tr"), ("p", "pm"), ("m", "mm"))]
    kept = [*(f"ax{n}" for n in periods), *(f"k{n}" for n in periods), *(f"g{f}_{s}" for f, s, _ in grid), *(f"h{n}" for n in signals)]
    made = [f"CASE WHEN i > {n} AND t{n} <> 0 AND p{n} + m{n} <> 0 THEN 100 * abs(100 * p{n} / t{n} - 100 * m{n} / t{n}) / (100 * p{n} / t{n} + 100 * m{n} / t{n}) END AS dx{n}" for n in periods]
    again = [f"CASE WHEN i < {s} THEN 0 ELSE g{f}_{s} + (e{f} - e{s} - g{f}_{s}) * {rate(f'i - {s - 1}', max(g, 1), 2 / (max(g, 1) + 1))} END AS g{f}_{s}" for f, s, g in grid]
    again += [f"CASE WHEN i < 26 THEN 0 ELSE h{n} + (fa - fb - h{n}) * {rate('i - 25', n, 2 / (n + 1))} END AS h{n}" for n in signals]
    again += [f"CASE WHEN dx{n} IS NULL THEN ax{n} ELSE ax{n} + (dx{n} - ax{n}) / least(k{n} + 1, {n})::DOUBLE END AS ax{n}" for n in periods] + [f"k{n} + (dx{n} IS NOT NULL)::INT AS k{n}" for n in periods]
    means = [*(f"e{n}" for n in periods), "fa", "fb", *(f"{k}{n}" for n in periods for k in "tpm")]
    order = [*means, *(f"g{f}_{s}" for f, s, _ in grid), *(f"h{n}" for n in signals), *(f"ax{n}" for n in periods), *(f"k{n}" for n in periods)]
    start = ", ".join(f"{'c' if k[0] == 'e' or k[0] == 'f' else '0' if k[0] == 'k' else '0.0::DOUBLE'} AS {k}" for k in order)
    out = [f"CASE WHEN i >= {n} THEN e{n} - c END AS EMA_{n}" for n in periods]
    for n in periods:
        out += [f"CASE WHEN k{n} >= {n} THEN ax{n} END AS ADX_{n}", f"CASE WHEN i > {n} THEN t{n} END AS ATR_{n}"]
        out += [f"CASE WHEN i > {n} THEN {n} * {k}{n} END AS {name}_DM_{n}" for k, name in (("p", "PLUS"), ("m", "MINUS"))]
        out += [f"CASE WHEN i > {n} AND t{n} <> 0 THEN 100 * {k}{n} / t{n} END AS {name}_DI_{n}" for k, name in (("p", "PLUS"), ("m", "MINUS"))]
    for f, s, g in grid:
        out += [f"CASE WHEN i >= {s} THEN e{f} - e{s} END AS MACD_{f}_{s}", f"CASE WHEN i >= {s + max(g, 1) - 1} THEN e{f} - e{s} - g{f}_{s} END AS MACD_hist_{f}_{s}"]
    out += [f"CASE WHEN i >= {25 + n} THEN fa - fb - h{n} END AS MACDFIX_hist_{n}" for n in signals]
    names = [o.rpartition(" AS ")[2] for o in out]
    return f"""
        WITH RECURSIVE b AS MATERIALIZED (
            SELECT symbol, bucket, high::DOUBLE AS h, low::DOUBLE AS l, close::DOUBLE AS c, row_number() OVER w AS i, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1 FROM {BARS_SQL} WINDOW w AS (PARTITION BY symbol ORDER BY bucket)
        ),
        x AS MATERIALIZED (
            SELECT symbol, bucket, i, c, greatest(h - l, abs(h - c1), abs(l - c1)) AS tr, CASE WHEN h - h1 > l1 - l AND h - h1 > 0 THEN h - h1 ELSE 0 END AS pm, CASE WHEN l1 - l > h - h1 AND l1 - l > 0 THEN l1 - l ELSE 0 END AS mm FROM b
        ),
        r AS (
            SELECT symbol, bucket, i, c, {start} FROM x WHERE i = 1
            UNION ALL
            SELECT symbol, bucket, i, c, {", ".join([*means, *again])} FROM (SELECT *, {", ".join(made)} FROM (SELECT x.symbol, x.bucket, x.i, x.c, {", ".join([*first, *(f"r.{k}" for k in kept)])} FROM r JOIN x ON x.symbol = r.symbol AND x.i = r.i + 1))
        ),
        o AS (SELECT symbol, bucket, {", ".join(out)} FROM r)
        SELECT symbol, bucket, {", ".join(f"round({n} + 1e-7, 4) AS {n}" for n in names)} FROM o
    """


@query("indicator_sweep", sweep_sql((5, 10, 20)))
def indicator_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directional indicators, distances of means and lines at several periods."""
    out = indicators.with_sweep(hourly(spark, sf_dir), ["symbol"], ["bucket"], (5, 10, 20))
    return out.select("symbol", "bucket", *[steady(c) for c in indicators.sweep_values((5, 10, 20))])


@query("position_sweep", f"""
    WITH b AS (SELECT *, (high + low + close) / 3.0 AS tp, row_number() OVER w AS i FROM {BARS_SQL} WINDOW w AS (PARTITION BY symbol ORDER BY bucket)),
    p AS (SELECT unnest([5, 14]) AS n),
    w AS (SELECT b.symbol, b.bucket, b.tp, n, count(*) AS c, avg(a.tp) AS m, list(a.tp) AS x FROM b CROSS JOIN p JOIN b AS a ON a.symbol = b.symbol AND a.i BETWEEN b.i - n + 1 AND b.i GROUP BY b.symbol, b.bucket, b.tp, n),
    c AS (SELECT symbol, bucket, n, CASE WHEN c = n THEN round((tp - m) / nullif(0.015 * list_sum(list_transform(x, lambda t: abs(t - m))) / n, 0), 6) END AS cci FROM w),
    o AS (SELECT b.symbol, b.bucket, n, CASE WHEN count(*) = n + 1 THEN round((arg_max(a.i, (a.high, a.i)) - arg_max(a.i, (-a.low, a.i))) * 100.0 / n, 6) END AS osc FROM b CROSS JOIN p JOIN b AS a ON a.symbol = b.symbol AND a.i BETWEEN b.i - n AND b.i GROUP BY b.symbol, b.bucket, n)
    SELECT symbol, bucket, max(cci) FILTER (n = 5) AS CCI_5, max(cci) FILTER (n = 14) AS CCI_14, max(osc) FILTER (n = 5) AS AROONOSC_5, max(osc) FILTER (n = 14) AS AROONOSC_14 FROM c JOIN o USING (symbol, bucket, n) GROUP BY symbol, bucket
""")
def position_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{k}_{n}" for k in ("CCI", "AROONOSC") for n in (5, 14)]
    out = indicators.position_sweep(hourly(spark, sf_dir), ["symbol"], ["bucket"], (5, 14))
    return out.select("symbol", "bucket", *[F.round(c, 6).alias(c) for c in names])


@query("macdext_sweep", f"""
    WITH b AS (SELECT *, row_number() OVER w AS i FROM {BARS_SQL} WINDOW w AS (PARTITION BY symbol ORDER BY bucket)),
    m AS (SELECT *, CASE WHEN i >= 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING) - avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING) END AS line FROM b),
    s AS (SELECT *, CASE WHEN count(line) OVER w = 3 THEN avg(line) OVER w END AS signal, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 2 PRECEDING))
    SELECT symbol, bucket, before AS open, round(line, 6) AS MACDEXT_5_20, round(signal, 6) AS MACDEXT_signal_5_20, round(line - signal, 6) AS MACDEXT_hist_5_20 FROM s
""")
def macdext_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of plain-mean lines, beside the close before as open."""
    bars_ = indicators.with_open(hourly(spark, sf_dir), ["symbol"], ["bucket"])
    out = indicators.macdext_sweep(bars_, ["symbol"], ["bucket"], (5, 20))
    return out.select("symbol", "bucket", "open", *[F.round(c, 6).alias(c) for c in ("MACDEXT_5_20", "MACDEXT_signal_5_20", "MACDEXT_hist_5_20")])


@query("market_sides", """
    WITH g AS (SELECT event_id, symbol, day, ts, vol, vol * mid + event_id * 3 % (vol + 1) AS amt, coalesce(lag(AP1) OVER w, AP1) AS a, coalesce(lag(BP1) OVER w, BP1) AS b FROM $BOOK WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id)),
    m AS (SELECT *, CASE WHEN a <> b THEN least(greatest((amt - vol * b)::DOUBLE / (a - b), 0), vol) END AS buy FROM g)
    SELECT event_id, round(buy, 6) AS market_buy, round(vol - buy, 6) AS market_sell, round(sum(coalesce(buy, 0)) OVER w, 4) AS market_buy_sum, round(sum(coalesce(vol - buy, 0)) OVER w, 4) AS market_sell_sum
    FROM m WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def market_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = book.with_market_sides(books(spark, sf_dir), DAY, ORDER)
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("market_buy", "market_sell")], *[F.round(c, 4).alias(c) for c in ("market_buy_sum", "market_sell_sum")])


@query("session_edges", """
    WITH s AS (SELECT event_id, symbol, day, ts, vol, 'day' || event_id % 4 AS session FROM $TICKS),
    p AS (SELECT *, '' AS p0, CASE session WHEN 'day0' THEN 'night' WHEN 'day3' THEN 'afternoon' ELSE 'morning' END AS p1, CASE session WHEN 'day0' THEN 'night' ELSE 'day' END AS p2 FROM s),
    e AS (SELECT *, row_number() OVER (PARTITION BY symbol, day, p0 ORDER BY ts, event_id) AS b0, count(*) OVER (PARTITION BY symbol, day, p0) AS c0, row_number() OVER (PARTITION BY symbol, day, p1 ORDER BY ts, event_id) AS b1, count(*) OVER (PARTITION BY symbol, day, p1) AS c1,
          row_number() OVER (PARTITION BY symbol, day, p2 ORDER BY ts, event_id) AS b2, count(*) OVER (PARTITION BY symbol, day, p2) AS c2 FROM p)
    SELECT event_id, b0::INT AS from_begin0, c0 - b0 + 1 AS to_end0, b1::INT AS from_begin1, c1 - b1 + 1 AS to_end1, b2::INT AS from_begin2, c2 - b2 + 1 AS to_end2, CASE WHEN b1 > 10 THEN vol END AS x, CASE WHEN c1 - b1 + 1 > 6 THEN vol END AS y FROM e
""")
def session_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to the ends of a day's parts for the three split types, and columns erased near them."""
    t = ticks(spark, sf_dir).withColumn("session", F.concat(F.lit("day"), (F.col("event_id") % 4).cast("string"))).withColumns({"x": F.col("vol"), "y": F.col("vol")})
    out = relational.erase_split(relational.with_edges(t, DAY, "session", ORDER), {"x": 20}, {"y": 12}, 1)
    return out.select("event_id", *[f"{n}{k}" for k in range(3) for n in ("from_begin", "to_end")], "x", "y")


#: A row's state from the row before: each mean moves by 1 / k up to its seed, by its own rate after it.
SMOOTHED_SQL = f"""
    WITH RECURSIVE b AS MATERIALIZED (
        SELECT symbol, bucket, high::DOUBLE AS h, low::DOUBLE AS l, close::DOUBLE AS c, row_number() OVER w AS i, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1 FROM {BARS_SQL} WINDOW w AS (PARTITION BY symbol ORDER BY bucket)
    ),
    x AS MATERIALIZED (
        SELECT symbol, bucket, i, c, greatest(c - c1, 0) AS up, greatest(c1 - c, 0) AS down, greatest(h - l, abs(h - c1), abs(l - c1)) AS tr,
               CASE WHEN h - h1 > l1 - l AND h - h1 > 0 THEN h - h1 ELSE 0 END AS pm, CASE WHEN l1 - l > h - h1 AND l1 - l > 0 THEN l1 - l ELSE 0 END AS mm FROM b
    ),
    r AS (
        SELECT symbol, bucket, i, c, c AS e30, c AS e12, c AS e26, 0.0::DOUBLE AS e2, 0.0::DOUBLE AS e3, 0.0::DOUBLE AS sg, 0.0::DOUBLE AS u, 0.0::DOUBLE AS d, 0.0::DOUBLE AS t, 0.0::DOUBLE AS p, 0.0::DOUBLE AS m, NULL::DOUBLE AS dx, 0.0::DOUBLE AS ax, 0 AS k FROM x WHERE i = 1
        UNION ALL
        SELECT symbol, bucket, i, c, e30, e12, e26, e2, e3, sg, u, d, t, p, m, dx, CASE WHEN dx IS NULL THEN ax ELSE ax + (dx - ax) * CASE WHEN k < 14 THEN 1.0::DOUBLE / (k + 1) ELSE 1.0::DOUBLE / 14 END END, k + (dx IS NOT NULL)::INT FROM (
            SELECT *, CASE WHEN i >= 15 AND t <> 0 AND p + m <> 0 THEN 100 * abs(100 * p / t - 100 * m / t) / (100 * p / t + 100 * m / t) END AS dx FROM (
                SELECT *, CASE WHEN i < 59 THEN 0 ELSE e3o + (e2 - e3o) * CASE WHEN i - 58 <= 30 THEN 1.0::DOUBLE / (i - 58) ELSE 2.0::DOUBLE / 31 END END AS e3 FROM (
                    SELECT *, CASE WHEN i < 30 THEN 0 ELSE e2o + (e30 - e2o) * CASE WHEN i - 29 <= 30 THEN 1.0::DOUBLE / (i - 29) ELSE 2.0::DOUBLE / 31 END END AS e2,
                           CASE WHEN i < 26 THEN 0 ELSE sgo + (e12 - e26 - sgo) * CASE WHEN i - 25 <= 9 THEN 1.0::DOUBLE / (i - 25) ELSE 0.2::DOUBLE END END AS sg FROM (
                        SELECT x.symbol, x.bucket, x.i, x.c, r.e2 AS e2o, r.e3 AS e3o, r.sg AS sgo, r.ax, r.k,
                               r.e30 + (x.c - r.e30) * CASE WHEN x.i <= 30 THEN 1.0::DOUBLE / x.i ELSE 2.0::DOUBLE / 31 END AS e30, r.e12 + (x.c - r.e12) * CASE WHEN x.i <= 12 THEN 1.0::DOUBLE / x.i ELSE 2.0::DOUBLE / 13 END AS e12,
                               r.e26 + (x.c - r.e26) * CASE WHEN x.i <= 26 THEN 1.0::DOUBLE / x.i ELSE 2.0::DOUBLE / 27 END AS e26, r.u + (x.up - r.u) / least(x.i - 1, 14)::DOUBLE AS u, r.d + (x.down - r.d) / least(x.i - 1, 14)::DOUBLE AS d,
                               r.t + (x.tr - r.t) / least(x.i - 1, 14)::DOUBLE AS t, r.p + (x.pm - r.p) / least(x.i - 1, 14)::DOUBLE AS p, r.m + (x.mm - r.m) / least(x.i - 1, 14)::DOUBLE AS m
                        FROM r JOIN x ON x.symbol = r.symbol AND x.i = r.i + 1
                    )
                )
            )
        )
    ),
    o AS (
        SELECT symbol, bucket, CASE WHEN i >= 30 THEN e30 END AS EMA, CASE WHEN i >= 59 THEN 2 * e30 - e2 END AS DEMA, CASE WHEN i >= 88 THEN 3 * e30 - 3 * e2 + e3 END AS TEMA, CASE WHEN i >= 26 THEN e12 - e26 END AS MACD,
               CASE WHEN i >= 34 THEN sg END AS MACD_signal, CASE WHEN i >= 15 AND u + d <> 0 THEN 100 * u / (u + d) END AS RSI, CASE WHEN i >= 15 AND u + d <> 0 THEN 100 * (u - d) / (u + d) END AS CMO, CASE WHEN i >= 15 THEN t END AS ATR,
               CASE WHEN i >= 15 AND c <> 0 THEN 100 * t / c END AS NATR, CASE WHEN i >= 15 AND t <> 0 THEN 100 * p / t END AS PLUS_DI, CASE WHEN i >= 15 AND t <> 0 THEN 100 * m / t END AS MINUS_DI, dx AS DX, CASE WHEN k >= 14 THEN ax END AS ADX,
               CASE WHEN i >= 89 THEN 100 * (e3 / nullif(lag(e3) OVER (PARTITION BY symbol ORDER BY i), 0) - 1) END AS TRIX FROM r
    )
    SELECT symbol, bucket, {", ".join(f"round({c} + 1e-7, 4) AS {c}" for c in ("EMA", "DEMA", "TEMA", "MACD", "MACD_signal", "RSI", "CMO", "ATR", "NATR", "PLUS_DI", "MINUS_DI", "DX", "ADX", "TRIX"))} FROM o
"""
SMOOTHED = ["EMA", "DEMA", "TEMA", "MACD", "MACD_signal", "RSI", "CMO", "ATR", "NATR", "PLUS_DI", "MINUS_DI", "DX", "ADX", "TRIX"]


@query("indicators_smoothed", SMOOTHED_SQL)
def indicators_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indicators of smoothed means, over ranges of a series."""
    out = indicators.with_smoothed(hourly(spark, sf_dir), ["symbol"], ["bucket"], SMOOTHED)
    return out.select("symbol", "bucket", *[steady(c) for c in SMOOTHED])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with the returns to the next and the third bar."""
    b = hourly(spark, sf_dir).withColumn("day", F.to_date(F.timestamp_seconds(F.col("bucket") * 3600)))
    return bars.forward_returns(b, ["symbol"], "day", ["bucket"], {False: "close"}, [("T1", 1), ("T3", 3)])


__all__ = ["QUERIES", "ORACLE_SQL", "flagship", "streaming_bars"]


LADDER_SQL = "SELECT event_id, unnest([{s}P1, {s}P2, {s}P3, {s}P4, {s}P5]) AS p, unnest([{s}V1, {s}V2, {s}V3, {s}V4, {s}V5]) AS now, 0 AS was FROM $BOOK UNION ALL SELECT event_id, unnest(p), 0, unnest(v) FROM l{s}"


@query("ladder_changes", f"""
    WITH lA AS (SELECT event_id, coalesce(lag([AP1, AP2, AP3, AP4, AP5]) OVER w, [AP1, AP2, AP3, AP4, AP5]) AS p, coalesce(lag([AV1, AV2, AV3, AV4, AV5]) OVER w, [0, 0, 0, 0, 0]) AS v FROM $BOOK WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id)),
    lB AS (SELECT event_id, coalesce(lag([BP1, BP2, BP3, BP4, BP5]) OVER w, [BP1, BP2, BP3, BP4, BP5]) AS p, coalesce(lag([BV1, BV2, BV3, BV4, BV5]) OVER w, [0, 0, 0, 0, 0]) AS v FROM $BOOK WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, event_id)),
    a AS (SELECT event_id, p, sum(now)::BIGINT AS now, sum(was)::BIGINT AS was FROM ({LADDER_SQL.format(s="A")}) GROUP BY ALL),
    b AS (SELECT event_id, p, sum(now)::BIGINT AS now, sum(was)::BIGINT AS was FROM ({LADDER_SQL.format(s="B")}) GROUP BY ALL),
    ea AS (SELECT event_id, least(AP5, lA.p[5]) AS e FROM $BOOK AS k JOIN lA USING (event_id)), eb AS (SELECT event_id, greatest(BP5, lB.p[5]) AS e FROM $BOOK AS k JOIN lB USING (event_id))
    SELECT 'ask' AS side, event_id, p AS price, now - was AS change, p <= e AS known FROM a JOIN ea USING (event_id) UNION ALL SELECT 'bid', event_id, p, now - was, p >= e FROM b JOIN eb USING (event_id)
""")
def ladder_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each price's resting volume changed by since the last snapshot; beyond the nearer fifth level it isn't known."""
    b = books(spark, sf_dir)
    sides = []
    for side, name, down in (("A", "ask", False), ("B", "bid", True)):
        now, was = microstructure.level_ladder(side), microstructure.level_ladder(side, True)
        changes = [microstructure.merge_ladders(now, was, -1, bounded, down) for bounded in (False, True)]
        rows = b.select("event_id", F.lit(name).alias("side"), changes[0].alias("x"), F.size(changes[1]).alias("n")).select("side", "event_id", "n", F.posexplode("x").alias("i", "x"))
        sides.append(rows.select("side", "event_id", F.col("x.key").alias("price"), F.col("x.value").alias("change"), (F.col("i") < F.col("n")).alias("known")))
    return sides[0].unionByName(sides[1])
