"""Order-book reconstruction from five-level snapshots.

Input columns: BP1..5, BV1..5 (bids, best first), AP1..5, AV1..5 (asks, best first), all integer
ticks, each with a `_last` column of the previous snapshot (`scan.lag_reset`), and vol, amt traded
since then. Books are price-volume maps (`functions.pvmap`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.functions import pvmap as pv

LEVELS = range(1, 6)


def _side(side: str, last: bool = False) -> Column:
    tail = "_last" if last else ""
    return pv.populated_levels([F.col(f"{side}P{i}{tail}") for i in LEVELS], [F.col(f"{side}V{i}{tail}") for i in LEVELS])


def with_maps(df: DataFrame) -> DataFrame:
    """D_ask, D_bid and their `_last` (empty where the last best bid is -1), and the decrease last - now."""
    known = F.col("BP1_last") != -1
    df = df.withColumns({
        "D_ask": _side("A"), "D_bid": _side("B"),
        "D_ask_last": F.when(known, _side("A", True)).otherwise(pv.empty()), "D_bid_last": F.when(known, _side("B", True)).otherwise(pv.empty()),
    })
    return df.withColumns({f"D_{s}_diff": pv.subtract(F.col(f"D_{s}_last"), F.col(f"D_{s}")) for s in ("ask", "bid")})


def with_sums(df: DataFrame) -> DataFrame:
    """Cumulative volumes from the best price on (of decreases without negatives), and amounts of the last books."""
    new: dict[str, Column] = {}
    for s, down in (("ask", False), ("bid", True)):
        new[f"D_{s}_cumsum"] = pv.cumulate(F.col(f"D_{s}"), down)
        new[f"D_{s}_last_cumsum"] = pv.cumulate(F.col(f"D_{s}_last"), down)
        new[f"D_{s}_diff_cumsum"] = pv.cumulate(F.col(f"D_{s}_diff"), down, clipped=True)
        new[f"D_{s}_last_acumsum"] = pv.cumulate(F.col(f"D_{s}_last"), down, amount=True)
    return df.withColumns(new)


def with_bounds(df: DataFrame, slack: int = 150) -> DataFrame:
    """Farthest prices that the traded volume can have reached: levels whose cumulative volume is at most 2 vol + slack."""
    reach = 2 * F.col("vol") + slack
    a5, b5 = F.least("AP5_last", "AP5"), F.greatest("BP5_last", "BP5")
    a0, b0 = F.least(F.greatest("AP1_last", "AP1"), a5), F.greatest(F.least("BP1_last", "BP1"), b5)
    a1, b1 = F.least(a0 + 4, a5 + 1), F.greatest(b0 - 4, b5 - 1)
    asks = F.when(a0 < a1, F.sequence(a0, a1 - 1)).otherwise(F.array().cast("array<bigint>"))
    bids = F.when(b0 > b1, F.sequence(b1 + 1, b0)).otherwise(F.array().cast("array<bigint>"))
    within = lambda prices, m: pv.let(F.col(m), lambda m: F.size(F.filter(prices, lambda k: pv.get(m, k) <= reach)))
    return df.withColumns({"ask_bound": a0 + within(asks, "D_ask_last_cumsum"), "bid_bound": b0 - within(bids, "D_bid_last_cumsum")})


def split_trades(vol: Column, amt: Column, ask_bound: Column, bid_bound: Column) -> Column:
    """Traded volume per price that explains vol and amt best, by a search over two border prices.

    A candidate is a low and a high border around the mean price. What rests between them is taken
    to be traded; the borders share the rest so that volume (and, for neighbours, amount) agrees. Its
    score: volume that left the book at the traded prices, less what should have been traded
    outside the borders and less what the borders left standing. Equal scores prefer the narrower
    pair, then the lower low border. Without candidate: empty.

    A cell is a price that can be a border, with sums of what rests below it. Pairs are first held against
    volume and amount, by these sums alone; only those that fit are looked up in the books and scored.
    """
    none = F.lit(0).cast("bigint")
    vol, amt = F.coalesce(vol, none).cast("bigint"), F.coalesce(amt, none).cast("bigint")
    book, last = ({s: F.col(f"D_{s}{tail}") for s in ("ask", "bid")} for tail in ("", "_last"))
    sums, last_sums = ({s: F.col(f"D_{s}{tail}_cumsum") for s in ("ask", "bid")} for tail in ("", "_last"))

    def left(p: Column) -> Column:
        return F.greatest(pv.get(last["ask"], p) - pv.get(book["ask"], p), none) + F.greatest(pv.get(last["bid"], p) - pv.get(book["bid"], p), none)

    def below(p: Column) -> Column:
        return pv.get(last_sums["ask"], p - 1) + pv.get(sums["bid"], p + 1)

    def above(p: Column) -> Column:
        return pv.get(last_sums["bid"], p + 1) + pv.get(sums["ask"], p - 1)

    def cells(e: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            cell = F.struct(c["p"].alias("p"), c["rest"].alias("rest"), acc["n"].alias("n"), acc["t"].alias("t"))
            return F.struct((acc["n"] + c["rest"]).alias("n"), (acc["t"] + c["p"] * c["rest"]).alias("t"), F.array_append(acc["cells"], cell).alias("cells"))

        rests = F.transform(F.sequence(e["low"], e["high"]), lambda p: F.struct(p.alias("p"), (pv.get(last["ask"], p) + pv.get(last["bid"], p)).alias("rest")))
        start = F.struct(none.alias("n"), none.alias("t"), F.array().cast("array<struct<p:bigint,rest:bigint,n:bigint,t:bigint>>").alias("cells"))
        return F.aggregate(rests, start, step, lambda acc: acc["cells"])

    def part(e: Column, all_cells: Column, first: Column, size: Column) -> Column:
        return F.slice(all_cells, (first - e["low"] + 1).cast("int"), size.cast("int"))

    def scored(e: Column, all_cells: Column, low: Column, c: Column) -> Column:
        v, a = low["v"] - c["n"], low["a"] - c["t"]

        def judged(v1: Column) -> Column:
            v2 = v - v1
            between = F.aggregate(part(e, all_cells, low["p"] + 1, c["p"] - low["p"] - 1), none, lambda acc, x: acc + left(x["p"]))
            prize = F.least(v1, left(low["p"])) + F.least(v2, left(c["p"])) + between
            standing = F.greatest(pv.get(last["ask"], low["p"]) - v1, none) + F.greatest(pv.get(last["bid"], c["p"]) - v2, none)
            return F.struct((prize - standing - below(low["p"]) - above(c["p"])).alias("score"), (low["p"] - c["p"]).alias("width"), (-low["p"]).alias("down"), v1.alias("v1"), v2.alias("v2"))

        return pv.let(F.call_function("div", c["p"] * v - a, c["p"] - low["p"]), judged)

    def pairs(e: Column, all_cells: Column) -> Column:
        def of(highs: Column, low: Column) -> Column:
            def fits(c: Column) -> Column:
                v, a = low["v"] - c["n"], low["a"] - c["t"]
                return (c["n"] < low["v"]) & (c["p"] > low["p"]) & (low["p"] * v < a) & (a < c["p"] * v)

            return F.transform(F.filter(highs, fits), lambda c: scored(e, all_cells, low, c))

        lows = F.transform(part(e, all_cells, e["low"], e["mean"] - e["low"] + 1), lambda c: F.struct(
            c["p"].alias("p"), (e["vol"] + c["n"] + c["rest"]).alias("v"), (e["amt"] + c["t"] + c["p"] * c["rest"]).alias("a"),
        ))
        return pv.let(part(e, all_cells, e["up"], e["high"] - e["up"] + 1), lambda highs: F.flatten(F.transform(lows, lambda low: of(highs, low))))

    def single(e: Column) -> Column:
        p, vol = e["mean"], e["vol"]
        one = F.struct((F.least(vol, left(p)) - below(p) - above(p)).alias("score"), none.alias("width"), (-p).alias("down"), vol.alias("v1"), none.alias("v2"))
        return F.when(p == e["up"], F.array(one)).otherwise(F.array().cast("array<struct<score:bigint,width:bigint,down:bigint,v1:bigint,v2:bigint>>"))

    def traded(e: Column, all_cells: Column, best: Column) -> Column:
        low, high = -best["down"], -best["down"] - best["width"]
        inside = part(e, all_cells, low, high - low + 1)
        amounts = F.transform(inside, lambda c: F.struct(c["p"].alias("key"), F.when(c["p"] == low, best["v1"]).when(c["p"] == high, best["v2"]).otherwise(c["rest"]).alias("value")))
        return F.when(best.isNull(), pv.empty()).otherwise(F.map_from_entries(F.filter(amounts, lambda x: x["value"] != 0)))

    some = F.when(vol > 0, vol)
    mean = F.call_function("div", amt - F.pmod(amt, some), some)
    up = mean + F.when(F.pmod(amt, some) > 0, 1).otherwise(0)
    env = F.struct(
        vol.alias("vol"), amt.alias("amt"), mean.alias("mean"), up.alias("up"), F.least(mean, bid_bound.cast("bigint")).alias("low"), F.greatest(up, ask_bound.cast("bigint")).alias("high"),
    )
    found = pv.let(env, lambda e: pv.let(cells(e), lambda c: pv.let(F.array_max(F.concat(pairs(e, c), single(e))), lambda best: traded(e, c, best))))
    return F.when((vol > 0) & ask_bound.isNotNull() & bid_bound.isNotNull(), found).otherwise(pv.empty())


def with_trades(df: DataFrame) -> DataFrame:
    """D_exch: traded volume per price of each tick, from the books, their sums and the bounds."""
    return df.withColumn("D_exch", split_trades(F.col("vol"), F.col("amt"), F.col("ask_bound"), F.col("bid_bound")))


def with_orders(df: DataFrame) -> DataFrame:
    """Added and cancelled volume of each side, and trades against asks, bids and between, old and new orders."""
    exch = F.col("D_exch")
    best = {"ask": (F.col("AP1_last"), None), "bid": (None, F.col("BP1_last"))}
    edge = {"ask": (None, F.least("AP5_last", "AP5")), "bid": (F.greatest("BP5_last", "BP5"), None)}
    change = {f"D_{s}_change": pv.nonzero(pv.clip(pv.subtract(pv.add(exch, F.col(f"D_{s}")), F.col(f"D_{s}_last")), *edge[s])) for s in ("ask", "bid")}
    dealt = {f"D_{s}_exch": pv.clip(exch, *best[s]) for s in ("ask", "bid")}
    old = {f"D_{s}_old": pv.positive(pv.minimum(F.col(f"D_{s}_last"), exch)) for s in ("ask", "bid")}
    mid = {"D_mid_exch": pv.clip(exch, F.col("BP1_last") + 1, F.col("AP1_last") - 1)}
    df = df.withColumns(change | dealt | old | mid)  # columns of their own: each is computed once, however often it is used
    new: dict[str, Column] = {}
    for s in ("ask", "bid"):
        change, dealt, old = (F.col(f"D_{s}_{c}") for c in ("change", "exch", "old"))
        new |= {f"D_{s}_add": pv.positive(change), f"D_{s}_cancel": pv.negate(pv.negative(change)), f"D_{s}_new": pv.positive(pv.deduct(dealt, old))}
    return df.withColumns(new)


def mid_price(level: int = 1) -> Column:
    """Mean of both prices of a level; of a single valid one (0 < price < 1e7) that one."""
    a, b = F.col(f"AP{level}"), F.col(f"BP{level}")
    ok = lambda p: (p > 0) & (p < 10_000_000)
    return F.when(ok(a) & ok(b), (a + b) / 2).when(ok(a), a.cast("double")).when(ok(b), b.cast("double"))


def weighted_price(level: int = 1) -> Column:
    """Prices weighted by the other side's volume."""
    return F.try_divide(F.col(f"AP{level}") * F.col(f"BV{level}") + F.col(f"BP{level}") * F.col(f"AV{level}"), F.col(f"AV{level}") + F.col(f"BV{level}"))


def market_buy(vol: str, amt: str) -> Column:
    """Volume that must have traded at the last ask for volume and amount to agree, within 0 and vol; null without a spread."""
    spread = F.col("AP1_last") - F.col("BP1_last")
    bought = F.try_divide(F.col(amt) - F.col(vol) * F.col("BP1_last"), F.when(spread != 0, spread))
    return F.when(spread != 0, F.least(F.greatest(bought, F.lit(0)), F.col(vol)))


def with_market_sides(df: DataFrame, by: list[str], order: list[str], vol: str = "vol", amt: str = "amt") -> DataFrame:
    """market_buy, market_sell (the rest of the volume), and their running sums `<c>_sum` in a series; a null adds nothing."""
    from ticktide.operators.scan import running

    rows = df.withColumn("market_buy", market_buy(vol, amt)).withColumn("market_sell", F.col(vol) - F.col("market_buy"))
    return rows.withColumns({f"{c}_sum": F.sum(F.coalesce(F.col(c), F.lit(0))).over(running(by, order)) for c in ("market_buy", "market_sell")})


def quality_report(df: DataFrame, by: list[str], time: str) -> DataFrame:
    """Per series: rows, gaps in the half-second grid, changes of the best ask, and uneven levels."""
    from ticktide.operators.scan import series

    w = series(by, [time])
    uneven = F.lit(False)
    for i in range(1, 5):
        uneven = uneven | (F.col(f"AP{i + 1}") - F.col(f"AP{i}") != 1) | (F.col(f"BP{i}") - F.col(f"BP{i + 1}") != 1)
    rows = df.withColumns({"_gap": F.col(time) - F.lag(time).over(w) != 0.5, "_moved": F.col("AP1") != F.lag("AP1").over(w), "_uneven": uneven})
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c[1:]) for c in ("_gap", "_moved", "_uneven")])


def ladder(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A row per price of a map column, the highest first."""
    return df.select(*keys, F.explode(F.col(column)).alias("price", "volume")).orderBy(*keys, F.desc("price"))
