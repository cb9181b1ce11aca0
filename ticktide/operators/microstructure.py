"""Per-tick features of price, volume and book maps.

Inputs are the columns of `operators.book`: prices, volumes and maps of the present and the last
snapshot. Everything is a column expression or a window that shares its series' one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.functions import pvmap as pv
from ticktide.operators.scan import Names, forward_fill, running, series

#: Maps whose sums, extremes and mean prices `map_measures` gives.
TRADE_MAPS = ("exch", "ask_add", "ask_cancel", "ask_old", "ask_new", "bid_add", "bid_cancel", "bid_old", "bid_new", "moment")


def trade_prices(df: DataFrame, by: Names, order: Names, vol_sum: str, amt_sum: str, multiplier: Column) -> DataFrame:
    """vol and amt of each tick from the day's running totals, VWAP, WAP (both filled forward) and MID."""
    w = series(by, order)
    df = df.withColumns({
        "vol": F.col(vol_sum) - F.coalesce(F.lag(vol_sum).over(w), F.lit(0)),
        "amt": (F.col(amt_sum) - F.coalesce(F.lag(amt_sum).over(w), F.lit(0))) / multiplier,
    })
    a, b, av, bv = (F.col(c) for c in ("AP1", "BP1", "AV1", "BV1"))
    wap = F.try_divide((a * bv + b * av).cast("double"), av + bv)
    vwap = F.try_divide(F.col("amt").cast("double"), F.when(F.col("vol") > 0, F.col("vol")))
    return df.withColumns({"VWAP": forward_fill(vwap, by, order), "WAP": forward_fill(wap, by, order), "MID": (a + b) / 2})


def smoothed_price(level: int = 1) -> Column:
    """Prices weighted by the other side's volume plus one."""
    a, b, av, bv = (F.col(f"{c}{level}") for c in ("AP", "BP", "AV", "BV"))
    return (a * (bv + 1) + b * (av + 1)) / (av + bv + 2)


def is_stable(prices: Names, by: Names, order: Names) -> Column:
    """Whether all these prices equal the tick before; a series' first tick is not stable."""
    same = F.lit(True)
    for p in prices:
        same = same & F.coalesce(F.col(p) == F.lag(p).over(series(by, order)), F.lit(False))
    return same


def spread_state() -> Column:
    """(spread, spread before, change of the best ask, change of the best bid)."""
    now, before = F.col("AP1") - F.col("BP1"), F.col("AP1_last") - F.col("BP1_last")
    return F.struct(now.alias("spread"), before.alias("spread_last"), (F.col("AP1") - F.col("AP1_last")).alias("ask_change"), (F.col("BP1") - F.col("BP1_last")).alias("bid_change"))


# What each named state is, as (spread, spread before, ask change, bid change).
STATES = {
    "one": (1, 1, 0, 0), "one_down_half": (2, 1, 0, -1), "one_down": (1, 1, -1, -1), "one_up_half": (2, 1, 1, 0), "one_up": (1, 1, 1, 1),
    "two": (2, 2, 0, 0), "two_down_half": (1, 2, -1, 0), "two_down": (2, 2, -1, -1), "two_down_more": (1, 2, -2, -1),
    "two_up_half": (1, 2, 0, 1), "two_up": (2, 2, 1, 1), "two_up_more": (1, 2, 1, 2),
}


def named_state(state: Column) -> Column:
    """The name of a spread state, null for none of STATES."""
    out = F.lit(None).cast("string")
    for name, values in STATES.items():
        same = F.lit(True)
        for field, value in zip(("spread", "spread_last", "ask_change", "bid_change"), values, strict=True):
            same = same & (state[field] == value)
        out = F.when(same, F.lit(name)).otherwise(out)
    return out


def around_bid(levels: range = range(1, 7)) -> dict[str, Column]:
    """ev, v, lv, av of six prices around the last best bid (the third): traded, resting now, resting before, added."""
    out: dict[str, Column] = {}
    for i in levels:
        side, price = ("ask" if i > 3 else "bid"), F.col("BP1_last") + (i - 3)
        traded, now, before = (pv.get(F.col(m), price) for m in ("D_exch", f"D_{side}", f"D_{side}_last"))
        out |= {f"ev{i}": traded, f"v{i}": now, f"lv{i}": before, f"av{i}": now + traded - before}
    return out


def centred(column: str, centre: Column, width: int = 2) -> Column:
    """Volumes at the prices `centre` - width to centre + width, as an array."""
    return F.array(*[pv.get(F.col(column), centre + k) for k in range(-width, width + 1)])


def with_moment(df: DataFrame) -> DataFrame:
    """D_moment: trades against new bids less trades against old asks."""
    return df.withColumn("D_moment", pv.subtract(F.col("D_bid_new"), F.col("D_ask_old")))


def map_measures(names: Names = TRADE_MAPS) -> dict[str, Column]:
    """`<n>_max`, `_min` (of the prices), `_volume`, `_amt`, `_avgp` of each map D_<n>."""
    out: dict[str, Column] = {}
    for n in names:
        m = F.col(f"D_{n}")
        volume, amount = pv.total(m), pv.turnover(m)
        out |= {
            f"{n}_max": F.array_max(F.map_keys(m)), f"{n}_min": F.array_min(F.map_keys(m)), f"{n}_volume": volume, f"{n}_amt": amount,
            f"{n}_avgp": F.when(volume > 0, F.try_divide(amount.cast("double"), volume)),
        }
    return out


def price_totals(df: DataFrame, by: list[str], place: str, column: str, unstable: str) -> DataFrame:
    """Rows (by, place, price, total, since_unstable, until_unstable) of a map column in long form.

    total: traded at the price up to this tick; the other two: since the last unstable tick, and from
    here to the next one. A row stands where the price traded, and at every unstable tick.
    """
    marks = df.select(*by, place, F.col(unstable).alias("_u"))
    long = df.select(*by, place, F.explode(pv.or_empty(F.col(column))).alias("price", "_v"))
    prices = long.select(*by, "price").distinct()
    at_marks = prices.join(marks.filter("_u"), by).select(*by, place, "price", F.lit(0).cast("bigint").alias("_v"))
    rows = long.unionByName(at_marks).groupBy(*by, place, "price").agg(F.sum("_v").alias("_v")).join(marks, [*by, place])
    run = rows.withColumn("total", F.sum("_v").over(running([*by, "price"], [place])))
    at = F.when(F.col("_u"), F.col("total"))
    ahead = series([*by, "price"], [place]).rowsBetween(0, 2**31 - 1)
    last, following = F.last(at, True).over(running([*by, "price"], [place])), F.first(at, True).over(ahead)
    return run.select(*by, place, "price", "total", (F.col("total") - F.coalesce(last, F.lit(0))).alias("since_unstable"), (following - F.col("total")).alias("until_unstable"))


def side_volumes(names: Names) -> dict[str, Column]:
    """`<n>_above`: volume of D_<n> at the best ask or above; `<n>_below`: at the best bid or below."""
    out: dict[str, Column] = {}
    for n in names:
        m = F.col(f"D_{n}")
        out |= {f"{n}_above": pv.total(pv.clip(m, F.col("AP1"))), f"{n}_below": pv.total(pv.clip(m, None, F.col("BP1")))}
    return out


def side_ratios(names: Names) -> dict[str, Column]:
    """`<n>_ratio`: (above + 1) / (above + below + 2)."""
    sides = side_volumes(names)
    return {f"{n}_ratio": (sides[f"{n}_above"] + 1) / (sides[f"{n}_above"] + sides[f"{n}_below"] + 2) for n in names}


def can_trade(until_next_above: str, until_next_below: str) -> dict[str, Column]:
    """Whether more will trade beyond a best price, up to the next unstable tick, than rests there now."""
    return {"can_trade_ask": F.col(until_next_above) > F.col("AV1"), "can_trade_bid": F.col(until_next_below) > F.col("BV1")}


def next_map(column: str, by: Names, order: Names) -> Column:
    return F.lead(column).over(series(by, order))


def to_neighbours(df: DataFrame, by: list[str], order: list[str], unstable: str, columns: Names) -> DataFrame:
    """`<c>_difflast`: value at the last unstable tick less now; `<c>_diffnext`: now less the value at the next one."""
    u = F.col(unstable)
    ahead = series(by, order).rowsBetween(0, 2**31 - 1)
    return df.withColumns(
        {f"{c}_difflast": F.last(F.when(u, F.col(c)), True).over(running(by, order)) - F.col(c) for c in columns}
        | {f"{c}_diffnext": F.col(c) - F.first(F.when(u, F.col(c)), True).over(ahead) for c in columns}
    )


def level_flow(width: int = 2) -> dict[str, Column]:
    """Change of resting volume at the best price and up to `width` levels behind it: total, added, removed."""
    out: dict[str, Column] = {}
    for side, low in (("ask", False), ("bid", True)):
        grown = pv.negate(F.col(f"D_{side}_diff"))
        for k in range(width + 1):
            edge = F.col("BP1") - k if low else F.col("BP1") + 1 + k
            part = pv.clip(grown, edge) if low else pv.clip(grown, None, edge)
            out |= {f"{side}{k}_flow": pv.total(part), f"{side}{k}_flow_pos": pv.total(pv.positive(part)), f"{side}{k}_flow_neg": pv.total(pv.negative(part))}
    return out


def two_price_split(vol: Column, amt: Column, low: Column, high: Column) -> Column:
    """Volume at the two prices around the mean price; all at `high` (or `low`) where the mean lies beyond it."""
    p = F.floor(F.try_divide(amt, F.when(vol > 0, vol))).cast("bigint")
    upper = (amt - p * vol).cast("bigint")
    pair = F.map_from_arrays(F.array(p, p + 1), F.array((vol - upper).cast("bigint"), upper))
    one = lambda price: F.map_from_arrays(F.array(price.cast("bigint")), F.array(vol.cast("bigint")))
    return F.when(p.isNull() | (amt == 0), pv.empty()).when(p > high, one(high)).when(p < low, one(low)).otherwise(pv.positive(pair))


def swept_split(vol: Column, amt: Column) -> Column:
    """Volume at two neighbouring prices around the best ones: a mean above the ask sweeps one level up, one below the bid one down."""
    bid, ask = F.col("BP1"), F.col("AP1")
    mean = F.try_divide(amt.cast("double"), F.when(vol > 0, vol))
    low = F.when(mean < bid, bid - 1).when(mean > ask, ask).otherwise(bid)
    upper = F.least(F.greatest(amt - vol * low, F.lit(0)), vol).cast("bigint")
    pair = F.map_from_arrays(F.array(low.cast("bigint"), (low + 1).cast("bigint")), F.array((vol - upper).cast("bigint"), upper))
    return F.when(mean.isNull(), pv.empty()).otherwise(pv.positive(pair))


def added_limit(side: str, level: int, market: str) -> Column:
    """Limit volume added at a level: all of it at a new best price, none beyond the last five levels, else
    what the level grew by, plus the market orders (`market`) that the last best price met."""
    price, volume = F.col(f"{side}P{level}"), F.col(f"{side}V{level}")
    best, worst = F.col(f"{side}P1_last"), F.col(f"{side}P5_last")
    better, beyond = (price > best, price < worst) if side == "B" else (price < best, price > worst)
    before = F.lit(0)
    for i in range(5, 0, -1):
        before = F.when(price == F.col(f"{side}P{i}_last"), F.col(f"{side}V{i}_last")).otherwise(before)
    met = F.when(price == best, F.col(market)).otherwise(F.lit(0))
    return F.when(better, volume).when(beyond, F.lit(0)).otherwise(volume - before + met)


def rolling_prices(df: DataFrame, by: Names, order: Names, volume: str, amount: str, lengths: Names, name: str) -> DataFrame:
    """`<name>_pmean_<j>`, `_psqr_<j>`, `_vmean_<j>`: mean and variance of the price weighted by volume, and mean
    volume, over the last j ticks; sums are differences of running sums, whatever j is."""
    w, up = series(by, order), running(by, order)
    v, a = F.col(volume).cast("double"), F.col(amount).cast("double")
    sums = {"_sv": F.sum(v).over(up), "_sa": F.sum(a).over(up), "_sq": F.sum(F.coalesce(F.try_divide(a * a, v), F.lit(0.0))).over(up), "_rn": F.row_number().over(w)}
    df = df.withColumns(sums)
    out: dict[str, Column] = {}
    for j in lengths:
        dv, da, dq = (F.col(c) - F.coalesce(F.lag(c, int(j)).over(w), F.lit(0.0)) for c in ("_sv", "_sa", "_sq"))
        mean = F.try_divide(da, dv)
        out |= {f"{name}_pmean_{j}": mean, f"{name}_psqr_{j}": F.try_divide(dq, dv) - mean * mean, f"{name}_vmean_{j}": dv / F.least(F.col("_rn"), F.lit(int(j)))}
    return df.withColumns(out).drop("_sv", "_sa", "_sq", "_rn")


def rolling_differences(lengths: Names) -> dict[str, Column]:
    """Differences of the rolling prices and volumes of asks and bids, of added and cancelled orders, and of the moment map."""
    out: dict[str, Column] = {}
    c = F.col
    for j in lengths:
        p, v = (lambda n: c(f"{n}_pmean_{j}")), (lambda n: c(f"{n}_vmean_{j}"))
        gap = v("ask_old") - v("bid_old")
        out |= {f"askbid_pdiff_{j}": p("ask_old") - p("bid_old"), f"askbid_vdiff_{j}": gap, f"askbid_share_{j}": F.try_divide(gap, v("exch"))}
        out |= {f"moment_pdiff_{j}": p("moment") - p("exch"), f"moment_share_{j}": F.try_divide(v("moment"), v("exch"))}
        for s in ("bid", "ask"):
            gap = v(f"{s}_add") - v(f"{s}_cancel")
            out |= {
                f"{s}_addcancel_pdiff_{j}": p(f"{s}_add") - p(f"{s}_cancel"), f"{s}_addcancel_vdiff_{j}": gap,
                f"{s}_addcancel_share_{j}": F.try_divide(gap, v(f"{s}_add") + v(f"{s}_cancel")),
            }
    return out


Ladder = "array<struct<key:bigint,value:bigint>>"


def merge_ladders(a: Column, b: Column, sign: int = -1, bounded: bool = False, descending: bool = False) -> Column:
    """Two ladders, arrays of (price, volume) in order from the best price, merged in one fold: a + sign * b per price.

    Bounded, only up to the nearer of both farthest prices, since nothing is known of a ladder beyond its last
    level; with an empty ladder that leaves nothing. Null counts as empty.
    """
    none = F.array().cast(Ladder)

    def nearer(p: Column, q: Column) -> Column:
        return p > q if descending else p < q

    def run(both: Column) -> Column:
        a, b, edge = both["a"], both["b"], both["edge"]

        def step(at: Column, _: Column) -> Column:
            def taken(xy: Column) -> Column:
                x, y = xy["x"], xy["y"]
                left = x["key"].isNotNull() & (y["key"].isNull() | ~nearer(y["key"], x["key"]))
                right = y["key"].isNotNull() & (x["key"].isNull() | ~nearer(x["key"], y["key"]))
                price = F.when(left, x["key"]).otherwise(y["key"])
                zero = F.lit(0).cast("bigint")
                volume = F.when(left, x["value"]).otherwise(zero) + sign * F.when(right, y["value"]).otherwise(zero)
                keep = price.isNotNull() & (~nearer(xy["edge"], price) if bounded else F.lit(True))
                rows = F.when(keep, F.array_append(at["rows"], F.struct(price.alias("key"), volume.alias("value"))).cast(Ladder)).otherwise(at["rows"])
                return F.struct((at["i"] + left.cast("int")).alias("i"), (at["j"] + right.cast("int")).alias("j"), rows.alias("rows"))

            return pv.let(F.struct(F.get(a, at["i"]).alias("x"), F.get(b, at["j"]).alias("y"), edge.alias("edge")), taken)

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), none.alias("rows"))
        steps = F.size(a) + F.size(b)
        merged = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step, lambda at: at["rows"])
        return F.when(steps == 0, none).when(edge.isNull(), none).otherwise(merged) if bounded else F.when(steps == 0, none).otherwise(merged)

    def with_edge(both: Column) -> Column:
        ends = [F.try_element_at(both[x], F.lit(-1))["key"] for x in "ab"]
        edge = F.when(ends[0].isNotNull() & ends[1].isNotNull(), (F.greatest if descending else F.least)(*ends))
        return pv.let(F.struct(both["a"].alias("a"), both["b"].alias("b"), edge.alias("edge")), run)

    return pv.let(F.struct(F.coalesce(a.cast(Ladder), none).alias("a"), F.coalesce(b.cast(Ladder), none).alias("b")), with_edge)


def level_ladder(side: str, last: bool = False) -> Column:
    """A side's five levels as a ladder, levels without a price left out."""
    tail = "_last" if last else ""
    rows = [F.when(F.col(f"{side}P{i}{tail}") > 0, F.struct(F.col(f"{side}P{i}{tail}").cast("bigint").alias("key"), F.coalesce(F.col(f"{side}V{i}{tail}"), F.lit(0)).cast("bigint").alias("value"))) for i in range(1, 6)]
    return F.array_compact(F.array(*rows))


def merged_ladders(a: Column, b: Column, bounded: bool = True, descending: bool = False) -> Column:
    """`a` less `b` per price, for map columns."""
    return F.map_from_entries(merge_ladders(pv.entries(a, descending), pv.entries(b, descending), -1, bounded, descending))
