"""Candle patterns of several bars, as lag expressions over one shared window.

A bar `k` back is judged against the means of the ten (body, range) or five (near, equal) bars
before it. Marks are 100 for a bullish, -100 for a bearish pattern, else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Columns that `helpers` adds and `rules` reads.
HELPERS = ("_b", "_r", "_us", "_ls", "_s", "_ab", "_ar", "_ash", "_an", "_top", "_bot")


def helpers(w: WindowSpec) -> list[dict[str, Column]]:
    """Two steps of columns: body, range, shadows, sign, ends; then the means of the bars before."""
    o, h, low, c = (F.col(x).cast("double") for x in ("open", "high", "low", "close"))
    first = {
        "_b": F.abs(c - o), "_r": h - low, "_us": h - F.greatest(o, c), "_ls": F.least(o, c) - low, "_s": F.when(c >= o, 1).otherwise(-1),
        "_top": F.greatest(o, c), "_bot": F.least(o, c),
    }
    ten, five = (w.rowsBetween(-n, -1) for n in (10, 5))
    mean = lambda x, frame, n: F.when(F.count(F.lit(1)).over(frame) == n, F.avg(x).over(frame))
    second = {"_ab": mean("_b", ten, 10), "_ar": mean("_r", ten, 10), "_ash": mean(F.col("_us") + F.col("_ls"), ten, 10), "_an": mean("_r", five, 5)}
    return [first, second]


class Candle:
    """The bar `back` rows before the present one."""

    def __init__(self, w: WindowSpec, back: int) -> None:
        def get(name: str) -> Column:
            return F.lag(name, back).over(w) if back else F.col(name)

        self.o, self.h, self.l, self.c = (get(x).cast("double") for x in ("open", "high", "low", "close"))
        self.body, self.range, self.upper, self.lower, self.sign = (get(x) for x in ("_b", "_r", "_us", "_ls", "_s"))
        self.top, self.bottom = get("_top"), get("_bot")
        body, rng, shadows, near = (get(x) for x in ("_ab", "_ar", "_ash", "_an"))
        self.white, self.black = self.sign > 0, self.sign < 0
        self.long, self.very_long, self.short = self.body > body, self.body > 3 * body, self.body < body
        self.doji = self.body <= 0.1 * rng
        self.no_upper, self.no_lower = self.upper < 0.1 * rng, self.lower < 0.1 * rng
        self.short_upper = self.upper < shadows / 2
        self.long_lower, self.long_upper = self.lower > self.body, self.upper > self.body
        self.near, self.far, self.equal = 0.2 * near, 0.6 * near, 0.05 * near
        self.middle = (self.o + self.c) / 2

    def above(self, other: Candle) -> Column:
        """The body lies above the other body."""
        return self.bottom > other.top

    def below(self, other: Candle) -> Column:
        return self.top < other.bottom

    def within(self, other: Candle) -> Column:
        return (self.top < other.top) & (self.bottom > other.bottom)


def rules(w: WindowSpec) -> dict[str, Column]:
    z, y, x, v, u = (Candle(w, k) for k in range(5))  # present, one back, ...
    close_to = lambda a, b, room: F.abs(a - b) <= room
    marubozu = lambda k: k.long & k.no_upper & k.no_lower

    def mark(*pairs: tuple[Column, object]) -> Column:
        out: Column = F.lit(0)
        for rule, value in reversed(pairs):
            out = F.when(F.coalesce(rule, F.lit(False)), value).otherwise(out)
        return out.cast("int")

    crows_gap = x.white & x.long & y.black & y.above(x) & z.black
    star = lambda first, middle: first.long & middle
    kick = (y.sign != z.sign) & marubozu(y) & marubozu(z) & F.when(y.black, z.l > y.h).otherwise(z.h < y.l)
    neck = y.black & y.long & z.white & (z.o < y.l)
    three_down = x.black & y.black & z.black & (y.c < x.c) & (z.c < y.c)
    inside = (y.h < x.h) & (y.l > x.l)
    broke = inside & ((z.h < y.h) & (z.l < y.l) | (z.h > y.h) & (z.l > y.l))
    side = F.when((z.h < y.h) & (z.l < y.l), 100).otherwise(-100)
    hold = u.long & v.short & x.short & y.short & z.long
    gap_up, gap_down = y.above(x), y.below(x)
    return {
        "CDL2CROWS": mark((crows_gap & (z.o < y.o) & (z.o > y.c) & (z.c > x.o) & (z.c < x.c), -100)),
        "CDLUPSIDEGAP2CROWS": mark((crows_gap & y.short & (z.o > y.o) & (z.c < y.c) & (z.c > x.c), -100)),
        "CDL3LINESTRIKE": mark((
            (v.sign == x.sign) & (x.sign == y.sign) & (z.sign == -y.sign) & (x.o >= v.bottom - v.near) & (x.o <= v.top + v.near) & (y.o >= x.bottom - x.near) & (y.o <= x.top + x.near)
            & F.when(y.white, (y.c > x.c) & (x.c > v.c) & (z.o > y.c) & (z.c < v.o)).otherwise((y.c < x.c) & (x.c < v.c) & (z.o < y.c) & (z.c > v.o)), 100 * y.sign)),
        "CDL3STARSINSOUTH": mark((
            x.black & y.black & z.black & x.long & x.long_lower & (y.body < x.body) & (y.o > x.c) & (y.o <= x.h) & (y.l < x.c) & (y.l >= x.l) & ~y.no_lower & z.short & z.no_upper & z.no_lower & (z.l > y.l) & (z.h < y.h), 100)),
        "CDLABANDONEDBABY": mark(
            (x.long & y.doji & x.white & z.black & (z.c < x.c - 0.3 * x.body) & (y.l > x.h) & (z.h < y.l), -100),
            (x.long & y.doji & x.black & z.white & (z.c > x.c + 0.3 * x.body) & (y.h < x.l) & (z.l > y.h), 100)),
        "CDLMORNINGDOJISTAR": mark((star(x, y.doji) & x.black & y.below(x) & z.white & (z.c > x.c + 0.3 * x.body), 100)),
        "CDLEVENINGDOJISTAR": mark((star(x, y.doji) & x.white & y.above(x) & z.black & (z.c < x.c - 0.3 * x.body), -100)),
        "CDLADVANCEBLOCK": mark((
            x.white & y.white & z.white & (z.c > y.c) & (y.c > x.c) & (y.o > x.o) & (y.o <= x.c + x.near) & (z.o > y.o) & (z.o <= y.c + y.near) & x.long & x.short_upper
            & ((y.body < x.body - x.far) & (z.body < y.body + y.near) | (z.body < y.body - y.far) | (z.body < y.body) & (y.body < x.body) & (~z.short_upper | ~y.short_upper) | (z.body < y.body) & z.long_upper), -100)),
        "CDLSTALLEDPATTERN": mark((
            x.white & y.white & z.white & (z.c > y.c) & (y.c > x.c) & x.long & y.long & y.no_upper & (y.o > x.o) & (y.o <= x.c + x.near) & z.short & (z.o >= y.c - z.body - y.near), -100)),
        "CDLBREAKAWAY": mark((
            u.long & (u.sign == v.sign) & (v.sign == y.sign) & (y.sign == -z.sign)
            & F.when(u.black, v.below(u) & (x.h < v.h) & (x.l < v.l) & (y.h < x.h) & (y.l < x.l) & (z.c > v.o) & (z.c < u.c)).otherwise(v.above(u) & (x.h > v.h) & (x.l > v.l) & (y.h > x.h) & (y.l > x.l) & (z.c < v.o) & (z.c > u.c)), 100 * z.sign)),
        "CDLCONCEALBABYSWALL": mark((v.black & x.black & y.black & z.black & v.no_upper & v.no_lower & x.no_upper & x.no_lower & y.below(x) & ~y.no_upper & (y.h > x.c) & (z.h > y.h) & (z.l < y.l), 100)),
        "CDLCOUNTERATTACK": mark(((y.sign == -z.sign) & y.long & z.long & close_to(z.c, y.c, y.equal), 100 * z.sign)),
        "CDLSEPARATINGLINES": mark(((y.sign == -z.sign) & z.long & close_to(z.o, y.o, y.equal) & F.when(z.white, z.no_lower).otherwise(z.no_upper), 100 * z.sign)),
        "CDLGAPSIDESIDEWHITE": mark((
            y.white & z.white & (gap_up & z.above(x) | gap_down & z.below(x)) & close_to(z.body, y.body, y.near) & close_to(z.o, y.o, y.equal), F.when(gap_up, 100).otherwise(-100))),
        "CDLHIKKAKE": mark((broke, side)),
        "CDLHIKKAKEMOD": mark((
            broke & (x.h < v.h) & (x.l > v.l) & F.when((z.h < y.h) & (z.l < y.l), x.c <= x.l + x.near).otherwise(x.c >= x.h - x.near), side)),
        "CDLHOMINGPIGEON": mark((y.black & z.black & y.long & z.short & (z.o < y.o) & (z.c > y.c), 100)),
        "CDLIDENTICAL3CROWS": mark((three_down & x.no_lower & y.no_lower & z.no_lower & close_to(y.o, x.c, x.equal) & close_to(z.o, y.c, y.equal), -100)),
        "CDLINNECK": mark((neck & (z.c <= y.c + y.equal) & (z.c >= y.c), -100)),
        "CDLONNECK": mark((neck & close_to(z.c, y.l, y.equal), -100)),
        "CDLTHRUSTING": mark((neck & (z.c > y.c + y.equal) & (z.c <= y.middle), -100)),
        "CDLKICKING": mark((kick, 100 * z.sign)),
        "CDLKICKINGBYLENGTH": mark((kick, 100 * F.when(z.body > y.body, z.sign).otherwise(y.sign))),
        "CDLLADDERBOTTOM": mark((u.black & v.black & x.black & (u.o > v.o) & (v.o > x.o) & (u.c > v.c) & (v.c > x.c) & y.black & ~y.no_upper & z.white & (z.o > y.o) & (z.c > y.h), 100)),
        "CDLMATHOLD": mark((
            u.long & u.white & v.short & x.short & y.short & v.black & z.white & v.above(u) & (x.bottom < u.c) & (y.bottom < u.c) & (x.bottom > u.c - 0.5 * u.body) & (y.bottom > u.c - 0.5 * u.body)
            & (x.top < v.o) & (y.top < x.top) & (z.o > y.c) & (z.c > F.greatest(v.h, x.h, y.h)), 100)),
        "CDLRISEFALL3METHODS": mark((
            hold & (v.sign == -u.sign) & (x.sign == -u.sign) & (y.sign == -u.sign) & (z.sign == u.sign) & (F.greatest(v.bottom, x.bottom, y.bottom) < u.h) & (F.least(v.top, x.top, y.top) > u.l)
            & F.when(u.white, (x.c < v.c) & (y.c < x.c) & (z.o > y.c) & (z.c > u.c)).otherwise((x.c > v.c) & (y.c > x.c) & (z.o < y.c) & (z.c < u.c)), 100 * u.sign)),
        "CDLRICKSHAWMAN": mark((z.doji & z.long_lower & z.long_upper & (z.bottom <= z.l + z.range / 2 + z.near) & (z.top >= z.l + z.range / 2 - z.near), 100)),
        "CDLTAKURI": mark((z.doji & z.no_upper & (z.lower > 2 * z.body), 100)),
        "CDLSTICKSANDWICH": mark((x.black & y.white & z.black & (y.l > x.c) & close_to(z.c, x.c, x.equal), 100)),
        "CDLTASUKIGAP": mark((
            F.when(y.white, gap_up & z.black & (z.o < y.c) & (z.o > y.o) & (z.c < y.o) & (z.c > x.top)).otherwise(gap_down & z.white & (z.o < y.o) & (z.o > y.c) & (z.c > y.o) & (z.c < x.bottom))
            & close_to(y.body, z.body, y.near), 100 * y.sign)),
        "CDLUNIQUE3RIVER": mark((x.long & x.black & y.black & (y.c > x.c) & (y.o <= x.o) & (y.l < x.l) & z.short & z.white & (z.o > y.l), 100)),
        "CDLXSIDEGAP3METHODS": mark((
            (x.sign == y.sign) & (z.sign == -y.sign) & (z.o < y.top) & (z.o > y.bottom) & (z.c < x.top) & (z.c > x.bottom) & F.when(x.white, gap_up).otherwise(gap_down), 100 * x.sign)),
    }


def window(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)
