"""Technical indicators over bars (open, high, low, close, volume) of series.

Finite-window and cumulative indicators are window expressions that share one sort; recursive
ones run over ranges of a series. Rows without enough history
are null, and a null input leaves a recursive state as it is. Overlap indicators are given as their
distance from the close where `minus_close` is set.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ticktide.operators import patterns
from ticktide.operators.ranges import PLACE, Linear, Value, before, column, count, each, ewm, total, windows, with_fold, with_values

Bars = tuple[WindowSpec, Callable[[int], WindowSpec]]


def frames(by: list[str], order: list[str]) -> Bars:
    w = Window.partitionBy(*by).orderBy(*order)
    return w, lambda n: w.rowsBetween(-(n - 1), Window.currentRow)


def _full(value: Column, n: int, frame: WindowSpec) -> Column:
    return F.when(F.count(F.lit(1)).over(frame) == n, value)


def _known(c: str, n: int, b: Bars) -> Column:
    """Mean of the last n values where none is null."""
    return F.when(F.count(c).over(b[1](n)) == n, F.avg(c).over(b[1](n)))


def sma(c: str, n: int, b: Bars) -> Column:
    return _full(F.avg(c).over(b[1](n)), n, b[1](n))


def wma(c: str, n: int, b: Bars) -> Column:
    """Weights 1 to n, the newest the largest."""
    total = F.lit(0.0)
    for k in range(n):
        total = total + F.lag(c, k).over(b[0]) * (n - k)
    return total / (n * (n + 1) / 2)


def trima(c: str, n: int, b: Bars) -> Column:
    """Triangular weights."""
    weights = [min(k + 1, n - k) for k in range(n)]
    total = F.lit(0.0)
    for k, w in enumerate(weights):
        total = total + F.lag(c, k).over(b[0]) * w
    return total / sum(weights)


def midpoint(c: str, n: int, b: Bars) -> Column:
    return _full((F.max(c).over(b[1](n)) + F.min(c).over(b[1](n))) / 2, n, b[1](n))


def midprice(n: int, b: Bars) -> Column:
    return _full((F.max("high").over(b[1](n)) + F.min("low").over(b[1](n))) / 2, n, b[1](n))


def bbands(c: str, n: int, width: float, b: Bars) -> dict[str, Column]:
    mid, dev = sma(c, n, b), F.stddev_pop(c).over(b[1](n))
    return {"upper": mid + width * dev, "middle": mid, "lower": mid - width * dev}


def momentum(c: str, n: int, b: Bars) -> Column:
    return F.col(c) - F.lag(c, n).over(b[0])


def roc(c: str, n: int, b: Bars) -> dict[str, Column]:
    ratio = F.try_divide(F.col(c).cast("double"), F.lag(c, n).over(b[0]))
    return {"roc": (ratio - 1) * 100, "rocp": ratio - 1, "rocr": ratio, "rocr100": ratio * 100}


def willr(n: int, b: Bars) -> Column:
    hi, lo = F.max("high").over(b[1](n)), F.min("low").over(b[1](n))
    return _full(F.try_divide(-100.0 * (hi - F.col("close")), F.when(hi != lo, hi - lo)), n, b[1](n))


def fast_k(n: int, b: Bars) -> Column:
    hi, lo = F.max("high").over(b[1](n)), F.min("low").over(b[1](n))
    return _full(F.try_divide(100.0 * (F.col("close") - lo), F.when(hi != lo, hi - lo)), n, b[1](n))


def true_range(b: Bars) -> Column:
    before = F.lag("close").over(b[0])
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def bop() -> Column:
    return F.coalesce(F.try_divide((F.col("close") - F.col("open")).cast("double"), F.when(F.col("high") != F.col("low"), F.col("high") - F.col("low"))), F.lit(0.0))


def obv(b: Bars) -> Column:
    step = F.signum(F.col("close") - F.lag("close").over(b[0]))
    return F.sum(F.coalesce(step, F.lit(1)) * F.col("volume")).over(b[0].rowsBetween(Window.unboundedPreceding, Window.currentRow))


def ad_line(b: Bars) -> Column:
    spread = F.col("high") - F.col("low")
    flow = F.coalesce(F.try_divide(((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))).cast("double"), F.when(spread != 0, spread)), F.lit(0.0))
    return F.sum(flow * F.col("volume")).over(b[0].rowsBetween(Window.unboundedPreceding, Window.currentRow))


def with_finite(df: DataFrame, by: list[str], order: list[str], minus_close: bool = False) -> DataFrame:
    """The finite-window and cumulative indicators, default periods."""
    b = frames(by, order)
    less = F.col("close") if minus_close else F.lit(0)
    overlap = {"SMA": sma("close", 30, b), "WMA": wma("close", 30, b), "TRIMA": trima("close", 30, b), "MIDPOINT": midpoint("close", 14, b), "MIDPRICE": midprice(14, b)}
    overlap |= {f"BBANDS_{k}": v for k, v in bbands("close", 5, 2.0, b).items()}
    out = df.withColumns({k: v - less for k, v in overlap.items()} | {
        "MOM": momentum("close", 10, b), "WILLR": willr(14, b), "BOP": bop(), "TRANGE": true_range(b), "OBV": obv(b), "AD": ad_line(b), "STOCHF_fastk": fast_k(5, b), "_tp": typical(),
    } | {k.upper(): v for k, v in roc("close", 10, b).items()})
    w5 = b[1](14)
    before = F.lag("_tp").over(b[0])
    flow = F.col("_tp") * F.col("volume")
    out = out.withColumns({"_up": F.when(F.col("_tp") > before, flow).otherwise(0.0), "_down": F.when(F.col("_tp") < before, flow).otherwise(0.0), "_place": F.row_number().over(b[0])})
    up, down = F.sum("_up").over(w5), F.sum("_down").over(w5)
    high_at = F.max_by("_place", F.struct("high", "_place")).over(b[1](15))
    low_at = F.max_by("_place", F.struct(-F.col("low"), F.col("_place"))).over(b[1](15))
    full = F.count(F.lit(1)).over(b[1](15)) == 15
    out = out.withColumns({
        "MFI": F.when(F.col("_place") > 14, F.try_divide(100 * up, F.when(up + down != 0, up + down))), "STOCHF_fastd": _known("STOCHF_fastk", 3, b),
        "AROON_up": F.when(full, (14 - (F.col("_place") - high_at)) * 100.0 / 14), "AROON_down": F.when(full, (14 - (F.col("_place") - low_at)) * 100.0 / 14),
        "_mean": F.avg("_tp").over(w5), "_tps": F.collect_list("_tp").over(w5),
    })
    spread = F.aggregate("_tps", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_mean"))) / 14
    out = out.withColumns({
        "AROONOSC": F.col("AROON_up") - F.col("AROON_down"),
        "CCI": F.when(F.size("_tps") == 14, F.try_divide(F.col("_tp") - F.col("_mean"), F.when(spread > 0, 0.015 * spread))),
    })
    pressure = F.col("close") - F.least(F.col("low"), F.lag("close").over(b[0]))
    out = out.withColumns({"MA": F.col("SMA"), "_bp": F.when(F.col("TRANGE").isNotNull(), pressure), "STOCH_slowk": _known("STOCHF_fastk", 3, b)})
    part = lambda n: F.when(F.count("_bp").over(b[1](n)) == n, F.try_divide(F.sum("_bp").over(b[1](n)).cast("double"), F.sum("TRANGE").over(b[1](n))))
    out = out.withColumns({"STOCH_slowd": _known("STOCH_slowk", 3, b), "ULTOSC": 100 * (4 * part(7) + 2 * part(14) + part(28)) / 7})
    fast, slow = sma("close", 12, b), sma("close", 26, b)
    out = out.withColumn("MACDEXT", F.when(slow.isNotNull(), fast - slow))
    out = out.withColumn("MACDEXT_signal", _known("MACDEXT", 9, b)).withColumn("MACDEXT_hist", F.col("MACDEXT") - F.col("MACDEXT_signal"))
    return out.drop("_tp", "_up", "_down", "_place", "_mean", "_tps", "_bp")


def with_open(df: DataFrame, by: list[str], order: list[str], close: str = "close", name: str = "open") -> DataFrame:
    """`name`: the close of the bar before, filled forward where it is null; none at the start of a series."""
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(close, ignorenulls=True).over(past))


def cci(n: int, b: Bars) -> Column:
    """Distance of the typical price from its mean over n bars, in 0.015 mean absolute deviations."""
    mean, held = F.avg(typical()).over(b[1](n)), F.collect_list(typical()).over(b[1](n))
    pair = F.struct(mean.alias("m"), held.alias("x"))
    spread = F.aggregate(pair["x"], F.struct(F.lit(0.0).alias("s"), pair["m"].alias("m")), lambda a, x: F.struct((a["s"] + F.abs(x - a["m"])).alias("s"), a["m"].alias("m")), lambda a: a["s"]) / n
    return F.when(F.size(held) == n, F.try_divide(typical() - mean, F.when(spread > 0, 0.015 * spread)))


def aroon_oscillator(n: int, place: str, b: Bars) -> Column:
    """How much nearer the highest high of the last n + 1 bars is than the lowest low, in hundredths of n; the latest of equal ones counts."""
    frame = b[1](n + 1)
    high, low = F.max_by(place, F.struct("high", place)).over(frame), F.max_by(place, F.struct(-F.col("low"), F.col(place))).over(frame)
    return _full((high - low) * 100.0 / n, n + 1, frame)


def position_sweep(df: DataFrame, by: list[str], order: list[str], periods: tuple[int, ...]) -> DataFrame:
    """`CCI_<n>` and `AROONOSC_<n>` for each period."""
    b = frames(by, order)
    rows = df.withColumn("_place", F.row_number().over(b[0]))
    return rows.withColumns({f"CCI_{n}": cci(n, b) for n in periods} | {f"AROONOSC_{n}": aroon_oscillator(n, "_place", b) for n in periods}).drop("_place")


def macdext_sweep(df: DataFrame, by: list[str], order: list[str], periods: tuple[int, ...]) -> DataFrame:
    """`MACDEXT_<f>_<s>`, its signal and histogram by plain means, for the pairs of `macd_grid`."""
    b, grid = frames(by, order), macd_grid(periods)
    means = {n: sma("close", n, b) for n in {n for f, s, _ in grid for n in (f, s)}}
    rows = df.withColumns({f"MACDEXT_{f}_{s}": F.when(means[s].isNotNull(), means[f] - means[s]) for f, s, _ in grid})
    rows = rows.withColumns({f"MACDEXT_signal_{f}_{s}": _known(f"MACDEXT_{f}_{s}", max(signal, 1), b) for f, s, signal in grid})
    return rows.withColumns({f"MACDEXT_hist_{f}_{s}": F.col(f"MACDEXT_{f}_{s}") - F.col(f"MACDEXT_signal_{f}_{s}") for f, s, _ in grid})


#: Periods of the sweeps.
SWEEP = (3, 5, 10, 15, 20, 30, 40, 50, 60, 80, 100, 120, 180, 240, 300)


def sma_sweep(df: DataFrame, by: list[str], order: list[str], periods: tuple[int, ...] = SWEEP) -> DataFrame:
    """`SMA_<n>`: distance of the mean of n closes from the close, for each period."""
    b = frames(by, order)
    return df.withColumns({f"SMA_{n}": sma("close", n, b) - F.col("close") for n in periods})


def macd_grid(periods: tuple[int, ...] = SWEEP) -> list[tuple[int, int, int]]:
    """(fast, slow, signal) with slow / 4 <= fast <= slow / 2 and signal = int(0.75 fast)."""
    return [(f, s, int(0.75 * f)) for s in periods for f in periods if s / 4 <= f <= s / 2]


# Recursive indicators, as graphs over ranges of a series (see `ranges`).

def ema_of(x: Value, n: int) -> Value:
    return ewm(x, 2 / (n + 1), n)


def wilder(x: Value, n: int) -> Value:
    return ewm(x, 1 / n, n)


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b, np.nan)


def _ratio(a: Value, b: Value) -> Value:
    return each(_divide, a, b)


class Inputs:
    """The bars' columns, and what several indicators need of them."""

    def __init__(self) -> None:
        self.open, self.high, self.low, self.close, self.volume = (column(c) for c in ("open", "high", "low", "close", "volume"))
        before_close = before(self.close, 1)

        def true_range(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> np.ndarray:
            return np.where(np.isnan(c), np.nan, np.maximum(h - low, np.maximum(np.abs(h - c), np.abs(low - c))))

        self.range = each(true_range, self.high, self.low, before_close)
        self.step = each(np.subtract, self.close, before_close)
        up, down = each(np.subtract, self.high, before(self.high, 1)), each(np.subtract, before(self.low, 1), self.low)

        def wins(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where(np.isnan(a), np.nan, np.where((a > b) & (a > 0), a, 0.0))

        self.plus, self.minus = each(wins, up, down), each(wins, down, up)


def directional(o: Inputs, n: int) -> dict[str, Value]:
    """True range and directional movement, smoothed over n bars."""
    atr, pdm, mdm = wilder(o.range, n), wilder(o.plus, n), wilder(o.minus, n)
    pdi, mdi = _ratio(pdm, atr) * 100, _ratio(mdm, atr) * 100
    dx = each(lambda p, m: 100 * _divide(np.abs(p - m), p + m), pdi, mdi)
    adx = wilder(dx, n)
    adxr = each(lambda a, b: (a + b) / 2, adx, before(adx, n - 1))
    return {"ATR": atr, "PLUS_DM": pdm * n, "MINUS_DM": mdm * n, "PLUS_DI": pdi, "MINUS_DI": mdi, "DX": dx, "ADX": adx, "ADXR": adxr}


def sweep_values(periods: tuple[int, ...] = SWEEP) -> dict[str, Value]:
    """The recursive indicators whose periods are swept."""
    o, out = Inputs(), {}
    means = {n: ema_of(o.close, n) for n in periods}
    for n in periods:
        out |= {f"EMA_{n}": means[n] - o.close} | {f"{k}_{n}": x for k, x in directional(o, n).items() if k in ("ADX", "ATR", "PLUS_DM", "MINUS_DM", "PLUS_DI", "MINUS_DI")}
    for f, s, signal in macd_grid(periods):
        line = means[f] - means[s]
        out |= {f"MACD_{f}_{s}": line, f"MACD_hist_{f}_{s}": line - ema_of(line, max(signal, 1))}
    fixed = ewm(o.close, 0.15, 12) - ewm(o.close, 0.075, 26)
    for signal in sorted({max(signal, 1) for _, _, signal in macd_grid(periods)}):
        out[f"MACDFIX_hist_{signal}"] = fixed - ema_of(fixed, signal)
    return out


def kama(c: Value, n: int) -> Value:
    """Adaptive mean: the smoothing follows the ratio of net to total movement over n steps."""
    moved = windows(c, n + 1, lambda w: np.abs(np.diff(w, axis=1)).sum(axis=1))

    def smoothing(moved: np.ndarray, now: np.ndarray, past: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(moved > 0, np.abs(now - past) / moved, 1.0)
        return (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2

    k = each(smoothing, moved, c, before(c, n))
    last = before(c, 1)
    begun = count(each(lambda place, b: (place >= n) & ~np.isnan(b), PLACE, last))
    first = each(lambda at, place, b: (at == 1) & (place >= n) & ~np.isnan(b), begun, PLACE, last)

    def slope(k: np.ndarray, c: np.ndarray, first: np.ndarray, begun: np.ndarray) -> np.ndarray:
        return np.where(begun == 0, 1.0, np.where(first, 0.0, np.where(np.isnan(c), 1.0, 1 - k)))

    def push(k: np.ndarray, c: np.ndarray, first: np.ndarray, begun: np.ndarray, last: np.ndarray) -> np.ndarray:
        gain = np.where(np.isnan(c), 0.0, k)
        return np.where(begun == 0, 0.0, gain * np.nan_to_num(c) + np.where(first, (1 - gain) * np.nan_to_num(last), 0.0))

    state = Value([each(slope, k, c, first, begun), each(push, k, c, first, begun, last)], scan=Linear())
    return each(lambda y, at: np.where(at > 0, y, np.nan), state, begun)


def recursive_values() -> dict[str, Value]:
    """Every indicator whose recurrence is linear, default periods."""
    o = Inputs()
    c = o.close
    e1 = ema_of(c, 30)
    e2 = ema_of(e1, 30)
    e3 = ema_of(e2, 30)
    out = {"EMA": e1, "DEMA": e1 * 2 - e2, "TEMA": (e1 - e2) * 3 + e3}
    t, t3, v = c, [], 0.7
    for _ in range(6):
        t3.append(t := ema_of(t, 5))
    out["T3"] = t3[5] * -(v**3) + t3[4] * (3 * v**2 + 3 * v**3) + t3[3] * (-6 * v**2 - 3 * v - 3 * v**3) + t3[2] * (1 + 3 * v + v**3 + 3 * v**2)
    slow = ema_of(c, 26)
    macd = ema_of(c, 12) - slow
    signal = ema_of(macd, 9)
    out |= {"MACD": macd, "MACD_signal": signal, "MACD_hist": macd - signal, "APO": macd, "PPO": _ratio(macd, slow) * 100}
    fixed = ewm(c, 0.15, 12) - ewm(c, 0.075, 26)
    out |= {"MACDFIX": fixed, "MACDFIX_signal": ema_of(fixed, 9)}
    up, down = (wilder(each(lambda x, sign=sign: np.maximum(sign * x, 0), o.step), 14) for sign in (1, -1))
    rsi = _ratio(up, up + down) * 100
    moves = directional(o, 14)
    out |= {"RSI": rsi, "CMO": _ratio(up - down, up + down) * 100, **moves, "NATR": _ratio(moves["ATR"], c) * 100}
    low = windows(rsi, 14, lambda w: np.min(w, axis=1))
    fast = each(lambda x, lo, hi: 100 * _divide(x - lo, hi - lo), rsi, low, windows(rsi, 14, lambda w: np.max(w, axis=1)))
    out |= {"STOCHRSI_fastk": fast, "STOCHRSI_fastd": windows(fast, 3, lambda w: np.mean(w, axis=1))}
    out["TRIX"] = each(lambda now, past: 100 * (_divide(now, past) - 1), e3, before(e3, 1))
    out["KAMA"] = kama(c, 30)

    def flow(c: np.ndarray, h: np.ndarray, low: np.ndarray, volume: np.ndarray) -> np.ndarray:
        return np.where(h != low, _divide((c - low) - (h - c), h - low), 0.0) * volume

    line = total(each(flow, c, o.high, o.low, o.volume))
    out["ADOSC"] = ewm(line, 2 / 4, 1) - ewm(line, 2 / 11, 1)
    return out


class Stop:
    """Parabolic stop and reverse, fed batch after batch; negative while falling, the first direction is that of the first move."""

    NAMES = ["SAREXT", "SAR"]

    def __init__(self, step: float = 0.02, most: float = 0.2) -> None:
        self.step, self.most, self.row = step, most, 0
        self.rising, self.stop, self.extreme, self.k = True, np.nan, np.nan, step
        self.high = self.low = np.nan

    def _next(self, h: float, low: float) -> float:
        if self.row == 0:
            return np.nan
        if self.row == 1:
            self.rising = h - self.high >= self.low - low
            self.stop, self.extreme = (self.low, h) if self.rising else (self.high, low)
        turned = low <= self.stop if self.rising else h >= self.stop
        if turned:
            self.rising, self.stop, self.k = not self.rising, self.extreme, self.step
            self.extreme = h if self.rising else low
            out = self.stop = self._held(h, low)
        else:
            out = self.stop
            if h > self.extreme if self.rising else low < self.extreme:
                self.extreme, self.k = (h if self.rising else low), min(self.k + self.step, self.most)
            self.stop += self.k * (self.extreme - self.stop)
            self.stop = self._held(h, low)
        return out if self.rising else -out

    def _held(self, h: float, low: float) -> float:
        """The stop beyond the last two bars."""
        return min(self.stop, self.low, low) if self.rising else max(self.stop, self.high, h)

    def feed(self, o: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = []
        for h, low in zip(o["high"].tolist(), o["low"].tolist(), strict=True):
            out.append(self._next(h, low))
            self.high, self.low, self.row = h, low, self.row + 1
        stops = np.array(out, dtype=float)
        return {"SAREXT": stops, "SAR": np.abs(stops)}


class Cycle:
    """Dominant cycle by the Hilbert transform: period, phase, phasor, sine, trend mode, trend line, adaptive means.

    Prices are smoothed with weights 4 to 1, a four-tap Hilbert filter (whose gain follows the last
    period) gives the quadrature, and the angle between neighbouring phasors the period, held
    within 6 to 50 bars and to a change of a half per step. The first 32 bars are null. No period exceeds 50
    bars, so the last 64 are all that a batch needs of those before it.
    """

    NAMES = [
        "HT_DCPERIOD", "HT_DCPHASE", "HT_PHASOR_inphase", "HT_PHASOR_quadrature", "HT_SINE_sine", "HT_SINE_leadsine", "HT_TRENDMODE", "HT_TRENDLINE", "MAMA_mama", "MAMA_fama",
    ]
    KEEP = 64

    def __init__(self) -> None:
        self.row, self.past = 0, {k: np.zeros(self.KEEP) for k in ("price", "smooth", "detrend", "q1", "i1")}
        self.period = self.smooth_period = self.i2 = self.q2 = self.re = self.im = self.phase = self.angle = self.sine = self.lead = 0.0
        self.mama = self.fama = None
        self.days, self.lines = 0, []

    def feed(self, o: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        new = np.where(np.isnan(o["close"]), (o["high"] + o["low"]) / 2, o["close"])
        arrays = {k: np.concatenate([x, np.zeros(len(new))]) for k, x in self.past.items()}
        arrays["price"][self.KEEP :] = new
        out = {k: np.full(len(new), np.nan) for k in self.NAMES}
        for at in range(len(new)):
            if self.mama is None:
                self.mama = self.fama = float(new[at])
            if self.row >= 6:
                values = self._next(arrays, self.KEEP + at)
                if self.row >= 32:
                    for k, x in zip(self.NAMES, values, strict=True):
                        out[k][at] = x
            self.row += 1
        self.past = {k: x[-self.KEEP :].copy() for k, x in arrays.items()}
        return out

    def _next(self, arrays: dict[str, np.ndarray], i: int) -> tuple[float, ...]:
        price, smooth, detrend, q1, i1 = (arrays[k] for k in ("price", "smooth", "detrend", "q1", "i1"))
        gain = 0.075 * self.period + 0.54

        def hilbert(x: np.ndarray) -> float:
            return (0.0962 * x[i] + 0.5769 * x[i - 2] - 0.5769 * x[i - 4] - 0.0962 * x[i - 6]) * gain

        smooth[i] = (4 * price[i] + 3 * price[i - 1] + 2 * price[i - 2] + price[i - 3]) / 10
        detrend[i] = hilbert(smooth)
        q1[i], i1[i] = hilbert(detrend), detrend[i - 3]
        ji, jq = hilbert(i1), hilbert(q1)
        i2, q2 = 0.2 * (i1[i] - jq) + 0.8 * self.i2, 0.2 * (q1[i] + ji) + 0.8 * self.q2
        self.re, self.im = 0.2 * (i2 * self.i2 + q2 * self.q2) + 0.8 * self.re, 0.2 * (i2 * self.q2 - q2 * self.i2) + 0.8 * self.im
        self.i2, self.q2 = i2, q2
        new = 2 * np.pi / np.arctan(self.im / self.re) if self.im and self.re else self.period
        if self.period:
            new = min(max(new, 0.67 * self.period), 1.5 * self.period)
        self.period = 0.2 * min(max(new, 6.0), 50.0) + 0.8 * self.period
        self.smooth_period = 0.33 * self.period + 0.67 * self.smooth_period
        angle = np.degrees(np.arctan(q1[i] / i1[i])) if i1[i] else 0.0
        rate = min(max(0.5 / max(self.angle - angle, 1.0), 0.05), 0.5)
        self.angle = angle
        self.mama += rate * (price[i] - self.mama)
        self.fama += 0.5 * rate * (self.mama - self.fama)
        length = min(int(self.smooth_period + 0.5), self.row + 1)
        turn = 2 * np.pi * np.arange(length) / max(length, 1)
        own = smooth[i - np.arange(length)]
        real, imag = float((np.sin(turn) * own).sum()), float((np.cos(turn) * own).sum())
        phase = np.degrees(np.arctan(real / imag)) if abs(imag) > 1e-3 else 90.0 * np.sign(real)
        phase += 90 + (360 / self.smooth_period if self.smooth_period else 0) + (180 if imag < 0 else 0)
        phase -= 360 if phase > 315 else 0
        sine, lead = np.sin(np.radians(phase)), np.sin(np.radians(phase + 45))
        self.lines = [*self.lines[-3:], price[i - np.arange(length)].mean() if length else price[i]]
        weights = (4, 3, 2, 1)[: len(self.lines)]
        line = np.dot(self.lines[::-1], weights) / sum(weights)
        crossed = (sine > lead) != (self.sine > self.lead)
        self.days = 0 if crossed else self.days + 1
        step, period = phase - self.phase, self.smooth_period
        trend = self.days >= 0.5 * period and not (period and 0.67 * 360 / period < step < 1.5 * 360 / period)
        trend = trend or line != 0 and abs((smooth[i] - line) / line) >= 0.015
        self.phase, self.sine, self.lead = phase, sine, lead
        return period, phase, i1[i], q1[i], sine, lead, float(trend), line, self.mama, self.fama


class Folds:
    """The folds whose state doesn't compose, side by side."""

    NAMES = [*Stop.NAMES, *Cycle.NAMES]

    def __init__(self) -> None:
        self.folds = [Stop(), Cycle()]

    def feed(self, o: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {k: x for f in self.folds for k, x in f.feed(o).items()}


RECURSIVE = [*Folds.NAMES, *recursive_values()]


def with_recursive(df: DataFrame, by: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """Every recursive indicator, default periods.

    Linear recurrences run over ranges of a series; the parabolic stop and the Hilbert indicators, whose
    recurrences don't compose, stream each series through one task.
    """
    folded = with_fold(df, by, order, ["high", "low", "close"], Folds, Folds.NAMES)
    return with_values(folded, by, order, recursive_values(), ranges)


def with_smoothed(df: DataFrame, by: list[str], order: list[str], names: list[str], ranges: int | None = None) -> DataFrame:
    """The named ones of the linear recurrences, in as many passes as they need."""
    found = recursive_values()
    return with_values(df, by, order, {n: found[n] for n in names}, ranges)


# Candle patterns: 100 for a bullish, -100 for a bearish one, else 0.

def with_patterns(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Patterns of one to three candles; sizes are judged against the mean body or range of the ten bars before."""
    w = Window.partitionBy(*by).orderBy(*order)
    past = w.rowsBetween(-10, -1)
    o, h, low, c = (F.col(x).cast("double") for x in ("open", "high", "low", "close"))
    df = df.withColumns({
        "_body": F.abs(c - o), "_range": h - low, "_up": h - F.greatest(o, c), "_down": F.least(o, c) - low, "_sign": F.when(c >= o, 1).otherwise(-1),
    }).withColumns({"_avg": F.avg("_body").over(past), "_avgr": F.avg("_range").over(past)})
    body, rng, up, down, sign = (F.col(x) for x in ("_body", "_range", "_up", "_down", "_sign"))
    doji, long_, short_ = body <= 0.1 * F.col("_avgr"), body > F.col("_avg"), body < F.col("_avg")
    small_up, small_down = up < 0.1 * F.col("_avgr"), down < 0.1 * F.col("_avgr")
    lag = lambda x, k=1: F.lag(x, k).over(w)
    mark = lambda rule, value: F.when(F.coalesce(rule, F.lit(False)), value).otherwise(0).cast("int")
    o1, c1, o2, c2 = lag("open"), lag("close"), lag("open", 2), lag("close", 2)
    df = df.withColumns({"_long": long_, "_short": short_, "_doji": doji})
    top, bottom = F.greatest(o, c), F.least(o, c)
    top1, bottom1 = F.greatest(o1, c1), F.least(o1, c1)
    new = {
        "CDLDOJI": mark(doji, 100), "CDLDRAGONFLYDOJI": mark(doji & small_up & ~small_down, 100), "CDLGRAVESTONEDOJI": mark(doji & small_down & ~small_up, 100),
        "CDLLONGLEGGEDDOJI": mark(doji & ((up > body) | (down > body)) & ~small_up, 100), "CDLMARUBOZU": mark(long_ & small_up & small_down, 100 * sign),
        "CDLLONGLINE": mark(long_ & (up < body) & (down < body), 100 * sign), "CDLSHORTLINE": mark(short_ & (up < body) & (down < body), 100 * sign),
        "CDLSPINNINGTOP": mark(short_ & (up > body) & (down > body), 100 * sign), "CDLHIGHWAVE": mark(short_ & (up > 2 * body) & (down > 2 * body), 100 * sign),
        "CDLCLOSINGMARUBOZU": mark(long_ & F.when(sign > 0, small_up).otherwise(small_down), 100 * sign),
        "CDLBELTHOLD": mark(long_ & F.when(sign > 0, small_down).otherwise(small_up), 100 * sign),
        "CDLHAMMER": mark(short_ & (down > 2 * body) & small_up & (bottom <= lag("low") + 0.2 * F.col("_avgr")), 100),
        "CDLHANGINGMAN": mark(short_ & (down > 2 * body) & small_up & (bottom >= lag("high") - 0.2 * F.col("_avgr")), -100),
        "CDLINVERTEDHAMMER": mark(short_ & (up > 2 * body) & small_down & (top < bottom1), 100), "CDLSHOOTINGSTAR": mark(short_ & (up > 2 * body) & small_down & (bottom > top1), -100),
        "CDLENGULFING": mark((sign != lag("_sign")) & (top >= top1) & (bottom <= bottom1) & ((top > top1) | (bottom < bottom1)), 100 * sign),
        "CDLHARAMI": mark(lag("_long") & short_ & (top <= top1) & (bottom >= bottom1), -100 * lag("_sign")),
        "CDLHARAMICROSS": mark(lag("_long") & doji & (top <= top1) & (bottom >= bottom1), -100 * lag("_sign")),
        "CDLPIERCING": mark((lag("_sign") < 0) & (sign > 0) & lag("_long") & (o < lag("low")) & (c > (o1 + c1) / 2) & (c < o1), 100),
        "CDLDARKCLOUDCOVER": mark((lag("_sign") > 0) & (sign < 0) & lag("_long") & (o > lag("high")) & (c < (o1 + c1) / 2) & (c > o1), -100),
        "CDLMORNINGSTAR": mark((lag("_sign", 2) < 0) & lag("_long", 2) & lag("_short") & (top1 < c2) & (sign > 0) & (c > (o2 + c2) / 2), 100),
        "CDLEVENINGSTAR": mark((lag("_sign", 2) > 0) & lag("_long", 2) & lag("_short") & (bottom1 > c2) & (sign < 0) & (c < (o2 + c2) / 2), -100),
        "CDL3WHITESOLDIERS": mark((sign > 0) & (lag("_sign") > 0) & (lag("_sign", 2) > 0) & (c > c1) & (c1 > c2) & (o > o1) & (o < c1) & (o1 > o2) & (o1 < c2) & small_up, 100),
        "CDL3BLACKCROWS": mark((sign < 0) & (lag("_sign") < 0) & (lag("_sign", 2) < 0) & (c < c1) & (c1 < c2) & (o < o1) & (o > c1) & (o1 < o2) & (o1 > c2) & small_down, -100),
        "CDL3INSIDE": mark(lag("_long", 2) & lag("_short") & (top1 <= F.greatest(o2, c2)) & (bottom1 >= F.least(o2, c2)) & (sign != lag("_sign", 2)) & F.when(sign > 0, c > o2).otherwise(c < o2), 100 * sign),
        "CDL3OUTSIDE": mark((lag("_sign") != lag("_sign", 2)) & (top1 >= F.greatest(o2, c2)) & (bottom1 <= F.least(o2, c2)) & F.when(lag("_sign") > 0, c > c1).otherwise(c < c1), 100 * lag("_sign")),
        "CDLTRISTAR": mark(doji & lag("_doji") & lag("_doji", 2) & ((bottom1 > F.greatest(o2, c2)) & (top < top1) | (top1 < F.least(o2, c2)) & (bottom > bottom1)), F.when(top < top1, -100).otherwise(100)),
        "CDLMATCHINGLOW": mark((sign < 0) & (lag("_sign") < 0) & (F.abs(c - c1) <= 0.05 * F.col("_avgr")), 100), "CDLDOJISTAR": mark(lag("_long") & doji & F.when(lag("_sign") > 0, bottom > top1).otherwise(top < bottom1), -100 * lag("_sign")),
    }
    df = df.withColumns(new).drop("_body", "_range", "_up", "_down", "_sign", "_avg", "_avgr", "_long", "_short", "_doji")
    for step in patterns.helpers(w):
        df = df.withColumns(step)
    return df.withColumns(patterns.rules(w)).drop(*patterns.HELPERS)


def with_sweep(df: DataFrame, by: list[str], order: list[str], periods: tuple[int, ...] = SWEEP, ranges: int | None = None) -> DataFrame:
    """Directional indicators, EMA distances and MACD lines at every period of a sweep, over ranges of a series."""
    return with_values(df, by, order, sweep_values(periods), ranges)
