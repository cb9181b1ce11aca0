"""Recursive indicators of one series as plain loops, to hold the ranged forms against."""

from collections.abc import Callable

import numpy as np

from ticktide.operators.indicators import SWEEP, macd_grid


def sweep(o: dict[str, np.ndarray], periods: tuple[int, ...] = SWEEP) -> dict[str, np.ndarray]:
    """The recursive indicators whose periods are swept, of one series."""
    out: dict[str, np.ndarray] = {}
    for n in periods:
        out |= {f"EMA_{n}": ema_of(o["close"], n) - o["close"]} | {f"{k}_{n}": x for k, x in directional(o, n).items() if k in ("ADX", "ATR", "PLUS_DM", "MINUS_DM", "PLUS_DI", "MINUS_DI")}
    for f, s, signal in macd_grid(periods):
        line = ema_of(o["close"], f) - ema_of(o["close"], s)
        out[f"MACD_{f}_{s}"] = line
        out[f"MACD_hist_{f}_{s}"] = line - ema_of(line, max(signal, 1))
        fixed = _ewm(o["close"], 0.15, 12) - _ewm(o["close"], 0.075, 26)
        out[f"MACDFIX_hist_{max(signal, 1)}"] = fixed - ema_of(fixed, max(signal, 1))
    return out


def _ewm(x: np.ndarray, alpha: float, start: int) -> np.ndarray:
    """Exponential mean seeded with the mean of the first `start` values; nulls leave it as it is."""
    out, state, seed = np.full(len(x), np.nan), None, []
    for i, v in enumerate(x.tolist()):
        if v == v:
            if state is None:
                seed.append(v)
                if len(seed) == start:
                    state = sum(seed) / start
            else:
                state += alpha * (v - state)
        if state is not None:
            out[i] = state
    return out


def ema_of(x: np.ndarray, n: int) -> np.ndarray:
    return _ewm(x, 2 / (n + 1), n)


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return _ewm(x, 1 / n, n)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b, np.nan)


def _extreme(x: np.ndarray, n: int, pick: Callable[..., np.ndarray]) -> np.ndarray:
    """pick over the last n values; null where one is missing."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = pick(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)
    return out


def directional(o: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """True range and directional movement, smoothed over n bars."""
    c, h, low = o["close"], o["high"], o["low"]
    before = np.concatenate([[np.nan], c[:-1]])
    tr = np.where(np.isnan(before), np.nan, np.maximum(h - low, np.maximum(np.abs(h - before), np.abs(low - before))))
    atr = wilder(tr, n)
    dh, dl = np.diff(h, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus, minus = (np.where(np.isnan(dh), np.nan, np.where((a > b) & (a > 0), a, 0.0)) for a, b in ((dh, dl), (dl, dh)))
    pdm, mdm = wilder(plus, n), wilder(minus, n)
    pdi, mdi = 100 * _ratio(pdm, atr), 100 * _ratio(mdm, atr)
    dx = 100 * _ratio(np.abs(pdi - mdi), pdi + mdi)
    adx = wilder(dx, n)
    earlier = np.concatenate([np.full(n - 1, np.nan), adx[: max(0, len(adx) - n + 1)]])[: len(adx)]
    return {"ATR": atr, "PLUS_DM": n * pdm, "MINUS_DM": n * mdm, "PLUS_DI": pdi, "MINUS_DI": mdi, "DX": dx, "ADX": adx, "ADXR": (adx + earlier) / 2}


def recursive(o: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Every recursive indicator of one series, default periods."""
    c, h, low = o["close"], o["high"], o["low"]
    e1 = ema_of(c, 30)
    e2 = ema_of(e1, 30)
    e3 = ema_of(e2, 30)
    out = {"EMA": e1, "DEMA": 2 * e1 - e2, "TEMA": 3 * e1 - 3 * e2 + e3}
    t, v = c, 0.7
    t3 = [t := ema_of(t, 5) for _ in range(6)]
    out["T3"] = -(v**3) * t3[5] + (3 * v**2 + 3 * v**3) * t3[4] + (-6 * v**2 - 3 * v - 3 * v**3) * t3[3] + (1 + 3 * v + v**3 + 3 * v**2) * t3[2]
    macd = ema_of(c, 12) - ema_of(c, 26)
    signal = ema_of(macd, 9)
    out |= {"MACD": macd, "MACD_signal": signal, "MACD_hist": macd - signal, "APO": macd, "PPO": 100 * _ratio(macd, ema_of(c, 26))}
    fixed = _ewm(c, 0.15, 12) - _ewm(c, 0.075, 26)
    out |= {"MACDFIX": fixed, "MACDFIX_signal": ema_of(fixed, 9)}
    step = np.diff(c, prepend=np.nan)
    up, down = wilder(np.where(np.isnan(step), np.nan, np.maximum(step, 0)), 14), wilder(np.where(np.isnan(step), np.nan, np.maximum(-step, 0)), 14)
    out |= {"RSI": 100 * _ratio(up, up + down), "CMO": 100 * _ratio(up - down, up + down)}
    moves = directional(o, 14)
    out |= {**moves, "NATR": 100 * _ratio(moves["ATR"], c)}
    rsi_high, rsi_low = _extreme(out["RSI"], 14, np.max), _extreme(out["RSI"], 14, np.min)
    fast = 100 * _ratio(out["RSI"] - rsi_low, rsi_high - rsi_low)
    out |= {"STOCHRSI_fastk": fast, "STOCHRSI_fastd": _extreme(fast, 3, np.mean)}
    x = c
    for _ in range(3):
        x = ema_of(x, 30)
    out["TRIX"] = 100 * (_ratio(x, np.concatenate([[np.nan], x[:-1]])) - 1)
    out["KAMA"] = _kama(c, 30)
    out["SAREXT"] = _sar(h, low)
    out["SAR"] = np.abs(out["SAREXT"])
    out |= cycle(c, (h + low) / 2)
    span = h - low
    flow = np.cumsum(np.where(span != 0, _ratio((c - low) - (h - c), span), 0.0) * o["volume"])
    out["ADOSC"] = _ewm(flow, 2 / 4, 1) - _ewm(flow, 2 / 11, 1)
    return out


def _kama(c: np.ndarray, n: int) -> np.ndarray:
    """Adaptive mean: the smoothing follows the ratio of net to total movement over n steps."""
    out, state = np.full(len(c), np.nan), np.nan
    for i in range(n, len(c)):
        moved = np.abs(np.diff(c[i - n : i + 1])).sum()
        ratio = abs(c[i] - c[i - n]) / moved if moved > 0 else 1.0
        if state != state:
            state = c[i - 1]
        k = (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        if c[i] == c[i]:
            state += k * (c[i] - state)
        out[i] = state
    return out


def _sar(h: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    """Parabolic stop and reverse, negative while falling; the first direction is that of the first move."""
    out = np.full(len(h), np.nan)
    if len(h) < 2:
        return out
    rising = h[1] - h[0] >= low[0] - low[1]
    stop, extreme, k = (low[0], h[1], step) if rising else (h[0], low[1], step)
    for i in range(1, len(h)):
        if (low[i] <= stop) if rising else (h[i] >= stop):
            rising, stop, k = not rising, extreme, step
            extreme = h[i] if rising else low[i]
            stop = min(stop, low[i - 1], low[i]) if rising else max(stop, h[i - 1], h[i])
            out[i] = stop if rising else -stop
            continue
        out[i] = stop if rising else -stop
        if (h[i] > extreme) if rising else (low[i] < extreme):
            extreme, k = (h[i] if rising else low[i]), min(k + step, most)
        stop = stop + k * (extreme - stop)
        stop = min(stop, low[i - 1], low[i]) if rising else max(stop, h[i - 1], h[i])
    return out


def cycle(close: np.ndarray, middle: np.ndarray) -> dict[str, np.ndarray]:
    """Dominant cycle by the Hilbert transform: period, phase, phasor, sine, trend mode, trend line, adaptive means.

    Prices are smoothed with weights 4 to 1, a four-tap Hilbert filter (whose gain follows the last
    period) gives the quadrature, and the angle between neighbouring phasors the period, held
    within 6 to 50 bars and to a change of a half per step. The first 32 bars are null.
    """
    n = len(close)
    out = {k: np.full(n, np.nan) for k in ("HT_DCPERIOD", "HT_DCPHASE", "HT_PHASOR_inphase", "HT_PHASOR_quadrature", "HT_SINE_sine", "HT_SINE_leadsine", "HT_TRENDMODE", "HT_TRENDLINE", "MAMA_mama", "MAMA_fama")}
    price = np.where(np.isnan(close), middle, close)
    smooth, detrend, q1, i1 = (np.zeros(n) for _ in range(4))
    period = smooth_period = i2 = q2 = re = im = phase_before = 0.0
    mama = fama = float(price[0]) if n else 0.0
    angle_before, days_in_trend, sine_before, lead_before, trend_line = 0.0, 0, 0.0, 0.0, []

    def hilbert(x: np.ndarray, i: int, gain: float) -> float:
        return (0.0962 * x[i] + 0.5769 * x[i - 2] - 0.5769 * x[i - 4] - 0.0962 * x[i - 6]) * gain

    for i in range(6, n):
        gain = 0.075 * period + 0.54
        smooth[i] = (4 * price[i] + 3 * price[i - 1] + 2 * price[i - 2] + price[i - 3]) / 10
        detrend[i] = hilbert(smooth, i, gain)
        q1[i], i1[i] = hilbert(detrend, i, gain), detrend[i - 3]
        ji, jq = hilbert(i1, i, gain), hilbert(q1, i, gain)
        before_i2, before_q2 = i2, q2
        i2, q2 = 0.2 * (i1[i] - jq) + 0.8 * i2, 0.2 * (q1[i] + ji) + 0.8 * q2
        re, im = 0.2 * (i2 * before_i2 + q2 * before_q2) + 0.8 * re, 0.2 * (i2 * before_q2 - q2 * before_i2) + 0.8 * im
        new = 2 * np.pi / np.arctan(im / re) if im and re else period
        if period:
            new = min(max(new, 0.67 * period), 1.5 * period)
        period = 0.2 * min(max(new, 6.0), 50.0) + 0.8 * period
        smooth_period = 0.33 * period + 0.67 * smooth_period
        angle = np.degrees(np.arctan(q1[i] / i1[i])) if i1[i] else 0.0
        rate = min(max(0.5 / max(angle_before - angle, 1.0), 0.05), 0.5)
        angle_before = angle
        mama += rate * (price[i] - mama)
        fama += 0.5 * rate * (mama - fama)
        length = min(int(smooth_period + 0.5), i + 1)
        turn = 2 * np.pi * np.arange(length) / max(length, 1)
        own = smooth[i - np.arange(length)]
        real, imag = float((np.sin(turn) * own).sum()), float((np.cos(turn) * own).sum())
        phase = np.degrees(np.arctan(real / imag)) if abs(imag) > 1e-3 else 90.0 * np.sign(real)
        phase += 90 + (360 / smooth_period if smooth_period else 0) + (180 if imag < 0 else 0)
        phase -= 360 if phase > 315 else 0
        sine, lead = np.sin(np.radians(phase)), np.sin(np.radians(phase + 45))
        trend_line.append(price[i - np.arange(length)].mean() if length else price[i])
        line = np.dot(trend_line[:-5:-1], (4, 3, 2, 1)[: len(trend_line)]) / sum((4, 3, 2, 1)[: len(trend_line)])
        crossed = (sine > lead) != (sine_before > lead_before)
        days_in_trend = 0 if crossed else days_in_trend + 1
        step = phase - phase_before
        trend = days_in_trend >= 0.5 * smooth_period and not (smooth_period and 0.67 * 360 / smooth_period < step < 1.5 * 360 / smooth_period)
        trend = trend or line != 0 and abs((smooth[i] - line) / line) >= 0.015
        phase_before, sine_before, lead_before = phase, sine, lead
        if i >= 32:
            values = (smooth_period, phase, i1[i], q1[i], sine, lead, float(trend), line, mama, fama)
            for k, x in zip(out, values, strict=True):
                out[k][i] = x
    return out
