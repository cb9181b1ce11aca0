"""Exact quantiles of whole columns by the digits of the values: no sort, no buffer of values.

A double maps to a long that rises with it (sign, exponent, mantissa). Each round counts the rows that share
the digits known so far by their next digit of 11 bits, for all columns and places asked for at once, and
keeps the digit in which the place lies; a digit whose rows are all equal ends the search. Six rounds are
enough for any column; a round's state is a row per digit and place asked for, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 11
SIGNIFICAND = 1 << 52
LEAST, MOST = -1022, 1023


def ordered(x: Column) -> Column:
    """A long that rises with the double `x`: biased exponent, then mantissa, with the sign; NaN is the largest, both zeros are 0."""
    size = F.abs(x)
    guess = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(F.log2(size)).cast("int")))
    rough = size / F.pow(F.lit(2.0), guess.cast("double"))  # the logarithm may be one off
    up, down = rough >= 2, (rough < 1) & (guess > LEAST)
    exponent = F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)
    part = F.when(up, rough / 2).when(down, rough * 2).otherwise(rough)
    # below the least exponent the leading one is missing, which is the step down to the bias of 0
    code = (exponent - LEAST).cast("long") * SIGNIFICAND + F.floor(part * float(SIGNIFICAND)).cast("long")
    return (
        F.when(F.isnan(x), F.lit(2047 * SIGNIFICAND + 1))
        .when(size == float("inf"), F.signum(x).cast("long") * (2047 * SIGNIFICAND))
        .when(x == 0, F.lit(0).cast("long"))
        .otherwise(F.signum(x).cast("long") * code)
    )


def order_statistics(df: DataFrame, columns: dict[str, Column], places: dict[str, Callable[[int], Iterable[int]] | Iterable[int]] | None = None, shares: Iterable[float] = ()) -> dict[str, tuple[int, dict[int, float]]]:
    """Per column: the number of its values, and the values at the places asked for (from 0, in rising order).

    Places are given, or a function of the number gives them, or they follow from `shares`: those on both sides of
    share * (n - 1). Nulls don't count.
    """
    names, shares = list(columns), list(shares)
    x = F.col("v")
    cells = F.array(*[F.struct(F.lit(k).alias("c"), columns[n].cast("double").alias("v")) for k, n in enumerate(names)])
    rows = df.select(F.explode(cells).alias("x")).select("x.c", "x.v").filter("v IS NOT NULL").withColumn("key", ordered(x))
    # by column and known digits: the places asked for, and how many rows with these digits lie before each
    known: dict[tuple[int, int], dict[int, int]] = {(k, 0): {} for k in range(len(names))}
    counts: dict[int, int] = {}
    found: dict[int, dict[int, float]] = {k: {} for k in range(len(names))}
    shift, first = 64, True
    while known and shift > 0:
        low = max(shift - BITS, 0)
        prefix = F.lit(0).cast("long") if first else F.shiftright("key", shift)
        here = rows if first else rows.filter(_any(known, prefix))
        digits = here.groupBy("c", prefix.alias("prefix"), F.shiftright("key", low).alias("digit"))
        table: dict[tuple[int, int], list] = {}
        for r in digits.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            table.setdefault((r["c"], r["prefix"]), []).append((r["digit"], r["n"], r["low"], r["high"]))
        if first:
            counts = {k: sum(n for _, n, _, _ in table.get((k, 0), [])) for k in range(len(names))}
            for k, name in enumerate(names):
                n = counts[k]
                own = (places or {}).get(name, ())
                asked = (own(n) if callable(own) else own) if places is not None else {p for s in shares for p in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))}
                known[k, 0] = {p: p for p in asked or () if 0 <= p < n}
        following: dict[tuple[int, int], dict[int, int]] = {}
        for (k, digit), wanted in known.items():
            cells_ = sorted(table.get((k, digit), []), key=lambda t: t[0])
            for place, rest in wanted.items():
                before = 0
                for next_digit, n, least, most in cells_:
                    if rest < before + n:
                        if low == 0 or least == most:
                            found[k][place] = least
                        else:
                            following.setdefault((k, next_digit), {})[place] = rest - before
                        break
                    before += n
        known, shift, first = following, low, False
    return {name: (counts.get(k, 0), found[k]) for k, name in enumerate(names)}


def _any(known: dict[tuple[int, int], dict[int, int]], prefix: Column) -> Column:
    by: dict[int, list[int]] = {}
    for k, digit in known:
        by.setdefault(k, []).append(digit)
    out = F.lit(False)
    for k, digits in by.items():
        out = out | ((F.col("c") == k) & prefix.isin(digits))
    return out


def quantiles(df: DataFrame, columns: dict[str, Column], shares: Iterable[float]) -> dict[str, list[float]]:
    """Quantiles of each column by linear interpolation between neighbours; none for a column without values."""
    shares = list(shares)
    out: dict[str, list[float]] = {}
    for name, (n, values) in order_statistics(df, columns, shares=shares).items():
        own = []
        for s in shares if n else ():
            at = s * (n - 1)
            a, b = values[math.floor(at)], values[math.ceil(at)]
            own.append(a if a == b else a * (math.ceil(at) - at) + b * (at - math.floor(at)))
        out[name] = own
    return out
