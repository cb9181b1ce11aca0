"""Price-volume maps: map<bigint,bigint> columns from integer price to integer volume.

A Spark map has no order, so whatever depends on the order of prices sorts the entries itself.
Null maps count as empty. Every function returns a Column of built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import pairwise
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "map<bigint,bigint>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where the body uses it in a lambda, row by row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty() -> Column:
    return F.create_map().cast(TYPE)


def or_empty(m: Column) -> Column:
    return F.coalesce(m, empty())


def get(m: Column, price: Column) -> Column:
    """The volume at a price, 0 where there is none."""
    return F.coalesce(F.try_element_at(m, price), F.lit(0).cast("bigint"))


def _levels(prices: list[Column], volumes: list[Column]) -> tuple[list[Column], Callable[[Column], Column]]:
    """Prices that count (positive ones), and the volume at a price by plain comparisons."""
    ps = [F.when(p > 0, p.cast("bigint")) for p in prices]
    vs = [F.coalesce(v, F.lit(0)).cast("bigint") for v in volumes]

    def at(k: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for p, v in zip(ps, vs, strict=True):
            out = out + F.when(p == k, v).otherwise(F.lit(0).cast("bigint"))
        return out

    return ps, at


def from_levels(prices: list[Column], volumes: list[Column]) -> Column:
    """Levels with a null, zero or negative price are left out; equal prices add up."""
    ps, at = _levels(prices, volumes)
    known = F.array_distinct(F.array_compact(F.array(*ps)))
    return F.map_from_entries(F.transform(known, lambda k: F.struct(k.alias("key"), at(k).alias("value"))))


def populated_levels(prices: list[Column], volumes: list[Column]) -> Column:
    """`populate` of `from_levels`, without the map between. Levels one tick apart are taken as they are, others looked up."""
    ps, at = _levels(prices, volumes)
    vs = [F.coalesce(v, F.lit(0)).cast("bigint") for v in volumes]
    low, high = F.least(*ps), F.greatest(*ps)
    each = F.transform(F.sequence(low, high), lambda k: F.struct(k.alias("key"), at(k).alias("value")))

    def even(step: int) -> Column:
        return reduce(and_, [F.coalesce(b - a == step, F.lit(False)) for a, b in pairwise(ps)], F.lit(True))

    rising, falling = F.map_from_arrays(F.array(*ps), F.array(*vs)), F.map_from_arrays(F.array(*ps[::-1]), F.array(*vs[::-1]))
    return F.when(low.isNull(), empty()).when(even(1), rising).when(even(-1), falling).otherwise(F.map_from_entries(each))


def populate(m: Column) -> Column:
    """Every price between the smallest and the largest, 0 where there was none."""
    def filled(m: Column) -> Column:
        keys = F.map_keys(m)
        each = F.transform(F.sequence(F.array_min(keys), F.array_max(keys)), lambda k: F.struct(k.alias("key"), get(m, k).alias("value")))
        return F.when(F.size(m) > 0, F.map_from_entries(each)).otherwise(empty())

    return let(m, filled)


def negate_keys(m: Column) -> Column:
    return F.transform_keys(or_empty(m), lambda k, _: -k)


def negate(m: Column) -> Column:
    return F.transform_values(or_empty(m), lambda _, v: -v)


def clip(m: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Prices from `low` to `high`, both included; either end may be open."""
    def inside(k: Column, _: Column) -> Column:
        keep = F.lit(True)
        if low is not None:
            keep = keep & (k >= low)
        return keep if high is None else keep & (k <= high)

    return F.map_filter(or_empty(m), inside)


def nonzero(m: Column) -> Column:
    return F.map_filter(or_empty(m), lambda _, v: v != 0)


def positive(m: Column) -> Column:
    return F.map_filter(or_empty(m), lambda _, v: v > 0)


def negative(m: Column) -> Column:
    return F.map_filter(or_empty(m), lambda _, v: v < 0)


def add(a: Column, b: Column) -> Column:
    return F.map_zip_with(or_empty(a), or_empty(b), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def subtract(a: Column, b: Column) -> Column:
    return F.map_zip_with(or_empty(a), or_empty(b), lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))


def minimum(a: Column, b: Column) -> Column:
    """Prices of `b`, each with the smaller volume, where `a` has 0 at a price that it lacks."""
    return let(or_empty(a), lambda a: F.transform_values(or_empty(b), lambda k, v: F.least(get(a, k), v)))


def deduct(a: Column, b: Column) -> Column:
    """Prices of `a`, each less its volume in `b`."""
    return let(or_empty(b), lambda b: F.transform_values(or_empty(a), lambda k, v: v - get(b, k)))


def total(m: Column) -> Column:
    return F.aggregate(F.map_values(or_empty(m)), F.lit(0).cast("bigint"), lambda s, v: s + v)


def turnover(m: Column) -> Column:
    """Sum of price times volume."""
    return F.aggregate(F.map_entries(or_empty(m)), F.lit(0).cast("bigint"), lambda s, e: s + e["key"] * e["value"])


def average_price(m: Column) -> Column:
    return let(m, lambda m: F.try_divide(turnover(m), total(m)))


def lowest(m: Column) -> Column:
    return F.array_min(F.map_keys(positive(m)))


def highest(m: Column) -> Column:
    return F.array_max(F.map_keys(positive(m)))


def entries(m: Column, descending: bool = False) -> Column:
    """Entries in order of price."""
    return F.sort_array(F.map_entries(or_empty(m)), asc=not descending)


def cumulate(m: Column, descending: bool = False, amount: bool = False, clipped: bool = False) -> Column:
    """Running sums in price order, of volumes (or of price times volume), without negatives if clipped."""
    def value(e: Column) -> Column:
        v = F.greatest(e["value"], F.lit(0)) if clipped else e["value"]
        return e["key"] * v if amount else v

    def sums(rows: Column) -> Column:
        return F.aggregate(rows, F.array().cast("array<bigint>"), lambda acc, e: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + value(e)))

    return let(entries(m, descending), lambda rows: F.map_from_arrays(rows["key"], sums(rows)))
