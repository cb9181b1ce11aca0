"""Joins, deduplication, pivots and row classification."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ticktide.operators.quantiles import quantiles

NULL_WORDS = ("null", "NULL", "")


def columns_like(df: DataFrame, pattern: str, exclude: bool = False) -> list[str]:
    """Names in which the pattern is found (or is not)."""
    return [c for c in df.columns if bool(re.search(pattern, c)) != exclude]


def natural_order(names: list[str]) -> list[str]:
    """By stem, then by numeric suffix."""
    def key(name: str) -> tuple[str, int]:
        m = re.fullmatch(r"(.*?)(\d+)?", name)
        return m[1], int(m[2] or -1)

    return sorted(names, key=key)


def spread(df: DataFrame, *keys: str, tasks_per_core: int = 16) -> DataFrame:
    """The rows dealt evenly over tasks, for costly work row by row behind a window whose series are few or uneven.

    The number is fixed, as adaptive execution joins partitions by their bytes, which do not tell the work.
    """
    return df.repartition(tasks_per_core * df.sparkSession.sparkContext.defaultParallelism, *keys)


def with_prefix(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep})


def join_returns(factors: DataFrame, returns: DataFrame, keys: list[str], pattern: str = r"^O?M?R[MT]\d+$|WAP") -> DataFrame:
    """Inner join on the keys; of the right side only the return columns are read."""
    return factors.join(returns.select(*keys, *[c for c in columns_like(returns, pattern) if c not in keys]), keys)


def merge(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join with suffixes for the other columns that both sides have."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return a.join(b, keys, how)


def merge_all(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Inner join of all frames on the keys, other columns prefixed by the frame's name."""
    out: DataFrame | None = None
    for name, df in frames.items():
        df = with_prefix(df, f"{name}_", keys)
        out = df if out is None else out.join(df, keys)
    if out is None:
        raise ValueError("no frames")
    return out


def missing_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def clean_nulls(column: Column) -> Column:
    """Null-like words as the empty string."""
    return F.when(column.isNull() | column.isin(*NULL_WORDS), F.lit("")).otherwise(column)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def pivot_first(df: DataFrame, entity: list[str], field: str, value: str, order: list[str], fields: list[str]) -> DataFrame:
    """Entity-attribute-value rows as a wide row per entity: the first value of each named field."""
    first = F.min_by(F.col(value), F.struct(*order))
    return df.filter(F.col(field).isin(fields)).groupBy(*entity).pivot(field, fields).agg(first)


def one_of(column: str, values: str | list[str] | None) -> Column:
    """Predicate for a single value, a list, or all values (None or 'all')."""
    if values is None or values == "all":
        return F.lit(True)
    return F.col(column).isin(values) if isinstance(values, list) else F.col(column) == values


#: Sessions of a trading day in seconds from midnight, closed intervals; the night before is negative.
SESSIONS = {"day0": (-10800, -3600), "day1": (32400, 36900), "day2": (37800, 41400), "day3": (48600, 54000)}


def session_of(seconds: Column, sessions: dict[str, tuple[float, float]] = SESSIONS) -> Column:
    out = F.lit("")
    for name, (a, b) in reversed(sessions.items()):
        out = F.when(seconds.between(a, b), F.lit(name)).otherwise(out)
    return out


def classify(rules: list[tuple[int, Column]], default: int = -1) -> Column:
    """The code of the first rule that holds."""
    out = F.lit(default)
    for code, rule in reversed(rules):
        out = F.when(rule, F.lit(code)).otherwise(out)
    return out


def book_states(spread: str, spread_last: str, ask_change: str, bid_change: str) -> Column:
    """Seven states of a best-price change; -1 for none of them."""
    s, s0, a, b = (F.col(c) for c in (spread, spread_last, ask_change, bid_change))
    return classify([
        (0, (s == 1) & (s0 == 1) & (a == 0) & (b == 0)), (1, (s == 1) & (s0 == 1) & (a > 0) & (b > 0)), (2, (s == 1) & (s0 == 1) & (a < 0) & (b < 0)),
        (3, (s > 1) & (s0 == 1) & (a > 0)), (4, (s > 1) & (s0 == 1) & (b < 0)), (5, (s == 1) & (s0 > 1) & (a < 0)), (6, (s == 1) & (s0 > 1) & (b > 0)),
    ])


def erase_near_edges(column: Column, to_edge: Column, period: int = 60) -> Column:
    """Null within half a period of a session's edge."""
    return F.when(to_edge > period / 2, column)


#: Which sessions belong together: 0 the whole day, 1 night, morning and afternoon, 2 night and day.
SPLITS = {0: {}, 1: {"day0": "night", "day1": "morning", "day2": "morning", "day3": "afternoon"}, 2: {"day0": "night", "day1": "day", "day2": "day", "day3": "day"}}


def part_of_day(session: Column, split_type: int) -> Column:
    """The part of its day that a session belongs to; an unknown session is a part of its own."""
    out = F.lit("") if not SPLITS[split_type] else session
    for name, part in SPLITS[split_type].items():
        out = F.when(session == name, F.lit(part)).otherwise(out)
    return out


def with_edges(df: DataFrame, by: list[str], session: str, order: list[str]) -> DataFrame:
    """`from_begin<k>`, `to_end<k>` for the three split types: rows since the part of the day began, and up to its end."""
    for k in SPLITS:
        part = part_of_day(F.col(session), k)
        w = Window.partitionBy(*by, part).orderBy(*order)
        n = F.row_number().over(w)
        df = df.withColumns({f"from_begin{k}": n, f"to_end{k}": F.count(F.lit(1)).over(Window.partitionBy(*by, part)) - n + 1})
    return df


def erase_split(df: DataFrame, factors: dict[str, int], targets: dict[str, int], split_type: int = 1) -> DataFrame:
    """`erase_edges` by the distances that `with_edges` gives for a split type."""
    return erase_edges(df, f"from_begin{split_type}", f"to_end{split_type}", factors, targets)


def main_contract(df: DataFrame, symbol: str, volume: str, pattern: str) -> DataFrame:
    """The symbol like `pattern` with the largest volume; ties go to the first name. No row if none fits."""
    top = df.filter(F.col(symbol).rlike(pattern)).groupBy(symbol).agg(F.max(volume).alias("max_volume"))
    return top.orderBy(F.desc("max_volume"), symbol).limit(1)


def rows_around(df: DataFrame, order: list[Column], place: int, before: int, after: int) -> DataFrame:
    """Rows `before` to `after` a place (from 0, negative counts from the end) in the given order."""
    ordered = df.orderBy(*order)
    if place < 0:
        place += df.count()
    return ordered.offset(max(0, place - before)).limit(place + after + 1 - max(0, place - before))


def append(df: DataFrame, new: dict[str, Column] | Column) -> DataFrame:
    """Adds columns, from a dict or the fields of a struct; columns of the same name are replaced."""
    if isinstance(new, dict):
        return df.withColumns(new)
    wide = df.withColumn("_new", new)
    fields = wide.schema["_new"].dataType.names
    return wide.withColumns({f: F.col(f"_new.`{f}`") for f in fields}).drop("_new")


def append_last(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Adds columns behind all others; a column of the same name gives way to the new one."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in new]
    return df.select(*kept, *[v.alias(n) for n, v in new.items()])


def append_rows(df: DataFrame, callback: Callable[[dict], dict], schema: T.StructType | str) -> DataFrame:
    """Adds the columns that a Python callback makes of each row (a dict), behind all others; those of the same name give way.

    For callbacks that no expression states: rows pass through Python in Arrow batches. Fields that it leaves out are null.
    """
    made = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    kept = [f for f in df.schema.fields if f.name not in made.names]
    whole = T.StructType([*kept, *[T.StructField(f.name, f.dataType) for f in made.fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(whole)
        for batch in batches:
            found = [callback(row) or {} for row in batch.to_pylist()]
            new = [pa.array([row.get(f.name) for row in found], target.field(f.name).type) for f in made.fields]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *new], whole.names)

    return df.mapInArrow(run, whole)


def quantile_parts(df: DataFrame, column: str, shares: list[float]) -> list[Column]:
    """Predicates for the ranges between quantiles (linear interpolation) of `column`: (q0, q1], (q1, q2], ..."""
    cuts = quantiles(df, {column: F.col(column)}, shares)[column]
    return [(F.col(column) > a) & (F.col(column) <= b) for a, b in zip(cuts, cuts[1:], strict=False)]


def away_from_edges(begin: str, end: str, least_begin: float, least_end: float) -> Column:
    return (F.col(begin) > least_begin) & (F.col(end) > least_end)


def erase_edges(df: DataFrame, to_begin: str, to_end: str, factors: dict[str, int], targets: dict[str, int]) -> DataFrame:
    """Nulls factors near the session's begin and targets near its end: within half of each one's period."""
    new = {c: erase_near_edges(F.col(c), F.col(to_begin), p) for c, p in factors.items()}
    return df.withColumns(new | {c: erase_near_edges(F.col(c), F.col(to_end), p) for c, p in targets.items()})


def fill_missing(df: DataFrame, columns: list[str], empty: float = -999_999.0, null: float = -1.0) -> DataFrame:
    """Text columns of numbers as numbers: the empty text as `empty`, null as `null`.

    A column that holds any other text stays text (null as 'null'); one pass over all columns finds out.
    """
    text = {c: F.col(c).cast("string") for c in columns}
    bad = df.agg(*[F.count_if((text[c] != "") & F.expr(f"try_cast(`{c}` AS double)").isNull()).alias(c) for c in columns]).first()
    number = lambda c: F.when(F.col(c).isNull(), null).when(text[c] == "", empty).otherwise(F.expr(f"try_cast(`{c}` AS double)"))
    return df.withColumns({c: F.coalesce(text[c], F.lit("null")) if bad[c] else number(c) for c in columns})


def unstack(df: DataFrame, rows: str, columns: str, value: str, names: list[str]) -> DataFrame:
    """A matrix: a row per value of `rows`, a column per name."""
    return df.groupBy(rows).pivot(columns, names).agg(F.first(value, ignorenulls=True))


def long_quantile(df: DataFrame, keys: list[str], columns: list[str], share: float) -> DataFrame:
    """Rows (name, quantile) of each column, as of the table in long form; null where a column has no value and the table has rows."""
    found = quantiles(df, {c: F.col(c) for c in columns}, [share])
    rows = [(c, q[0] if q else None) for c, q in found.items()] if any(found.values()) or not df.select(*keys).isEmpty() else []
    return df.sparkSession.createDataFrame(rows, "name string, quantile double")


def mean_by_phase(df: DataFrame, place: Column, step: int, columns: list[str]) -> DataFrame:
    return df.groupBy((place % step).alias("phase")).agg(*[F.avg(c).alias(c) for c in columns])


def ends(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """`<c>_first` and `<c>_last` of each group."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(*[f(c, place).alias(f"{c}_{n}") for c in columns for f, n in ((F.min_by, "first"), (F.max_by, "last"))])


def facts(df: DataFrame, equal: dict[str, str | list[str] | None], day: str | None = None, since: str | None = None, until: str | None = None, any_of: list[Column] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """A filtered scan: values or lists per column, a closed range of days, alternatives, then renamed columns."""
    for column, values in equal.items():
        df = df.filter(one_of(column, values))
    if day and since is not None:
        df = df.filter(F.col(day) >= since)
    if day and until is not None:
        df = df.filter(F.col(day) <= until)
    if any_of:
        rule = any_of[0]
        for other in any_of[1:]:
            rule = rule | other
        df = df.filter(rule)
    return df.withColumnsRenamed(rename or {})
