"""Streams with a state per series: exponential means and greedy selection.

Rows of a series must come in order between micro-batches; inside one they are sorted. The state is
a few numbers a series, kept in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ticktide.operators.ranges import linear


def streaming_ema(ticks: DataFrame, key: str, order: list[str], value: str, rate: float) -> DataFrame:
    """All rows with `ema`: m += (x - m) / rate from the series' first value on."""
    schema = T.StructType([*ticks.schema.fields, T.StructField("ema", T.DoubleType())])

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        x = rows[value].astype(float).to_numpy()
        known = ~np.isnan(x)
        slope, push = np.where(known, 1 - 1 / rate, 1.0), np.where(known, np.nan_to_num(x) / rate, 0.0)
        first = int(known.argmax()) if known.any() and not state.exists else 0
        if known.any() and not state.exists:  # the first value is the mean
            slope[first], push[first] = 0.0, x[first]
        mean = linear(slope, push, state.get[0] if state.exists else 0.0)
        if not state.exists:
            mean[: first if known.any() else len(mean)] = np.nan
        if len(mean) and not np.isnan(mean[-1]):
            state.update((float(mean[-1]),))
        yield rows.assign(ema=pd.Series(mean, index=rows.index, dtype=float))

    return ticks.groupBy(key).applyInPandasWithState(run, schema, "mean double", "append", GroupStateTimeout.NoTimeout)


def streaming_jump(ticks: DataFrame, key: str, order: list[str], cond: str, span: int) -> DataFrame:
    """All rows with `taken`: rows with `cond` at least `span` rows after the last one taken."""
    schema = T.StructType([*ticks.schema.fields, T.StructField("taken", T.BooleanType())])

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wait = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for hit in rows[cond].fillna(False).astype(bool):
            out.append(bool(hit and wait <= 0))
            wait = span - 1 if out[-1] else wait - 1
        state.update((max(int(wait), 0),))
        yield rows.assign(taken=out)

    return ticks.groupBy(key).applyInPandasWithState(run, schema, "wait long", "append", GroupStateTimeout.NoTimeout)
