"""Connected components of a graph whose edges are rows, by alternating star contraction.

A round joins every node's larger neighbours to its smallest neighbour (large star), then every
node's smaller neighbours to the smallest of them (small star). Neighbour minima are aggregates
with a map-side part, and nothing is gathered per node, so a hub with a third of all edges is no
hot task: the join back to the edges is one that adaptive execution can split. Each round's edges
are cut to the shared folder; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.llm.common import cut


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))


def _state(edges: DataFrame) -> tuple[int, int]:
    n, mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return n, mark or 0


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of `edges` (long columns u, v); root is the smallest node."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = edges_after = large.filter("u <> v").distinct()
        minima = _minima(low)
        small = (
            low.join(minima, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(minima.select("u", F.col("m").alias("v")))
        )
        edges_after = cut(small.filter("u <> v").distinct())
        after = _state(edges_after)
        edges = edges_after
        if after == state:
            break
        state = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
