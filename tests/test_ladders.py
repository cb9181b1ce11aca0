import random

import pytest
from pyspark.sql import functions as F

from ticktide.operators import microstructure as ms


def of(rows):
    return [{"key": p, "value": v} for p, v in rows]


CASES = [
    ([(1, 5), (3, 2)], [(1, 1), (2, 4), (4, 9)]), ([(1, 5), (10, 2)], [(2, 1), (5, 4)]), ([(1, 1), (5, 2)], [(2, 3), (10, 4)]), ([(2, 3)], [(2, 3)]), ([(7, 1)], [(2, 1), (3, 1)]),
    ([], [(1, 1)]), ([(1, 1)], []), ([], []), (None, [(4, 2)]),
]


def plain(a, b, sign, bounded, down):
    a, b = a or [], b or []
    if bounded and not (a and b):
        return []
    out = {p: 0 for p, _ in a + b}
    for p, v in a:
        out[p] += v
    for p, v in b:
        out[p] += sign * v
    edge = (max if down else min)(a[-1][0], b[-1][0]) if bounded else None
    return [(p, out[p]) for p in sorted(out, reverse=down) if edge is None or (p >= edge if down else p <= edge)]


@pytest.mark.parametrize("bounded", [False, True])
@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("sign", [-1, 1])
def test_ladders(spark, bounded, down, sign):
    rng = random.Random(4)
    cases = CASES + [tuple([(p, rng.randint(0, 9)) for p in sorted(rng.sample(range(12), rng.randint(0, 6)))] for _ in range(2)) for _ in range(40)]
    if down:
        cases = [tuple(x[::-1] if x else x for x in c) for c in cases]
    kind = "array<struct<key:long,value:long>>"
    rows = [(i, None if a is None else of(a), None if b is None else of(b)) for i, (a, b) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}").coalesce(1)
    got = {r["i"]: [tuple(x) for x in r["m"]] for r in df.select("i", ms.merge_ladders(F.col("a"), F.col("b"), sign, bounded, down).alias("m")).collect()}
    for i, (a, b) in enumerate(cases):
        assert got[i] == plain(a, b, sign, bounded, down), (a, b)


def test_maps(spark):
    df = spark.createDataFrame([({3: 1, 1: 5, 9: 9}, {1: 2, 4: 4})], "a map<long,long>, b map<long,long>")
    row = df.select(ms.merged_ladders(F.col("a"), F.col("b")).alias("x"), ms.merged_ladders(F.col("a"), F.col("b"), False).alias("y"), ms.merged_ladders(F.col("a"), F.col("b"), True, True).alias("z")).first()
    assert row["x"] == {1: 3, 3: 1, 4: -4} and row["y"] == {1: 3, 3: 1, 4: -4, 9: 9} and row["z"] == {1: 3, 3: 1, 4: -4, 9: 9}
