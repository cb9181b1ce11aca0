"""Every registered query runs and, where it has an SQL twin, gives the twin's rows."""

import datetime as dt
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from ticktide.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, (bool, type(None), str)):
        return value
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value.isoformat()[:19] if isinstance(value, (dt.date, dt.datetime)) else value


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((v is not None, str(type(v).__name__ == "str"), v if isinstance(v, str) else 0 if v is None else float(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    assert len(set(df.columns)) == len(df.columns)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    twin = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(twin.fetchall(), names)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6) for x, y in zip(a, b, strict=True)), (a, b)
