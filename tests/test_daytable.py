import pytest
from pyspark.sql import functions as F

from ticktide.sources.daytable import DayTable


def source(spark, days):
    rows = [(d, float(t), "rb", t % 7) for d, n in days.items() for t in range(n)]
    return spark.createDataFrame(rows, "date string, time double, code string, v long")


def counts(table):
    return {r["date"]: r["count"] for r in table.read().groupBy("date").count().collect()}


def test_loads_skip_small_days_and_reruns_change_nothing(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"))
    first = source(spark, {"2024-01-01": 30, "2024-01-02": 3}).union(spark.createDataFrame([(None, 1.0, "rb", 1)], "date string, time double, code string, v long"))
    assert table.load(first, 10) == {"loaded": ["2024-01-01"], "skipped": ["2024-01-02"], "known": []}
    files = sorted(p for p in (tmp_path / "t").rglob("*") if not p.name.startswith("."))
    assert table.load(first, 10) == {"loaded": [], "skipped": ["2024-01-02"], "known": ["2024-01-01"]}
    assert sorted(p for p in (tmp_path / "t").rglob("*") if not p.name.startswith(".")) == files
    assert table.state().skipped == {"2024-01-02": 3}
    assert table.load(source(spark, {"2024-01-02": 12, "2024-01-03": 11}), 10)["loaded"] == ["2024-01-02", "2024-01-03"]
    assert counts(table) == {"2024-01-01": 30, "2024-01-02": 12, "2024-01-03": 11} and table.state().skipped == {}
    assert table.read("2024-01-02", "2024-01-02").count() == 12
    assert table.read("2024-01-02", "2024-01-02").schema == first.schema
    assert [r["time"] for r in table.read("2024-01-03", "2024-01-03").collect()] == [float(t) for t in range(11)]


def test_a_load_that_breaks_off_has_no_effect(spark, tmp_path, monkeypatch):
    table = DayTable(spark, str(tmp_path / "t"), files=3)
    table.load(source(spark, {"2024-01-01": 20}), 10)
    more = source(spark, {"2024-01-02": 20, "2024-01-03": 20})

    def broken(*_):
        raise OSError("the driver was lost")

    monkeypatch.setattr(DayTable, "_publish", broken)
    with pytest.raises(OSError):
        table.load(more, 10)
    monkeypatch.undo()
    assert counts(table) == {"2024-01-01": 20}
    assert table.load(more, 10)["loaded"] == ["2024-01-02", "2024-01-03"]
    assert set(counts(table).values()) == {20} and len(table.clean()) == 1 and len(counts(table)) == 3
    # a task that fails while files are written
    bad = source(spark, {"2024-01-05": 20}).withColumn("v", F.when(F.col("time") == 13, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        table.load(bad, 10)
    assert len(counts(table)) == 3


def test_of_two_loads_at_a_time_one_counts(spark, tmp_path, monkeypatch):
    a, b = DayTable(spark, str(tmp_path / "t")), DayTable(spark, str(tmp_path / "t"))
    a.load(source(spark, {"2024-01-01": 20}), 10)
    write = DayTable._write

    def slow(self, df, load):
        out = write(self, df, load)
        monkeypatch.undo()
        b.load(source(spark, {"2024-01-02": 15}), 10)
        return out

    monkeypatch.setattr(DayTable, "_write", slow)
    with pytest.raises(Exception, match="(?i)exist"):
        a.load(source(spark, {"2024-01-02": 20}), 10)
    assert counts(a) == {"2024-01-01": 20, "2024-01-02": 15}


def test_materialised_columns(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"))
    table.load(source(spark, {"2024-01-01": 20, "2024-01-02": 20}), 10)
    table.set_column("twice", "v * 2")
    table.load(source(spark, {"2024-01-03": 20}), 10)
    values = lambda name: table.read().agg(F.sum(name)).first()[0]
    v = values("v")
    assert values("twice") == 2 * v
    assert table.fill() == ["2024-01-01", "2024-01-02"] and table.fill() == [] and values("twice") == 2 * v
    table.set_column("more", "twice + 1")
    assert values("more") == 2 * v + 60 and table.fill() == ["2024-01-01", "2024-01-02", "2024-01-03"]
    table.set_column("twice", "v * 20")
    assert values("twice") == 20 * v and values("more") == 20 * v + 60
    table.load(source(spark, {"2024-01-04": 10}), 10)
    assert table.fill() == ["2024-01-01", "2024-01-02", "2024-01-03"]
    table.set_column("twice", None)
    table.set_column("more", None)
    assert "twice" not in table.read().columns and len(table.fill()) == 4 and table.read().columns == ["date", "time", "code", "v"]
    table.set_column("w", "v")
    table.set_column("w", "v")
    assert table.state().entries == len(list((tmp_path / "t" / "manifest").glob("*.json")))
    assert len(table.clean()) >= 3 and table.read().count() == 70


def test_nothing_loaded(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"))
    assert table.load(source(spark, {}), 10) == {"loaded": [], "skipped": [], "known": []} and table.fill() == [] and table.clean() == []
    with pytest.raises(LookupError):
        table.read()
