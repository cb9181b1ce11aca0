"""A table by days with a manifest: loads are staged and published as a whole, columns may be given by expressions.

    <path>/data/load=<id>/day_part=<day>/...   files of a load, never changed
    <path>/manifest/<number>.json              what a load published, in order; later entries win

A load writes its files first, counts what it has written, and publishes all its days by one new manifest file that is
created only if no other load took the number. Readers take days and folders from the manifest alone, so
a load that breaks off has no effect, and repeating it loads the days again. Days with too few rows are
noted with their number of rows and skipped; days that are loaded are not touched again.

A materialised column is an expression kept in the manifest. New days are written with it; `fill` rewrites
only the days that lack it in its present form; until then reading computes it for those days.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_ROWS = 1000


@dataclass
class State:
    """The fold of the manifest: days (load, rows, columns), skipped days (rows), expressions of columns, entries read."""

    days: dict[str, dict] = field(default_factory=dict)
    skipped: dict[str, int] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)
    entries: int = 0


class DayTable:
    def __init__(self, spark: SparkSession, path: str, day: str = "date", order: tuple[str, ...] = ("time",), files: int = 1) -> None:
        """`day` names the column of the day, `order` the order inside files; a day's rows go to `files` tasks."""
        self.spark, self.path, self.day, self.order, self.files = spark, path.rstrip("/"), day, order, files

    # the file system, whichever it is

    def _fs(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _list(self, path: str) -> list[str]:
        fs, place = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def state(self) -> State:
        out = State()
        names = [n for n in self._list(f"{self.path}/manifest") if n.endswith(".json")]
        if names:
            texts = self.spark.read.text([f"{self.path}/manifest/{n}" for n in names], wholetext=True).select("value", F.input_file_name().alias("name")).collect()
            for r in sorted(texts, key=lambda r: r["name"].rpartition("/")[2]):
                entry = json.loads(r["value"])
                out.days |= entry.get("days", {})
                out.skipped = {d: n for d, n in (out.skipped | entry.get("skipped", {})).items() if d not in out.days}
                for name, text in entry.get("columns", {}).items():
                    if text is None:
                        out.columns.pop(name, None)
                    else:  # a changed column keeps its place, and later ones follow it
                        out.columns[name] = text
        out.entries = len(names)
        return out

    def _publish(self, number: int, entry: dict) -> None:
        """One file, created only if it isn't there: of two loads at a time the second one fails and has no effect."""
        fs, place = self._fs(f"{self.path}/manifest/{number:08d}.json")
        out = fs.create(place, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()

    def _with_columns(self, df: DataFrame, columns: dict[str, str], have: dict[str, str]) -> DataFrame:
        changed: set[str] = set()
        for name, text in columns.items():
            if have.get(name) != text or any(c in text for c in changed):
                changed.add(name)
                df = df.withColumn(name, F.expr(text))
        return df

    def _write(self, df: DataFrame, load: str) -> dict[str, int]:
        """Writes the rows by day and counts what was written."""
        folder = f"{self.path}/data/load={load}"
        spread = F.floor(F.rand(7) * self.files)
        rows = df.withColumn("day_part", F.col(self.day).cast("string"))
        rows = rows.repartition("day_part", spread) if self.files > 1 else rows.repartition("day_part")
        rows.sortWithinPartitions("day_part", *self.order).write.partitionBy("day_part").parquet(folder)
        back = self.spark.read.parquet(folder)
        return {r["d"]: r["count"] for r in back.groupBy(F.col(self.day).cast("string").alias("d")).count().collect()}

    # loads

    def load(self, source: DataFrame, least: int = LEAST_ROWS) -> dict[str, list[str]]:
        """Loads the days of `source` that the table lacks; says which were loaded, skipped, or there before. Rows without a day don't count."""
        state = self.state()
        rows = source.filter(F.col(self.day).isNotNull())
        counts = {r["d"]: r["count"] for r in rows.groupBy(F.col(self.day).cast("string").alias("d")).count().collect()}
        new = sorted(d for d, n in counts.items() if d not in state.days and n >= least)
        few = {d: n for d, n in counts.items() if d not in state.days and n < least}
        entry: dict = {"days": {}, "skipped": {d: n for d, n in few.items() if state.skipped.get(d) != n}}
        if new:
            load = uuid.uuid4().hex
            made = self._with_columns(rows.filter(F.col(self.day).cast("string").isin(new)), state.columns, {})
            written = self._write(made, load)
            if written != {d: counts[d] for d in new}:
                raise RuntimeError(f"the source changed while it was loaded: {counts} and {written}")
            entry["days"] = {d: {"load": load, "rows": counts[d], "columns": state.columns} for d in new}
        if entry["days"] or entry["skipped"]:
            self._publish(state.entries, entry)
        return {"loaded": new, "skipped": sorted(few), "known": sorted(d for d in counts if d in state.days)}

    def read(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """The loaded days, both ends included; only their folders are listed and read."""
        state = self.state()
        parts: dict[str, tuple[dict, list[str]]] = {}
        for d, own in sorted(state.days.items()):
            if (since is None or d >= since) and (until is None or d <= until):
                parts.setdefault(json.dumps(own["columns"]), (own["columns"], []))[1].append(f"{self.path}/data/load={own['load']}/day_part={d}")
        if not parts:
            raise LookupError(f"no loaded day between {since} and {until}")
        out = None
        for have, folders in parts.values():
            df = self._with_columns(self.spark.read.parquet(*folders), state.columns, have).drop(*[c for c in have if c not in state.columns])
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    # columns given by expressions

    def set_column(self, name: str, expression: str | None) -> None:
        """Adds a column or changes its expression; None takes it away. No file is touched."""
        state = self.state()
        if state.columns.get(name) != expression:
            self._publish(state.entries, {"columns": {name: expression}})

    def fill(self) -> list[str]:
        """Rewrites the days whose files lack a column in its present form; says which."""
        state = self.state()
        stale = sorted(d for d, own in state.days.items() if own["columns"] != state.columns)
        if stale:
            load = uuid.uuid4().hex
            days = F.col(self.day).cast("string")
            written = self._write(self.read(stale[0], stale[-1]).filter(days.isin(stale)), load)
            if written != {d: state.days[d]["rows"] for d in stale}:
                raise RuntimeError(f"rows were lost: {written}")
            self._publish(state.entries, {"days": {d: {"load": load, "rows": written[d], "columns": state.columns} for d in stale}})
        return stale

    def clean(self) -> list[str]:
        """Removes the folders of loads that broke off or whose days were all rewritten. Not while a load or a reader is at work."""
        used = {f"load={own['load']}" for own in self.state().days.values()}
        gone = [n for n in self._list(f"{self.path}/data") if n not in used]
        for n in gone:
            fs, place = self._fs(f"{self.path}/data/{n}")
            fs.delete(place, True)
        return gone
