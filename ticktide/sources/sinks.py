"""Sinks: partitioned tables, rebuilds, JDBC, and small exports."""

from __future__ import annotations

import csv
import html
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktide.operators.quantiles import quantiles


def write_days(df: DataFrame, path: str, day: str = "date", order: tuple[str, ...] = ("date", "time"), mode: str = "append") -> None:
    """Parquet by day, sorted inside files. `overwrite` replaces only the days that are written."""
    df.sortWithinPartitions(*order).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def rebuild(spark: SparkSession, name: str, query: DataFrame | None) -> bool:
    """Replaces a table by a query's rows; False where there is no input."""
    if query is None or query.limit(1).isEmpty():
        return False
    query.write.mode("overwrite").saveAsTable(name)
    return True


def maps_to_text(df: DataFrame, prefix: str = "MX_") -> DataFrame:
    """Map columns as text such as {4228: 10, 4229: 5}, by rising key and under a name with the prefix; `readers.strip_prefix` and `parse_maps` read them back."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType):
            pairs = F.transform(F.sort_array(F.map_entries(c)), lambda e: F.concat(e["key"].cast("string"), F.lit(": "), e["value"].cast("string")))
            c = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias(prefix + f.name)
        out.append(c)
    return df.select(*out)


def insert_or_create(df: DataFrame, name: str, maps_as_text: bool = False) -> None:
    (maps_to_text(df) if maps_as_text else df).write.mode("append").saveAsTable(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **properties: str) -> None:
    df.write.jdbc(url, table, mode=mode, properties=properties)


def write_sheets(frames: dict[str, DataFrame], folder: str, most: int = 100_000) -> None:
    """One CSV file a frame, for reports; a frame with more than `most` rows stops the export."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, df in frames.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        with open(f"{folder}/{name}.csv", "w", newline="") as out:
            sheet = csv.writer(out)
            sheet.writerow(df.columns)
            sheet.writerows(rows)


def colour_bound(df: DataFrame, columns: list[str], share: float = 0.95) -> float | None:
    """The quantile of absolute values that a colour scale ends at."""
    values = df.select(F.explode(F.array(*[F.abs(F.col(c).cast("double")) for c in columns])).alias("v"))
    found = quantiles(values, {"v": F.col("v")}, [share])["v"]
    return found[0] if found else None


def sample_rows(df: DataFrame, most: int = 1000, seed: int = 1) -> DataFrame:
    """At most `most` rows, for a model's report."""
    return df.orderBy(F.rand(seed)).limit(most)


def write_heat_table(df: DataFrame, path: str, columns: list[str], most: int = 10_000) -> None:
    """A small result as an HTML table, coloured from blue over white to red up to the 95 % quantile of |value|."""
    bound = colour_bound(df, columns) or 1.0
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")

    def cell(name: str, value: object) -> str:
        if name not in columns or value is None:
            return f"<td>{html.escape('' if value is None else str(value))}</td>"
        share = max(-1.0, min(1.0, float(value) / bound))
        fade = round(255 * (1 - abs(share)))
        colour = f"#ff{fade:02x}{fade:02x}" if share > 0 else f"#{fade:02x}{fade:02x}ff"
        return f'<td style="background:{colour}">{float(value):.4g}</td>'

    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "\n".join("<tr>" + "".join(cell(c, r[c]) for c in df.columns) + "</tr>" for r in rows)
    Path(path).write_text(f"<table>\n<tr>{head}</tr>\n{body}\n</table>\n")


def save_model(model, report: DataFrame, sample: DataFrame, path: str) -> None:
    """A Spark ML model, its report and a bounded sample of scored rows under one folder."""
    model.write().overwrite().save(f"{path}/model")
    report.write.mode("overwrite").parquet(f"{path}/report")
    sample_rows(sample).write.mode("overwrite").option("header", True).csv(f"{path}/sample")
