"""Readers: SQL, CSV, JSON, JDBC, catalogue probes and the incremental loader."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktide.operators.relational import missing_in, session_of

#: Columns of a raw five-level snapshot.
SNAPSHOT = T.StructType(
    [T.StructField("date", T.StringType()), T.StructField("Symbol", T.StringType()), T.StructField("time", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in ("vol_sum", "amt_sum", "OpenInterest")]
    + [T.StructField(f"{s}{k}{i}", T.LongType()) for s in "BA" for k in "PV" for i in range(1, 6)]
)
#: The same with the number of orders at each level, and the receiver's clock.
SNAPSHOT_COUNTS = T.StructType([*SNAPSHOT.fields, *[T.StructField(f"{s}Count{i}", T.LongType()) for s in ("Bid", "Ask") for i in range(1, 6)], T.StructField("LocalTimeStamp", T.StringType())])
LEAST_ROWS = 1000


def clean_names(df: DataFrame) -> DataFrame:
    """Names with every character outside letters, digits and `_` as `_`."""
    return df.toDF(*[re.sub(r"\W", "_", c) for c in df.columns])


def read_sql(spark: SparkSession, query: str) -> DataFrame:
    return clean_names(spark.sql(query))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Connection options (user, password, partitioning) come from the caller's configuration."""
    return clean_names(spark.read.format("jdbc").options(url=url, query=query, **options).load())


def snapshots(raw: DataFrame, date: str, symbol: str) -> DataFrame:
    """One symbol's day, with its session; partition filters reach the scan."""
    return raw.filter((F.col("date") == date) & (F.col("Symbol") == symbol)).withColumn("Session", session_of(F.col("time")))


def raw_snapshots(spark: SparkSession, path: str, counts: bool = False) -> DataFrame:
    """Raw five-level snapshots kept as Parquet by day, with order counts if asked for; columns that files lack are null."""
    return spark.read.schema(SNAPSHOT_COUNTS if counts else SNAPSHOT).parquet(path)


def instruments(spark: SparkSession, path: str) -> DataFrame:
    """Rows (symbol, exchange, multiplier) of an instrument list in JSON."""
    schema = "symbol string, exchange string, multiplier double"
    return spark.read.schema(schema).json(path, multiLine=True)


def with_multiplier(ticks: DataFrame, listed: DataFrame, default: float = 1.0) -> DataFrame:
    return ticks.join(listed.select(F.col("symbol").alias("Symbol"), "multiplier"), "Symbol", "left").withColumn("vMult", F.coalesce("multiplier", F.lit(default))).drop("multiplier")


def busiest_server(df: DataFrame, stamps: str) -> DataFrame:
    """Rows whose JSON map of server to time holds the server that occurs most, with its time."""
    parsed = df.withColumn("_m", F.from_json(stamps, "map<string,string>"))
    top = parsed.select(F.explode(F.map_keys("_m")).alias("server")).groupBy("server").count().orderBy(F.desc("count"), "server").limit(1)
    return parsed.join(F.broadcast(top.select("server")), F.map_contains_key("_m", F.col("server"))).withColumn("server_time", F.try_element_at("_m", F.col("server"))).drop("_m")


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).isEmpty()


def tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def new_days(source: DataFrame, loaded: DataFrame, day: str = "date", least: int = LEAST_ROWS) -> DataFrame:
    """Rows of the days that aren't loaded yet and have at least `least` rows."""
    counts = source.groupBy(day).count().filter(F.col("count") >= least).select(day)
    return source.join(missing_in(counts, loaded, [day]), day)


def strip_prefix(df: DataFrame, prefix: str = "MX_") -> tuple[DataFrame, list[str]]:
    """Names without the prefix, and which columns had it (maps kept as text in older tables)."""
    had = [c for c in df.columns if c.startswith(prefix)]
    return df.withColumnsRenamed({c: c.removeprefix(prefix) for c in had}), [c.removeprefix(prefix) for c in had]


def parse_maps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text such as {4228: 10, 4229: 5} as price-volume maps, by pattern and never by evaluation."""
    pairs = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"(-?\d+)\s*:\s*-?\d+"), F.lit(1))
    values = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"-?\d+\s*:\s*(-?\d+)"), F.lit(1))
    return df.withColumns({c: F.map_from_arrays(pairs(c).cast("array<bigint>"), values(c).cast("array<bigint>")) for c in columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.nullif(F.col(f.name), F.lit(float("nan")).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def read_days(spark: SparkSession, path: str, since: str, until: str, symbols: str | None = None, day: str = "date", symbol: str = "Symbol") -> DataFrame:
    """Days of a partitioned table, both ends included; only their folders are listed and read."""
    df = spark.read.parquet(path).filter(F.col(day).between(since, until))
    return df if symbols is None else df.filter(F.col(symbol).rlike(symbols))


def read_hive(spark: SparkSession, query: str) -> DataFrame:
    """A query over the session's catalogue; the session needs Hive support for Hive tables."""
    return clean_names(spark.sql(query))


def catalogue(spark: SparkSession) -> DataFrame:
    """Rows (database, table, column, type) of the session's catalogue."""
    found = [
        (d.name, t.name, c.name, c.dataType)
        for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name) for c in spark.catalog.listColumns(t.name if t.isTemporary else f"{d.name}.{t.name}")
    ]
    return spark.createDataFrame(found, "database string, table string, column string, type string")


def has_function(spark: SparkSession, name: str) -> bool:
    return spark.catalog.functionExists(name)
