"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and TAB to CR. `bytes.split()` uses the same set.
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a temporary folder is set once in local mode (unit tests); on a
    cluster, whose executors would not see it, that is an error.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ticktide-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so lost executors don't cost its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def col(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, made: Iterable[str]) -> list[str]:
    """Columns of `df` that a result with columns `made` can carry along: names count whatever their case."""
    taken = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in taken]


def fresh(df: DataFrame, stem: str) -> str:
    """`stem`, with as many underscores before it as no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def groups(batch: pa.RecordBatch, rows: int = 400) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of a few hundred rows, to bound what is held beside it."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
