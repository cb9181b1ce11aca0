"""Session settings that suit the library's plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution coalesces small partitions and splits skewed joins at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(app: str = "ticktide", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; in local mode alone a temporary one is set if none is named."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ticktide-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, for plans that read it several times."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
