"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Three combining stages, each of which groups by the digest *and the whole normalised text*, so
no decision rests on a digest alone:

1. local: the map side of the first aggregation folds all copies inside an input partition;
2. salted: partial groups meet by (digest, salt), so a text with a third of all rows arrives as a
   few rows per input partition, spread over the salts;
3. global: the few salt winners of a digest meet and give the surviving row and the group size.

Texts are equal when they are identical after each run of `[\\x20\\x09-\\x0D]` became one space.

Membership: each surviving text is joined back to its rows by (digest, salt), where the salt comes
from the row's id, so the rows of a hot text are joined in as many tasks as there are salts.

Defined results: a null text counts as empty; a null id never beats a non-null id; rows that
repeat both id and text are one tie, of which exactly one is kept; an empty table gives an empty
table; a very long text is hashed and compared whole; further columns pass through untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.llm.common import WHITE, col

SALTS = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The membership join carries ids and digests but no texts. It is sound because stage 3 has
    compared every text of a digest: should two texts ever share one, the job stops.
    """
    rows = docs.select(col(id_col).alias("doc_id"), normalised(col(text_col)).alias("body"))
    rows = rows.select("doc_id", "body", F.sha2("body", 256).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    salted = rows.groupBy("digest", "salt", "body").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    winners = (
        salted.repartition("digest")
        .groupBy("digest", "body")
        .agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
        .withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("digest")))
        .select(
            "digest",
            "keep_id",
            F.when(F.col("texts") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.lit("two different texts share a SHA-256 digest")).cast("long"))
            .alias("group_size"),
            F.explode("salts").alias("salt"),
        )
    )
    attached = rows.select("doc_id", "digest", "salt").join(winners, ["digest", "salt"])
    tie = F.row_number().over(Window.partitionBy("digest", "salt", "doc_id").orderBy(F.lit(1)))
    return attached.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (tie == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of `docs` that stay, all columns unchanged.

    The whole row travels through the three stages as the payload of its text, so copies die
    before the first shuffle and no join back is needed. The payload leaves out the text itself
    where it equals the normalised one.
    """
    cols = docs.columns
    body, raw = normalised(col(text_col)), col(text_col)
    payload = F.struct(
        *[(F.when(raw.eqNullSafe(body), None).otherwise(raw) if c == text_col else col(c)).alias(f"c{i}") for i, c in enumerate(cols)]
    )
    rank = F.struct(col(id_col).isNull().alias("no_id"), col(id_col).alias("id"))
    rows = docs.select(
        body.alias("body"), raw.isNull().alias("void"), rank.alias("rank"), payload.alias("row"), (F.spark_partition_id() % F.lit(salts)).alias("salt")
    ).withColumn("digest", F.sha2("body", 256))
    best = F.min_by(F.struct("void", "rank", "row"), "rank").alias("best")
    salted = rows.groupBy("digest", "salt", "body").agg(best).select("digest", "body", "best.*")
    kept = salted.groupBy("digest", "body").agg(best)
    text = F.when(F.col("best.void"), None).otherwise(F.coalesce(F.col(f"best.row.c{cols.index(text_col)}"), F.col("body")))
    return kept.select(*[(text if c == text_col else F.col(f"best.row.c{i}")).alias(c) for i, c in enumerate(cols)])
