"""Sharding by jump consistent hashing (Lamping and Veach), with DataFrame functions only.

A key walks through a sequence of growing shard numbers that only the key's own 64-bit linear
congruential generator decides; the last number below the shard count is its shard. There is no
ring table, and one more shard takes over only the keys whose next jump lands exactly on it, so
nothing moves between old shards.

Law: `key`. The shard is decided by the id and the shard count alone, so equal texts under
different ids may lie in different shards.

Slots are gapless inside a shard without sorting a shard in one task: rows are numbered inside
(shard, bucket), where the bucket is drawn from the generator's first step for the key mixed with
the checksum of the text, and the counts of the earlier buckets are added. That table has shards x buckets rows whatever the input, so it is
broadcast.

Defined results: a null text has no bytes (size 8, crc32 0); a null id is the key 0; rows that
repeat an id share its shard; among them the row's own hash settles the bucket, so one id in a third of
all rows is numbered in as many tasks as there are buckets; an empty table gives an empty table; a very
long text is read whole; columns called as a placement column are replaced, whatever their case, and all
others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.llm.common import col, fresh, others, text_or_empty

# Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
TWO_64 = 1 << 64
TWO_33 = 1 << 33

BUCKETS = 64
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
WIDE = "decimal(20,0)"


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast(WIDE)


def unsigned(key: Column) -> Column:
    """A long as the unsigned 64-bit number with the same bits."""
    key = F.coalesce(key, F.lit(0)).cast("long").cast(WIDE)
    return F.when(key < 0, (key + _whole(TWO_64)).cast(WIDE)).otherwise(key)


def _next(state: Column) -> Column:
    return ((state * _whole(MULTIPLIER) + F.lit(1)) % _whole(TWO_64)).cast(WIDE)


def jump(key: Column, counts: list[int]) -> Column:
    """A struct with the shard `s<n>` of `key` for each shard count n, from a single walk.

    Each step moves to a larger number, so max(counts) steps are always enough.
    """
    top = max(counts)
    start = F.struct(unsigned(key).alias("k"), F.lit(0).cast("long").alias("j"), *[F.lit(0).cast("long").alias(f"s{n}") for n in counts])

    def landed(acc: Column, _: Column) -> Column:
        return F.when(
            acc["j"] >= top, acc
        ).otherwise(
            F.struct(
                _next(acc["k"]).alias("k"),
                F.floor(
                    (acc["j"] + 1) * (F.lit(float(1 << 31)) / (F.floor(_next(acc["k"]) / _whole(TWO_33)) + 1).cast("double"))
                ).cast("long").alias("j"),
                *[F.when(acc["j"] < n, acc["j"]).otherwise(acc[f"s{n}"]).alias(f"s{n}") for n in counts],
            )
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(top + 1)), start, landed)


def bucket_of(key: Column, text_crc32: Column, buckets: int) -> Column:
    """High bits of the generator's first step from key + checksum: even for any stride of ids, and for one id with many texts."""
    return (F.floor(_next((unsigned(key) + text_crc32.cast(WIDE)).cast(WIDE)) / _whole(1 << 40)) % F.lit(buckets)).cast("int")


MADE = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Every row of `docs` with its placement columns size, text_crc32, law, shard, slot, grown_shard."""
    kept = others(docs, MADE)
    walk, bucket, inside, before, key, own = (fresh(docs, n) for n in ("walk", "bucket", "inside", "before", "key", "own"))
    placed = docs.select(
        F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias(own),
        col(id_col).alias(key),
        (F.octet_length(text_or_empty(text_col)) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text_or_empty(text_col)).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump(col(id_col), [shards, shards + 1]).alias(walk),
    ).select(
        own, key, "size", "text_crc32", "law", bucket_of(F.col(key), F.col("text_crc32"), buckets).alias(bucket),
        F.col(f"{walk}.s{shards}").cast("int").alias("shard"), F.col(f"{walk}.s{shards + 1}").cast("int").alias("grown_shard"),
    )
    earlier = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias("n"))
        .select("shard", bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    )
    place = F.row_number().over(Window.partitionBy("shard", bucket).orderBy(key, "text_crc32", "size"))
    return (
        placed.withColumn(inside, place)
        .join(F.broadcast(offsets), ["shard", bucket])
        .withColumn("slot", (F.col(before) + F.col(inside) - 1).cast("long"))
        .select(*[F.col(f"{own}.c{i}").alias(c) for i, c in enumerate(kept)], *MADE)
    )


def write_shards(docs: DataFrame, path: str, shards: int, buckets: int = BUCKETS) -> None:
    """Writes the rows under `path`/shard=<n>/, several files a shard, each sorted by slot."""
    out = shard_documents(docs, shards, buckets=buckets)
    part = fresh(out, "part")
    out.withColumn(part, F.pmod("slot", F.lit(buckets))).repartition("shard", part).drop(part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
