"""Mixing sources to target weights, with DataFrame functions only.

Targets: sources in code point order (null last) take the weights in turn and share a budget of words; a
source stops at `most` times its own words, and what is over is shared by weight among the rest until
none is above. Each round of that is one aggregate over the table of sources; the driver sees two sums.

Blocks: a source's documents, in the order of a hash, form one stream of words, cut every `block_words`
words. An epoch draws blocks in permuted order (a multiplication modulo their number, which is prime to
the factor), the short block at the end last, until the epoch's words are reached; the last drawn block is
cut there. So a source gives its target to the word, no word comes twice in an epoch, and there are
at most `most` epochs. Documents are whole but for cuts at the ends of blocks.

Shards: all drawn blocks are dealt to output shards of equal numbers of blocks. How many of each source's
blocks a shard gets follows the multivariate hypergeometric law, as if the blocks had been shuffled: a
splitting tree over the sources halves the table (its leaves are sources, its root is all of them), and at each
node the left half's blocks are split recursively among halves of the shards by hypergeometric draws, so
both margins stay exact. A node is a row with one number per shard. Shard i then takes the next
of each source's permuted blocks, and orders its pieces by a hash.

Hot sources: places in the stream come from sums by (source, bucket of the hash), the number of
buckets growing with the source, so no task holds a source. Rows equal in source, id and text are folded into a
count before that, in chunks of up to 1,000 copies.

Defined results: a null text has no words; null ids and sources are values of their own; a document
without words is in no piece; a source without words has target 0; an empty table gives an empty table. Equal rows
share their draws in any order. A very long text is read whole and may lie in many blocks. Other columns are not
carried along; columns are found by their whole name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.functions.pvmap import let
from ticktide.llm.common import col, cut, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, SHARDS, CHUNK, BUCKET_ROWS = 1024, 32, 1000, 10_000
#: Primes below 2^31, the factors of the permutations; a source has fewer blocks than that.
FACTORS = [2147483647, 2147483629, 2147483587, 2147483579]
#: Sources up to which their table is broadcast; beyond it, joins shuffle.
FEW = 20_000
WIDE = "decimal(38,0)"
TRIES = 60


# --- draws ----------------------------------------------------------------------------------------


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that the parts decide."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / float(1 << 52)


def log_factorial(x: Column) -> Column:
    """ln x!, from a table up to 15 and by Stirling's series beyond."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(x < 16, F.element_at(table, x.cast("int") + 1)).otherwise(series)


def hypergeometric(total: Column, good: Column, drawn: Column, *seed: Column) -> Column:
    """How many of `drawn` out of `total` are among the `good` ones: ratio of uniforms with rejection (Stadlober).

    The draw is made for the smaller of both kinds and of drawn and left, and turned back afterwards.
    All arguments are longs. The chance that no try fits is below 1e-20; the mode stands then.
    """

    def draw(p: Column) -> Column:
        total, good, drawn = p["total"].cast("double"), p["good"].cast("double"), p["drawn"].cast("double")
        few, many = F.least(good, total - good), F.greatest(good, total - good)
        m = F.least(drawn, total - drawn)
        share = few / total
        width = F.sqrt((total - m) * m * share * (1 - share) / (total - 1) + 0.5)
        fixed = F.struct(
            few.alias("few"), many.alias("many"), m.alias("m"), (m * share + 0.5).alias("centre"),
            (width * (2 * math.sqrt(2 / math.e)) + (3 - 2 * math.sqrt(3 / math.e))).alias("hat"),
            F.least(F.least(m, few) + 1, F.floor(m * share + 0.5 + 16 * width)).alias("end"),
            F.floor((m + 1) * (few + 1) / (total + 2)).cast("double").alias("mode"),
        )

        def weight(q: Column, z: Column) -> Column:
            return F.aggregate(F.array(z, q["few"] - z, q["m"] - z, q["many"] - q["m"] + z), F.lit(0.0), lambda a, x: a - log_factorial(x))

        def tries(q: Column, top: Column) -> Column:
            def once(found: Column, k: Column) -> Column:
                def fits(t: Column) -> Column:
                    z = F.floor(q["centre"] + q["hat"] * (uniform(*seed, k, F.lit(2)) - 0.5) / t).cast("double")

                    def judged(z: Column) -> Column:
                        outside = (z < 0) | (z >= q["end"])
                        return F.when(~outside & (2 * F.log(t) <= weight(q, z) - top), z).otherwise(found)

                    return let(z, judged)

                return F.when(found >= 0, found).otherwise(let(uniform(*seed, k, F.lit(1)), fits))

            z = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(-1.0), once)
            return let(F.when(z < 0, q["mode"]).otherwise(z), lambda z: F.when(good > total - good, q["m"] - z).otherwise(z))

        z = let(fixed, lambda q: let(weight(q, q["mode"]), lambda top: tries(q, top)))
        return F.when(m < drawn, good - z).otherwise(z).cast("long")

    plain = F.when((good <= 0) | (drawn <= 0), F.lit(0).cast("long")).when(drawn >= total, good).when(good >= total, drawn)
    return plain.otherwise(let(F.struct(total.alias("total"), good.alias("good"), drawn.alias("drawn")), draw))


def two_to(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), n)


def heap_of(counts: Column, depth: int) -> Column:
    """The tree over 2^depth leaves `counts`, rows from the root on laid end to end: row n starts at 2^n - 1."""

    def up(acc: Column, n: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), two_to(n) - 1), lambda i: F.get(acc["row"], 2 * i) + F.get(acc["row"], 2 * i + 1))
        return let(pairs, lambda row: F.struct(F.concat(row, acc["heap"]).alias("heap"), row.alias("row")))

    start = F.struct(counts.alias("heap"), counts.alias("row"))
    return F.aggregate(F.sequence(F.lit(depth - 1), F.lit(0), F.lit(-1)), start, up, lambda acc: acc["heap"]) if depth else counts


def split(heap: Column, depth: int, drawn: Column, *seed: Column) -> Column:
    """`drawn` of the blocks that 2^depth shards have room for (a tree as in `heap_of`), split among them."""

    def down(now: Column, n: Column) -> Column:
        row = two_to(n) - 1

        def halve(i: Column) -> Column:
            left = hypergeometric(F.get(heap, row + i), F.get(heap, 2 * (row + i) + 1), F.get(now, i), *seed, n, i)
            return let(left, lambda x: F.array(x, F.get(now, i) - x))

        return F.flatten(F.transform(F.sequence(F.lit(0), row), halve))

    return F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), F.array(drawn), down) if depth else F.array(drawn)


def shard_of(heap: Column, unit: Column, depth: int) -> Column:
    """The leaf that holds a source's block number `unit`, down the rows of its tree laid end to end."""

    def down(at: Column, n: Column) -> Column:
        left = F.get(heap, (two_to(n + 1) - 1 + 2 * at["i"]).cast("int"))
        return F.when(at["u"] < left, F.struct((2 * at["i"]).alias("i"), at["u"].alias("u"))).otherwise(
            F.struct((2 * at["i"] + 1).alias("i"), (at["u"] - left).alias("u"))
        )

    start = F.struct(F.lit(0).alias("i"), unit.alias("u"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), start, down, lambda at: at["i"]) if depth else F.lit(0)


# --- sources --------------------------------------------------------------------------------------


def source_key(source_col: str) -> Column:
    """'=' and the source, or empty for null."""
    return F.coalesce(F.concat(F.lit("="), col(source_col).cast("string")), F.lit(""))


def mark_of(id_col: str, text_col: str) -> Column:
    """A digest of id and text."""
    name = F.coalesce(col(id_col).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit("mix:"), name, F.lit(":"), F.md5(text_or_empty(text_col).cast("binary"))).cast("binary"))


def items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (key, id, size, mark, copies): equal documents of a source folded, the mark orders them."""
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    rows = docs.select(source_key(source_col).alias("key"), col(id_col).alias("id"), size.alias("size"), mark_of(id_col, text_col).alias("mark"))
    return rows.groupBy("key", "id", "mark", "size").agg(F.count(F.lit(1)).alias("copies"))


def chunks(folded: DataFrame) -> DataFrame:
    """Items in portions of up to CHUNK copies, each portion with a mark of its own."""
    each = folded.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK))).alias("chunk"))
    mark = F.when(F.col("chunk") == 0, F.col("mark")).otherwise(F.md5(F.concat(F.col("mark"), F.lit(":"), F.col("chunk").cast("string")).cast("binary")))
    return each.select("key", "id", "size", F.col("mark").alias("origin"), mark.alias("mark"), F.least(F.lit(CHUNK), F.col("copies") - F.col("chunk") * CHUNK).alias("copies"))


def ranked(sources: DataFrame) -> DataFrame:
    """`sources` with their rank from 0 in order of the key, the null source last: a range sort and the ranges' counts."""
    ordered = cut(sources.orderBy(F.col("key") == "", "key"))
    place = ordered.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    before, start = 0, F.lit(0).cast("long")
    for r in place.groupBy("part").count().orderBy("part").collect():
        start = F.when(F.col("part") == r["part"], F.lit(before).cast("long")).otherwise(start) if before else start
        before += r["count"]
    return place.withColumn("rank", start + F.col("row")).drop("part", "row")


def targets(sources: DataFrame, weights: Sequence[int], budget: Fraction, most: int) -> DataFrame:
    """Rows (key, rank, total, docs, target) from rows (key, total, docs)."""
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast(WIDE)
    weighed = cut(ranked(sources).withColumn("w", w))
    cap = (F.col("total").cast(WIDE) * (most * budget.denominator)).cast(WIDE)
    first = weighed.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("t"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    whole = room = int(first["t"]) * budget.numerator
    rest, capped, stopped = int(first["w"]), -1, F.lit(False)
    while rest:
        stopped = (cap * F.lit(str(rest)).cast("decimal(18,0)")) <= (F.col("w") * F.lit(str(room)).cast("decimal(28,0)"))
        r = weighed.agg(
            F.count(F.when(stopped, 1)).alias("n"), F.coalesce(F.sum(F.when(stopped, cap)), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(~stopped, F.col("w"))), F.lit(0)).alias("w")
        ).first()
        if r["n"] == capped or not r["w"]:
            break
        capped, room, rest = r["n"], whole - int(r["t"]), int(r["w"])
    share = (F.col("w") * F.lit(str(room)).cast("decimal(28,0)")).cast("double") / float(max(rest, 1) * budget.denominator)
    target = F.when(stopped, (F.col("total") * most).cast("double")).otherwise(share)
    return weighed.select("key", "rank", "total", "docs", target.alias("target"))


def quotas(aimed: DataFrame, most: int, block_words: int) -> DataFrame:
    """With the words of each epoch, the blocks before each epoch, and all blocks `units`."""
    words = F.least(F.floor(F.col("target") + 0.5), F.col("total") * most)
    epochs = [F.greatest(F.lit(0).cast("long"), F.least(F.col("total"), words - F.col("total") * e)) for e in range(most)]
    blocks = [F.ceil(x / block_words) for x in epochs]
    before = [sum(blocks[:e], F.lit(0).cast("long")) for e in range(most + 1)]
    full = F.floor(F.col("total") / block_words)
    factors = [F.when(full > 0, F.lit(FACTORS[e % len(FACTORS)]).cast("long") % full).otherwise(F.lit(0).cast("long")) for e in range(most)]
    return aimed.select(
        "*", F.array(*epochs).alias("words"), F.array(*before[:-1]).alias("before"), before[-1].alias("units"), full.alias("full"), F.array(*factors).alias("factors")
    )


def dealt(sources: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """`sources` with `tree`: the rows of each source's splitting tree over the shards, laid end to end.

    `sources` holds rank and units. Every level of the tree over the sources is one join of two small tables.
    """
    depth = max(shards - 1, 0).bit_length()
    sources = cut(sources)
    rows = [sources.select(F.col("rank").alias("node"), "units")]
    top = sources.agg(F.max("rank").alias("n"), F.sum("units").alias("units")).first()
    while (1 << (len(rows) - 1)) <= (top["n"] or 0):
        rows.append(rows[-1].groupBy(F.shiftright("node", 1).alias("node")).agg(F.sum("units").alias("units")))
    total = top["units"] or 0
    room = [total * (i + 1) // shards - total * i // shards for i in range(shards)] + [0] * ((1 << depth) - shards)
    now = sources.sparkSession.createDataFrame([(0, total, room)], "node long, units long, counts array<long>")
    for below in reversed(rows[:-1]):
        above = now.select(F.col("node").alias("over"), F.col("units").alias("all"), "counts", heap_of(F.col("counts"), depth).alias("heap"))
        own = below.join(above, F.shiftright("node", 1) == F.col("over"))
        right = (F.col("node") % 2) == 1
        left = split(F.col("heap"), depth, F.when(right, F.col("all") - F.col("units")).otherwise(F.col("units")), F.lit(seed), F.lit(len(rows)), F.col("over"), F.col("all"))
        drawn = let(left, lambda x: F.when(right, F.zip_with("counts", x, lambda a, b: a - b)).otherwise(x))
        now = cut(own.select("node", "units", drawn.alias("counts")))
    tree = heap_of(F.col("counts"), depth)
    return sources.join(now.select(F.col("node").alias("rank"), tree.alias("tree")), "rank")


# --- documents ------------------------------------------------------------------------------------

PIECE = "array<struct<epoch:int,start:long,length:long,shard:int>>"


def placed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: Fraction = Fraction(3, 2), most: int = 2, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 0,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per document: key, id, size, source_size, target, mark, origin, and the pieces that the mix takes of it.

    A piece is (epoch, start, length, shard) in words. `mark` orders the source's stream; `origin` is the document's digest.
    """
    folded = cut(items(docs, id_col, text_col, source_col))
    sizes = folded.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("total"), F.sum(F.ceil(F.col("copies") / CHUNK)).alias("docs"))
    sources = cut(dealt(quotas(targets(sizes, weights, budget, most), most, block_words), shards, seed))
    few: Callable[[DataFrame], DataFrame] = F.broadcast if sources.count() <= FEW else lambda df: df
    buckets = few(sources.select("key", F.ceil(F.col("docs") / BUCKET_ROWS).alias("buckets")))
    place = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long")
    rows = chunks(folded).join(buckets, "key").withColumn("bucket", F.shiftright(place * F.col("buckets"), 32)).drop("buckets")
    words = F.col("size") * F.col("copies")
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("key", "bucket").agg(F.sum(words).alias("n")).select("key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skipped"))
    inside = Window.partitionBy("key", "bucket").orderBy("mark", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        rows.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(starts, ["key", "bucket"])
        .join(few(sources.select("key", "total", "target", "words", "before", "full", "factors", "tree")), "key")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .withColumn("at", F.col("skipped") + F.col("inside") + (F.col("copy") - 1) * F.col("size"))
    )
    depth = max(shards - 1, 0).bit_length()
    block = F.lit(block_words).cast("long")

    def pieces_of(b: Column) -> Column:
        def one(e: int) -> Column:
            order = F.when(b < F.col("full"), (b * F.get("factors", F.lit(e))) % F.col("full")).otherwise(F.col("full"))

            def cut_out(p: Column) -> Column:
                drawn = F.least(F.col("total") - b * block, block, F.get("words", F.lit(e)) - p * block)
                low, high = F.greatest(F.col("at"), b * block), F.least(F.col("at") + F.col("size"), b * block + drawn)
                return F.when(high > low, F.struct(
                    F.lit(e).alias("epoch"), (low - F.col("at")).alias("start"), (high - low).alias("length"),
                    shard_of(F.col("tree"), F.get("before", F.lit(e)) + p, depth).cast("int").alias("shard"),
                ))

            return let(order, cut_out)

        return F.array(*[one(e) for e in range(most)])

    spans = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))
    pieces = F.when(F.col("size") > 0, F.array_compact(F.flatten(F.transform(spans, pieces_of)))).otherwise(F.array()).cast(PIECE)
    return at.select("key", "id", "size", F.col("total").alias("source_size"), "target", "mark", "origin", pieces.alias("pieces"))


def taken(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of `placed`: its size, its source's size and target, and the words that the mix takes of it."""
    words = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", words.alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: Fraction = Fraction(3, 2), most: int = 2, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows (shard, place, id, source, epoch, start, length, text).

    `place` is the order inside a shard. A whole document keeps its text as it is; a piece is its words, a space
    between. Texts meet their pieces by (source, mark) once, before they are cut.
    """
    parts = placed(docs, weights, budget, most, shards, block_words, seed, id_col, text_col, source_col).filter(F.size("pieces") > 0)
    rows = docs.select(source_key(source_col).alias("key"), mark_of(id_col, text_col).alias("origin"), text_or_empty(text_col).alias("text")).dropDuplicates(["key", "origin"])
    piece = F.col("piece")
    body = F.when((piece["start"] == 0) & (piece["length"] == F.col("size")), F.col("text")).otherwise(
        F.array_join(F.slice("split", (piece["start"] + 1).cast("int"), piece["length"].cast("int")), " ")
    )
    split_words = F.when(F.exists("pieces", lambda p: p["length"] < F.col("size")), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    out = parts.join(rows, ["key", "origin"]).withColumn("split", split_words).withColumn("piece", F.explode("pieces"))
    return out.select(
        piece["shard"].alias("shard"), F.xxhash64(F.lit(seed), "mark", piece["epoch"], piece["start"]).alias("place"), F.col("id").alias(id_col),
        F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("source"), piece["epoch"].alias("epoch"), piece["start"].alias("start"), piece["length"].alias("length"), body.alias("text"),
    )


def write_mix(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 4, **options) -> None:
    """Writes the mix under `path`/shard=<n>/, shuffled: several files a shard, each in order of `place`."""
    out = mix(docs, shards=shards, **options)
    part = F.pmod("place", F.lit(files))
    out.repartition("shard", part).sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)
