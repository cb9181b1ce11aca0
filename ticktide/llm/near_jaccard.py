"""Near-duplicates by Jaccard similarity, found by soft-decision Golay keys over several SimHashes.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of THRESHOLD or
more. A pair of 0.8 differs in 15 % of all SimHash bits, which three bits of 64 miss, so

1. 1,088 independent bits are summed over the distinct shingles. 128 of them are the sketch; 920 are
   cut into 40 segments of 23.
2. A segment decodes to the index of the codeword of the binary Golay code that agrees best with
   its 23 sums (not only their signs: a sum near zero is a bit that may have turned). Two texts of
   similarity 0.8 get one index in a segment with a chance of about 0.26, where unlike ones share
   one in 4,096.
3. The segments form five groups of eight; in each, all pairs of segments are keys of 24 bits. A
   pair of texts meets if in some group two segments agree: by these chances 0.995 of the pairs of
   exactly 0.8, and more above.
4. In a bucket, pairs are dropped whose sketches differ in more than FAR bits (a pair of 0.8 has 19.4
   of them on average, with a deviation of 4), and those whose numbers of shingles are not within
   THRESHOLD of each other, which is exact. A bucket of two gives its pair; one of more than MANY
   first gives the star of its most central sketch, with those that likely are links, and its members wait.
5. Every pair is verified by the exact Jaccard similarity of its two texts, and the links of a task
   leave it as stars. The components they make label the members that wait; only pairs with different
   labels can still join something, so only buckets with several labels, and of these only the pairs with
   different ones, are taken to a second turn: their texts get LONG words of further bits, and pairs that differ in
   more than WIDE of them are dropped; a pair leaves only the first bucket that it shares. A group of near copies thus costs about a star.
   FAR and WIDE lie five deviations or more above what simulated pairs of 0.8 have, whatever their size: for 32
   shingles or more a bit differs with a chance of 0.157 at most, for fewer of 0.188 (sums of few signs are often near zero).

Words are parted at white space and lower-cased as bytes. Defined results: texts with one set of
shingles are one node; a null or empty text has no shingles and is like others without any;
fewer than five words are one shingle; ids and repeated rows are as in `simhash`; a very long text is
hashed and compared whole; further columns pass through whatever their names; an empty table works.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.llm.common import col, cut, groups, partitions, text_or_empty, texts_of
from ticktide.llm.components import components
from ticktide.llm.simhash import SEED, _remainders, keep_smallest, stars

SHINGLE = 5
THRESHOLD = 0.8
WORDS = 17
SEGMENTS = 40
GROUP = 8
#: Differing bits of two 128-bit sketches, for texts of SHORT shingles or more and for shorter ones, whose bits turn more easily.
FAR, FAR_SHORT = 41, 47
#: Up to so many differing bits of sketches a star takes a pair at once; the others of its bucket come in the second turn.
LIKELY = 24
#: Words of 64 bits of the second turn, and the same as FAR for their 4,096 bits.
LONG = 64
WIDE, WIDE_SHORT, SHORT = 760, 894, 32
#: Buckets of more give a star first.
MANY = 2
#: Pairs of a bucket that are compared at a time.
AT_ONCE = 1_000_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = np.array([xxhash.xxh64_intdigest(bytes([k]), SEED) | 1 for k in range(WORDS + LONG)], dtype=np.uint64)


def shingle_hashes(text: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.frombuffer(b"".join([xxhash.xxh64_digest(x, SEED) for x in words]), dtype=np.uint64)
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h = (h ^ w[k : k + n]) * _PRIME
        h ^= h >> np.uint64(31)
    return np.unique(h)


def sums(hashes: np.ndarray, factors: np.ndarray = _FACTORS[:WORDS]) -> np.ndarray:
    """For each of 64 bits a factor: how many of the hashes have it set, less how many have not."""
    counts = np.zeros(len(factors) * 64, dtype=np.int64)
    for at in range(0, len(hashes), 255):
        z = hashes[at : at + 255, None] * factors
        z ^= z >> np.uint64(32)
        z *= _MIX
        z ^= z >> np.uint64(29)
        counts += np.add.reduce(np.unpackbits(z.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return 2 * counts - len(hashes)


@lru_cache(maxsize=1)
def _codewords() -> np.ndarray:
    """Half of the codewords as columns of -1 and 1; the other half are their complements."""
    top = np.arange(1 << 11) << 11
    words = top ^ _remainders(top)
    return np.ascontiguousarray(((words[:, None] >> np.arange(23) & 1) * 2 - 1).astype(np.float32).T)


def decode(segments: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword that agrees best with each row of 23 sums."""
    out = np.empty(len(segments), dtype=np.int16)
    for at in range(0, len(segments), 2000):
        fit = segments[at : at + 2000].astype(np.float32) @ _codewords()
        best = np.abs(fit).argmax(axis=1)
        out[at : at + 2000] = np.where(fit[np.arange(len(fit)), best] < 0, best ^ 4095, best)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text_hash, node, s1, s2, indices, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch):
                sets = [shingle_hashes(t) for t in texts_of(part.column(2))]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
                all_sums = np.stack([sums(s) for s in sets])
                found = decode(all_sums[:, : SEGMENTS * 23].reshape(-1, 23)).reshape(len(sets), SEGMENTS)
                own = np.packbits(all_sums[:, SEGMENTS * 23 : SEGMENTS * 23 + 128] > 0, axis=1).view(np.int64)
                packed = pa.array([row.tobytes() for row in found], pa.binary())
                size = pa.array([len(x) for x in sets], pa.int64())
                columns = [part.column(0), part.column(1), pa.array(nodes), pa.array(own[:, 0].copy()), pa.array(own[:, 1].copy()), packed, size]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "s1", "s2", "indices", "size"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, s1 long, s2 long, indices binary, size long")


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, text), (node, size, wide): the number of shingles and the further bits."""
    for batch in batches:
        for part in groups(batch):
            sets = [shingle_hashes(t) for t in texts_of(part.column(1))]
            wide = [np.packbits(sums(s, _FACTORS[WORDS:]) > 0).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(wide, pa.binary())], ["node", "size", "wide"])


#: The two segments of each key.
KEYS = np.array([(g + i, g + j) for g in range(0, SEGMENTS, GROUP) for i, j in combinations(range(GROUP), 2)])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = KEYS
    for batch in batches:
        for part in groups(batch, 2000):
            found = np.frombuffer(b"".join(part.column(3).to_pylist()), dtype=np.int16).reshape(-1, SEGMENTS).astype(np.int64)
            keys = np.arange(len(pairs)) << 24 | found[:, pairs[:, 0]] << 12 | found[:, pairs[:, 1]]
            others = [pa.array(np.repeat(part.column(i).to_numpy(zero_copy_only=False), len(pairs))) for i in (0, 1, 2, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *others], ["key", "node", "s1", "s2", "size"])


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def central(sketch: np.ndarray) -> int:
    """The place of the sketch with the fewest bits unlike most sketches' bits."""
    bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1)
    return int((bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(bits))).sum(axis=1).argmin())


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows in order of key as arrays that hold each key's rows together; binary ones as rows of 64-bit words."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [
            np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)
            for c in batch.columns
        ]
        rows = rows if held is None else [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
        wait = int(np.searchsorted(rows[0], rows[0][-1]))
        if wait:
            yield [r[:wait] for r in rows]
        held = [r[wait:] for r in rows]
    if held is not None:
        yield held


def _like(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can have a Jaccard similarity of THRESHOLD."""
    return 10 * np.minimum(a, b).astype(np.int64) >= round(10 * THRESHOLD) * np.maximum(a, b).astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return both[:, 0].copy(), both[:, 1].copy()


def _near(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, most: int, most_short: int) -> np.ndarray:
    """Whether two texts with m and n shingles can be a pair of THRESHOLD, by these numbers and their bits."""
    return _like(m, n) & (_gaps(a, b) <= np.where(np.minimum(m, n) < SHORT, most_short, most))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of nodes in one bucket whose sketches are near, and the members (key, u, s1, s2) of large buckets."""
    heads = ["key", "u", "v", "s1", "s2"]
    for key, node, s1, s2, count in whole_keys(batches):
        sketch = np.stack([s1, s2], axis=1).view(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        size = np.diff(np.append(starts, len(key)))
        few = np.repeat(size <= MANY, size)
        a, b = [], []
        for step in range(1, int(min(size.max(), MANY))):
            i = np.flatnonzero((key[:-step] == key[step:]) & few[:-step])
            i = i[_near(sketch[i], sketch[i + step], count[i], count[i + step], FAR, FAR_SHORT)]
            a.append(i)
            b.append(i + step)
        for k in np.flatnonzero(size > MANY):
            at = np.arange(starts[k], starts[k] + size[k])
            lead = at[central(sketch[at])]
            near = at[_near(sketch[lead], sketch[at], count[lead], count[at], LIKELY, LIKELY) & (at != lead)]
            a.append(np.full(len(near), lead))
            b.append(near)
        if a and len(x := np.concatenate(a)):
            u, v = _pairs(node[x], node[np.concatenate(b)])
            none = pa.nulls(len(u), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(u), pa.array(v), none, none], heads)
        if (~few).any():
            own = [pa.array(x[~few]) for x in (key, node, s1, s2)]
            yield pa.RecordBatch.from_arrays([own[0], own[1], pa.nulls(len(own[0]), pa.int64()), own[2], own[3]], heads)


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, label, node, size, s1, s2, wide, indices) in order of key and label, the near pairs with different labels.

    A pair is given by the first key that it shares: that bucket has both labels too, or it held these two alone and gave them in the first turn.
    """
    for key, label, node, size, s1, s2, wide, packed in whole_keys(batches):
        indices = np.ascontiguousarray(packed).view(np.int16)
        sketch = np.stack([s1, s2], axis=1).view(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for low, high in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            if label[low] == label[high - 1]:
                continue
            after = np.searchsorted(label[low:high], label[low:high], "right") + low  # the first place behind a label's own
            step = max(1, AT_ONCE // (high - low))
            for k in range(low, high, step):
                place = np.arange(k, min(k + step, high))
                first_after = after[place - low]
                n = high - first_after
                i = np.repeat(place, n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_after, n)
                near = _near(sketch[i], sketch[j], size[i], size[j], FAR, FAR_SHORT)
                i, j = i[near], j[near]
                near = _near(wide[i], wide[j], size[i], size[j], WIDE, WIDE_SHORT)
                i, j = i[near], j[near]
                same = indices[i] == indices[j]
                first = (same[:, KEYS[:, 0]] & same[:, KEYS[:, 1]]).argmax(axis=1) == key[low] >> 24
                if first.any():
                    u, v = _pairs(node[i[first]], node[j[first]])
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def shingles(text: bytes) -> set[bytes]:
    words = text.lower().split()
    if len(words) <= SHINGLE:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)], strict=False)))


def alike(a: set[bytes], b: set[bytes]) -> bool:
    """Jaccard similarity of THRESHOLD (in tenths, so the comparison is exact) or more."""
    shared = len(a & b)
    return 10 * shared >= round(10 * THRESHOLD) * (len(a) + len(b) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (u, v, texts), the links; they leave the task as stars."""
    a, b = [], []
    for batch in batches:
        for part in groups(batch):
            last, own = None, set()
            good = []
            for text, other in zip(texts_of(part.column(2)), texts_of(part.column(3)), strict=True):
                if text != last:
                    last, own = text, shingles(text)
                good.append(alike(own, shingles(other)))
            a.append(part.column(0).to_numpy(zero_copy_only=False)[good])
            b.append(part.column(1).to_numpy(zero_copy_only=False)[good])
    if a:
        u, v = stars(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def near_jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, fingerprint, component_id), one per input row; fingerprint names the node."""
    n = partitions(docs.sparkSession)
    rows = cut(sketches(docs, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "text_hash")).alias("first")
    classes = rows.groupBy("node").agg(F.min("s1").alias("s1"), F.min("s2").alias("s2"), F.first("indices").alias("indices"), F.min("size").cast("int").alias("size"))
    keyed = classes.select("node", "s1", "s2", "indices", "size").mapInArrow(_keys, "key long, node long, s1 long, s2 long, size int")
    found = cut(keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_candidates, "key long, u long, v long, s1 long, s2 long"))
    waiting = found.filter("v IS NULL")
    wanted = found.select(F.explode(F.array("u", "v")).alias("node")).dropna().distinct()
    firsts = rows.join(wanted, "node", "left_semi").groupBy("node").agg(first).select("node", "first.doc_id", "first.text_hash")
    named = docs.select(col(id_col).cast("long").alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_hash"), text_or_empty(text_col).alias("text"))
    texts = named.join(firsts, named["_id"].eqNullSafe(firsts["doc_id"]) & (named["_hash"] == firsts["text_hash"])).select("node", "text")
    texts = cut(texts.dropDuplicates(["node"]))

    def links_of(pairs: DataFrame) -> DataFrame:
        with_one = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
        both = with_one.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
        return both.select("v", "u", "b", "a").mapInArrow(_verify, "u long, v long")

    links = cut(links_of(found.filter("v IS NOT NULL").select("u", "v").distinct()))
    roots = components(links)
    if not waiting.isEmpty():
        labelled = waiting.select("key", F.col("u").alias("node"), "s1", "s2").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("label"), "node", "s1", "s2")
        mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
        labelled = cut(labelled.join(mixed, "key", "left_semi"))
        long = texts.join(labelled.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_long, "node long, size long, wide binary")
        labelled = labelled.join(long.join(classes.select("node", "indices"), "node"), "node").select("key", "label", "node", "size", "s1", "s2", "wide", "indices")
        rest = labelled.repartition(n, "key").sortWithinPartitions("key", "label").mapInArrow(_rest, "u long, v long")
        rest = cut(rest.distinct())
        more = cut(links_of(rest))
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    rooted = rows.groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_node = rooted.join(ids, "root").select("node", F.lpad(F.lower(F.hex("root")), 16, "0").alias("fingerprint"), "component_id")
    return rows.select("doc_id", "text_hash", "node").join(of_node, "node").select("doc_id", "text_hash", "fingerprint", "component_id")


def near_jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` of which each group keeps one: its smallest id (then text hash)."""
    return keep_smallest(docs, near_jaccard_groups(docs, id_col, text_col), id_col, text_col)
