"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

Fingerprint: 64 bits; a bit is set if it is set in over half of the XXH64 (seed 42) values of the
word shingles, repeats included.

Search: a fingerprint is cut into three segments (22, 21 and 21 bits). The perfect (23, 12, 7) Golay
code gives fuzzy keys for a segment: padded to 23 bits, it decodes to the index of its only codeword
within distance three, and the indices of the segment and of its neighbours at one bit, at most
six, hold the index of every vector one bit away. Three wrong bits fall in one of two ways:

* a segment has two or more of them. Of the other two one is right and the other has one error at
  most, so the first's bits and the second's index are a key, of 33 bits or more, for each of the six
  ordered pairs: stored once, looked up under the second's indices.
* no segment has more than one. All three indices are a key of 36 bits: stored under the indices of
  the third segment, looked up under those of the first two.

So each fingerprint is stored under 12 keys at most and looked up under 72, keys are long enough
that unlike fingerprints seldom meet, and what meets is verified by the count of differing bits.

Equal fingerprints are one node throughout, so a group of copies costs what one document costs.
A bucket's verified links leave its task as a star, never as all pairs; a task holds the stored
fingerprints of one key at a time.

Defined results: a null or empty text has fingerprint 0 and is linked like any other; fewer words
than a shingle hash as one whole; a component's id is its smallest non-null id; repeated rows are
kept each with the same result; an empty table gives an empty table; a very long text is hashed whole,
its shingles a part at a time; further columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.llm.common import col, cut, fresh, groups, partitions, text_or_empty, texts_of
from ticktide.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: (shift, bits) of the three segments.
SEGMENTS = [(42, 22), (21, 21), (0, 21)]
#: Generator polynomial of the binary Golay code, a fixed value.
GENERATOR = 0b101011100011
#: Candidate pairs that are compared at a time.
AT_ONCE = 2_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, counts = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 50_000):
        own = words[at : min(at + 50_000, n) + shingle - 1]
        joined = map(b" ".join, zip(*[own[k:] for k in range(shingle)], strict=False)) if len(own) >= shingle else [b" ".join(own)]
        bits = np.frombuffer(b"".join([digest(s, SEED) for s in joined]), dtype=np.uint8)
        counts += np.unpackbits(bits.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, text_hash, fp): text_hash tells rows that share an id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch):
                fps = np.array([fingerprint(t, shingle) for t in texts_of(part.column(2))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _remainders(values: np.ndarray) -> np.ndarray:
    """Of 23-bit polynomials, modulo the generator."""
    out = values.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


class Golay:
    """Decodes 23-bit vectors to the 12-bit index of the codeword within distance three."""

    def __init__(self) -> None:
        self.high = _remainders(np.arange(1 << 12) << 11)
        patterns = [sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)]
        self.error = np.zeros(1 << 11, dtype=np.int64)
        self.error[_remainders(np.array(patterns))] = patterns

    def index(self, vectors: np.ndarray) -> np.ndarray:
        syndrome = self.high[vectors >> 11] ^ (vectors & 2047)
        return (vectors ^ self.error[syndrome]) >> 11

    def near(self, vectors: np.ndarray, bits: int) -> np.ndarray:
        """A row per vector: the distinct indices of it and of its one-bit neighbours, then -1."""
        flips = np.concatenate([[0], 1 << np.arange(bits)])
        found = np.sort(self.index(vectors[:, None] ^ flips), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return -np.sort(-found, axis=1)[:, :6]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, role): role 0 stores a fingerprint under a key, role 1 looks it up.

    The top three bits of a key tell the six ordered pairs (0 to 5) and the triple (6) apart.
    """
    code = Golay()
    for batch in batches:
        fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
        for at in range(0, len(fps), 5000):
            own = fps[at : at + 5000]
            raw = [((own >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
            index = [code.index(p) for p in raw]
            near = [code.near(p, b) for p, (_, b) in zip(raw, SEGMENTS, strict=True)]
            keys, names, roles = [], [], []

            def add(key: np.ndarray, good: np.ndarray, role: int) -> None:
                keys.append(key.reshape(len(own), -1)[good.reshape(len(own), -1)])  # noqa: B023
                names.append(np.repeat(own, good.reshape(len(own), -1).sum(axis=1)))  # noqa: B023
                roles.append(np.full(len(keys[-1]), role, dtype=np.int32))  # noqa: B023

            for kind, (i, j) in enumerate(permutations(range(3), 2)):
                base = kind << 60 | raw[i] << 12
                add(base | index[j], np.ones(len(own), dtype=bool), 0)
                add(base[:, None] | near[j], near[j] >= 0, 1)
            a, b, c = near[0][:, :, None], near[1][:, None, :], near[2]
            add(6 << 60 | (index[0] << 24 | index[1] << 12)[:, None] | c, c >= 0, 0)
            add(6 << 60 | a << 24 | b << 12 | index[2][:, None, None], (a >= 0) & (b >= 0), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(roles))], ["key", "fp", "role"]
            )


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b as a star for each of their components: (node, smallest node)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        high, low = np.maximum(x, y), np.minimum(x, y)
        open_ = high != low
        if not open_.any():
            break
        np.minimum.at(up, high[open_], low[open_])
        while (up[up] != up).any():
            up = up[up]
    own = up != np.arange(len(nodes))
    return nodes[own], nodes[up[own]]


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of key, stored ones first; only those of the last key wait for the next batch."""
        keys, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        found_a: list[np.ndarray] = []
        found_b: list[np.ndarray] = []
        held = 0

        def shrink() -> None:
            nonlocal found_a, found_b, held
            a, b = stars(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            last, own = key[-1], role == 0
            keys, fps = np.concatenate([keys, key[own]]), np.concatenate([fps, fp[own]])
            key, fp = key[~own], fp[~own]
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for start, stop in _spans(high - low):
                count = (high - low)[start:stop]
                first = np.repeat(low[start:stop] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
                a, b = np.repeat(fp[start:stop], count), fps[first + np.arange(len(first))]
                near = (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= distance) & (a != b)
                if near.any():
                    found_a.append(a[near])
                    found_b.append(b[near])
                    held += len(found_a[-1])
                    if held > AT_ONCE:
                        shrink()
            wait = np.searchsorted(keys, last)
            keys, fps = keys[wait:], fps[wait:]
        if found_a:
            shrink()
            yield pa.RecordBatch.from_arrays([pa.array(found_a[0]), pa.array(found_b[0])], ["u", "v"])

    return run


def _spans(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose counts sum to about AT_ONCE at most."""
    total = np.cumsum(counts)
    start = 0
    while start < len(counts):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + AT_ONCE, "right")))
        yield start, stop
        start = stop


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Rows (doc_id, text_hash, fingerprint, component_id), one per input row."""
    if not 0 <= distance <= 3:
        raise ValueError("the three-segment keys find distances of 0 to 3")
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    n = partitions(docs.sparkSession)
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    keyed = classes.select("fp").mapInArrow(_keys, "key long, fp long, role int")
    links = keyed.repartition(n, "key").sortWithinPartitions("key", "role").mapInArrow(_links(distance), "u long, v long")
    roots = components(links)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs` of which each group keeps one: its smallest id (then text hash)."""
    return keep_smallest(docs, near_duplicate_groups(docs, id_col, text_col, shingle, distance), id_col, text_col)


def keep_smallest(docs: DataFrame, groups_: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each component in rows (doc_id, text_hash, fingerprint, component_id), the row with the smallest id (then text hash)."""
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    kept = (
        groups_.withColumn("group", F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint")))
        .groupBy("group").agg(F.min(rank).alias("best"))
        .select(F.col("best.id").alias("_id"), F.col("best.hash").alias("_hash"))
    )
    hash_, id_, text_hash = fresh(docs, "text_hash"), fresh(docs, "kept_id"), fresh(docs, "kept_hash")
    named = docs.withColumn(hash_, F.xxhash64(text_or_empty(text_col)))
    kept = kept.select(F.col("_id").alias(id_), F.col("_hash").alias(text_hash))
    return named.join(kept, col(id_col).eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(text_hash)), "left_semi").drop(hash_)
