"""Removal of repeated passages by sorting suffixes.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier (in a smaller
document, or earlier in the same one); strings are judged on the input, within documents.

Sorting all suffixes would move many times the input, so only the suffixes are sorted that can
decide something:

1. Anchors. Of the positions in a string of LENGTH bytes, those with the smallest hash of their
   next ANCHOR bytes are its anchors. That depends on the string alone, so equal strings have an
   anchor at the same place, and each suffix that is not an anchor can be left out.
2. Anchors whose hash occurs once in the corpus are dropped.
3. The suffixes at the others, cut to what a string around the anchor can reach, are dealt to
   buckets by their leading token, the bytes of the anchor, between splitters from a sample of
   suffixes. A splitter is a whole leading token, so equal anchors always meet in one bucket and
   nothing has to be compared over a boundary.
4. A bucket is sorted by multikey quicksort, eight bytes a level. Equal suffixes (with equal left
   contexts) become neighbours, of which all but the earliest are covered. Of the distinct ones
   with the same anchor, every string over the anchor is held against the earliest equal one.
   Hashes only propose; bytes decide.
5. An anchor with more than HOT suffixes is no matter for a bucket, whose memory it would fill. All
   strings over it are aggregated to the earliest place of each instead, which combines before the
   shuffle, and joined back, a hot string in as many tasks as there are salts. Their 128-bit digests
   are the keys; the aggregate holds the least and the greatest string of a digest against each other
   and stops the job if they differ, so here too bytes decide.
6. The covered spans go back to their documents.

In a run of a short period (one letter over and over, say) each string but those in the first period
equals the one a period before. Such a run is covered from its second period on, and keeps only the
anchors near its ends, so a text of 20 MB of one letter has some hundred anchors.

Whole copies are told by their SHA-256 first: all but the smallest are covered from end to end and
take no further part. The texts are shuffled by document once; three joins read that exchange.

Identical contexts are folded to the earliest already before they are dealt out, so a passage in
a third of all documents reaches its bucket once per task and boundary, not once per document.

Defined results: a null text is empty; without ties the order of documents is that of their ids;
where ids repeat or are null, documents are ordered by id (null first), then by text digest, and
rows that repeat both are one document with the same result each; a text shorter than LENGTH keeps
all its bytes; an empty table gives an empty table; a very long text is hashed a part at a time, and its
suffixes are made AT_ONCE at a time; further columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktide.llm.common import col, cut, groups, partitions, text_or_empty, texts_of

LENGTH = 100
ANCHOR = 32
#: Bytes of one document, or of several, that are hashed at a time.
SEGMENT = 1 << 20
#: Documents, about, whose anchors give the splitters, and leading tokens that they give in all.
SAMPLE, TOKENS = 300, 30_000
#: Suffixes that are made at a time.
AT_ONCE = 100_000
#: Tasks that a hot string is joined in.
SALTS = 16
#: Up to so many suffixes a call sorts by all words at once.
SMALL = 48
#: An anchor with more suffixes than this has each string over it compared by an aggregate instead of in a bucket.
HOT = 50_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_U64 = (1 << 64) - 1


def _table() -> np.ndarray:
    """256 scattered 64-bit numbers, by multiplication and shifts."""
    x = (np.arange(1, 257, dtype=np.uint64)) * _ODD
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


TABLE = _table()


def _sliding(x: np.ndarray, width: int, pick: Callable[[Any, Any], Any]) -> np.ndarray:
    """pick over each run of `width` entries."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def _hashes(data: np.ndarray) -> np.ndarray:
    """Of the ANCHOR bytes at each position; never 0."""
    h, done, power = TABLE[data], 1, int(_ODD)
    while done < ANCHOR:
        h = h[:-done] * np.uint64(power) + h[done:]
        done, power = done * 2, power * power & _U64
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def anchors(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of the strings that start where `valid` is set."""
    if len(data) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    width = length - ANCHOR + 1
    h = _hashes(data)
    low = _sliding(h, width, np.minimum)
    low[~valid[: len(low)]] = 0
    pad = np.zeros(width - 1, dtype=np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), width, np.maximum) == h)
    return chosen, h[chosen]


def anchors_of(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, position, hash) arrays for `texts`, a bounded part at a time."""

    def together(first: int, part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in part])
        data = np.frombuffer(b"".join(part), dtype=np.uint8)
        ends = np.cumsum(sizes)
        valid = np.arange(len(data)) + length <= np.repeat(ends, sizes)
        at, h = anchors(data, valid, length)
        which = np.searchsorted(ends, at, "right")
        return which + first, at - (ends - sizes)[which], h

    part: list[bytes] = []
    first = held = 0
    for k, text in enumerate(texts):
        if len(text) > SEGMENT:
            places, found = [], []
            for start in range(0, len(text) - length + 1, SEGMENT):
                data = np.frombuffer(text[start : start + SEGMENT + length - 1], dtype=np.uint8)
                at, h = anchors(data, np.ones(len(data), dtype=bool), length)
                places.append(at + start)
                found.append(h)
            at, keep = np.unique(np.concatenate(places), return_index=True)
            yield np.full(len(at), k), at, np.concatenate(found)[keep]
        if part and held + len(text) > SEGMENT:
            yield together(first, part)
            part, held = [], 0
        if not part:
            first = k
        part.append(b"" if len(text) > SEGMENT else text)
        held += len(part[-1])
    if part:
        yield together(first, part)


def runs_of(which: np.ndarray, at: np.ndarray, h: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """For anchors in order: which to keep, and (text number, start, stop) that runs of a short period cover.

    A run of anchors with one hash and one gap is a run of bytes with that gap as its period, if the
    bytes say so. The string at each place from its second period on equals the one a period before.
    """
    keep, spans = np.ones(len(at), dtype=bool), []
    gap = np.diff(at)
    step = np.where((which[1:] == which[:-1]) & (h[1:] == h[:-1]) & (gap <= length - ANCHOR + 1), gap, 0)
    starts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])[: len(step)])
    n = np.diff(np.append(starts, len(step)))
    long = n * step[starts] > 4 * length
    for i, steps, period in zip(starts[long].tolist(), n[long].tolist(), step[starts[long]].tolist(), strict=True):
        a, b, text = int(at[i]), int(at[i + steps]), texts[which[i]]
        if text[a + period : b + ANCHOR] == text[a : b + ANCHOR - period]:
            spans.append((int(which[i]), a + period, b + ANCHOR))
            own = at[i : i + steps + 1]
            keep[i : i + steps + 1] &= (own < a + period + length - ANCHOR) | (own > b + ANCHOR - length)
    return keep, spans


def portions(uids: list[int], texts: list[bytes], places: list[np.ndarray]) -> Iterator[list[tuple[int, bytes, np.ndarray]]]:
    """Rows (uid, text, places), parted and put together to some AT_ONCE places each."""
    held, size = [], 0
    for uid, text, at in zip(uids, texts, places, strict=True):
        for k in range(0, len(at), AT_ONCE):
            held.append((uid, text, at[k : k + AT_ONCE]))
            size += len(held[-1][2])
            if size >= AT_ONCE:
                yield held
                held, size = [], 0
    if held:
        yield held


def contexts(text: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """A row per anchor: what a string over it can hold, left part then suffix, then both sizes."""
    left = length - ANCHOR
    padded = np.frombuffer(bytes(left) + text + bytes(length), dtype=np.uint8)
    rows = np.empty((len(at), left + length + 4), dtype=np.uint8)
    rows[:, :-4] = np.lib.stride_tricks.sliding_window_view(padded, left + length)[at]
    rows[:, -4:] = np.stack([np.minimum(at, left).astype("<u2"), np.minimum(len(text) - at, length).astype("<u2")], axis=1).view(np.uint8)
    return rows


def _sizes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(rows[:, -4:]).view("<u2").astype(np.int64)
    return both[:, 0], both[:, 1]


def _words(rows: np.ndarray) -> np.ndarray:
    """Big-endian 64-bit words, zero-padded."""
    full = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    full[:, : rows.shape[1]] = rows
    return full.view(">u8").astype(np.uint64)


def spans_at(doc: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans covered by the strings that start `low` to `high` bytes before the anchors."""
    some = low <= high
    return doc[some], (at - high)[some], (at - low + length)[some]


def all_covered(rows: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left, right = _sizes(rows)
    return spans_at(doc, at, np.maximum(0, length - right), left, length)


def joined(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order of document and place, with neighbours that touch made one."""
    if not len(doc):
        return doc, start, stop
    breaks = np.flatnonzero((doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])) + 1
    firsts = np.concatenate([[0], breaks])
    return doc[firsts], start[firsts], np.maximum.reduceat(stop, firsts)


def fold(rows: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks the rows that equal an earlier one's; a clash of hashes only leaves a row unmarked."""
    words = _words(rows)
    with np.errstate(over="ignore"):
        mark = (words * (TABLE[: words.shape[1]] | np.uint64(1))).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((at, doc, mark))
    first = np.concatenate([[True], mark[order][1:] != mark[order][:-1]])
    lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    out = np.zeros(len(rows), dtype=bool)
    out[order] = ~first & (words[order] == words[lead]).all(axis=1)
    return out


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of the rows of `words`: three-way partition by one word, the equal part by the next."""
    order, stack = np.arange(len(words)), [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2 or depth == words.shape[1]:
            continue
        own = order[low:high]
        if high - low <= SMALL:
            order[low:high] = own[np.lexsort(words[own, depth:].T[::-1])]
            continue
        key = words[own, depth]
        pivot = np.sort(key[:: max(1, len(key) // 31)])[min(len(key), 31) // 2]
        less, more = key < pivot, key > pivot
        order[low:high] = np.concatenate([own[less], own[~(less | more)], own[more]])
        a, b = low + int(less.sum()), high - int(more.sum())
        stack += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def compare(rows: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Covered spans (document, start, stop) among the suffixes of one bucket."""
    left = length - ANCHOR
    words = np.concatenate([_words(rows[:, left:-4]), _words(np.concatenate([rows[:, :left], rows[:, -4:]], axis=1))], axis=1)
    order = multikey_quicksort(words)
    words, rows, doc, at = words[order], rows[order], doc[order], at[order]
    differs = words[1:] != words[:-1]
    run = np.concatenate([[0], np.cumsum(differs.any(axis=1))])
    anchor = np.concatenate([[0], np.cumsum(differs[:, : ANCHOR // 8].any(axis=1))])
    order = np.lexsort((at, doc, run))
    rows, doc, at, run, anchor = rows[order], doc[order], at[order], run[order], anchor[order]
    leads = np.concatenate([[True], run[1:] != run[:-1]])
    again = ~leads & ((doc != np.roll(doc, 1)) | (at != np.roll(at, 1)))
    yield all_covered(rows[again], doc[again], at[again], length)
    rows, doc, at, anchor = rows[leads], doc[leads], at[leads], anchor[leads]
    _, place, count = np.unique(anchor, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    if shared.any():
        rows, doc, at, anchor = rows[shared], doc[shared], at[shared], anchor[shared]
        order = np.lexsort((at, doc))
        yield from _strings(rows[order], doc[order], at[order], anchor[order], length)


def _strings(rows: np.ndarray, doc: np.ndarray, at: np.ndarray, anchor: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows come in order of document and place: the first of equal strings is the earliest."""
    span = length - ANCHOR
    lefts, rights = _sizes(rows)
    prefix = np.zeros((rows.shape[1] - 3, len(rows)), dtype=np.uint64)
    for i in range(rows.shape[1] - 4):
        prefix[i + 1] = prefix[i] * _ODD + TABLE[rows[:, i]]
    factor = np.uint64(pow(int(_ODD), length, 1 << 64))
    low, high = np.full(len(rows), span + 1), np.full(len(rows), -1)
    for back in range(span + 1):
        can = np.flatnonzero((lefts >= back) & (rights >= length - back))
        start = span - back
        mark = (prefix[start + length, can] - prefix[start, can] * factor) ^ (anchor[can].astype(np.uint64) * TABLE[7])
        order = np.argsort(mark, kind="stable")
        first = np.concatenate([[True], mark[order][1:] != mark[order][:-1]])[: len(order)]
        lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
        hit, of = can[order[~first]], can[lead[~first]]
        same = (rows[hit, start : start + length] == rows[of, start : start + length]).all(axis=1)
        if not same.all():  # two strings with one mark: by the bytes themselves
            own = np.ascontiguousarray(rows[can, start : start + length]).view(f"V{length}").ravel()
            _, firsts = np.unique(own, return_index=True)
            hit, same = np.delete(can, firsts), np.ones(len(can) - len(firsts), dtype=bool)
        hit = hit[same]
        low[hit], high[hit] = np.minimum(low[hit], back), np.maximum(high[hit], back)
    yield spans_at(doc, at, low, high, length)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows (uid, text) of the documents, and where ids aren't unique the rows (uid, doc_id).

    uid is the id itself where ids are unique, else the place in the documents' order.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    odd = rows.select("doc_id").groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL")
    if odd.isEmpty():  # the filter, which drops nothing, makes the three joins' inputs one exchange
        return rows.select(F.col("doc_id").alias("uid"), "text").filter("uid IS NOT NULL"), None
    named = rows.withColumn("digest", F.sha2("text", 256))
    ordered = named.select("doc_id", "digest").distinct().orderBy(F.asc_nulls_first("doc_id"), "digest")
    places = ordered.rdd.zipWithIndex().map(lambda r: (r[0][0], r[0][1], r[1])).toDF("_id long, _digest string, uid long")
    found = cut(named.join(places, named["doc_id"].eqNullSafe(places["_id"]) & (named["digest"] == places["_digest"])).select("uid", "doc_id", "text"))
    return found.select("uid", "text").dropDuplicates(["uid"]), found.select("uid", "doc_id")


def _splitters(rows: DataFrame, buckets: int, length: int) -> list[bytes]:
    """Up to buckets - 1 leading tokens (the bytes of an anchor), from the anchors of a bounded sample.

    The sample is the documents under a threshold of their ids' hash, so about SAMPLE whatever the
    input, and all of them where there are fewer. Each gives as many tokens, evenly spread.
    """
    n = rows.count()
    quota = max(1, TOKENS // max(1, min(n, SAMPLE)))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch):
                texts = texts_of(part.column(0))
                for which, at, h in anchors_of(texts, length):
                    keep, _ = runs_of(which, at, h, texts, length)
                    which, at = which[keep], at[keep]
                    edges = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)]
                    picked = np.concatenate([np.unique(np.linspace(a, b - 1, min(quota, b - a)).astype(np.int64)) for a, b in zip(edges, edges[1:], strict=False)])
                    yield pa.RecordBatch.from_arrays([pa.array([texts[w][p : p + ANCHOR] for w, p in zip(which[picked].tolist(), at[picked].tolist(), strict=True)], pa.binary())], ["token"])

    share = SAMPLE / max(n, 1)
    mark = F.xxhash64("uid") <= F.lit(int((share - 0.5) * 2**64) if share < 1 else (1 << 63) - 1)
    words = sorted(bytes(r["token"]) for r in rows.filter(mark).select("text").mapInArrow(tokens, "token binary").collect())
    return sorted({words[len(words) * k // buckets] for k in range(1, buckets)}) if words else []


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows with uid, doc_id, text, spans: the covered spans of each text's bytes, as they were found."""
    return _found(docs, length, id_col, text_col)[0]


def _found(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """The rows of `repeated_spans`, and whether ids tell all rows apart."""
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be {2 * ANCHOR} or more")
    rows, names = _keyed(docs, id_col, text_col)
    n = partitions(docs.sparkSession)
    digests = rows.select("uid", F.sha2("text", 256).alias("digest"))
    twins = digests.groupBy("digest").agg(F.min("uid").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "keep")
    copies = digests.join(twins, "digest").filter("uid <> keep").select("uid")
    cuts = _splitters(rows, 4 * n, length)

    heads_found = ["h", "uid", "pos", "stop"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors, by odd h (stop null), and covered runs (stop set), under even h that deal them out by document."""
        for batch in batches:
            uids, texts = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1))
            for which, at, h in anchors_of(texts, length):
                keep, runs = runs_of(which, at, h, texts, length)
                which, at, h = which[keep], at[keep], h[keep]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(uids[which]), pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.int32())], heads_found)
                if runs:
                    of, start, stop = (np.array(c) for c in zip(*runs, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(uids[of] * 2), pa.array(uids[of]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], heads_found)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of h, those whose h has another row; hot where it has more than HOT.

        The last run of equal h waits for the next batch, HOT rows of it at most.
        """

        def out(rows: list[np.ndarray], keep: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[1][keep]), pa.array(rows[2][keep].astype(np.int32)), pa.array(hot[keep]), pa.nulls(int(keep.sum()), pa.int32())], ["uid", "pos", "hot", "stop"])

        held: list[np.ndarray] | None = None
        known = None  # the h of the last run, where that is hot
        for batch in batches:
            if (ready := batch.column(3).is_valid()).true_count:
                done = batch.filter(ready)
                yield pa.RecordBatch.from_arrays([done.column(1), done.column(2), pa.array(np.zeros(done.num_rows, dtype=bool)), done.column(3)], ["uid", "pos", "hot", "stop"])
                batch = batch.filter(batch.column(3).is_null())
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rows = rows if held is None else [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
            h = rows[0]
            starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            n = np.repeat(np.diff(np.append(starts, len(h))), np.diff(np.append(starts, len(h))))
            hot = n > HOT
            if known is not None:
                hot |= h == known
            known = h[-1] if hot[-1] else None
            wait = len(h) if known is not None else starts[-1]
            held = None if known is not None else [r[wait:] for r in rows]
            yield out([r[:wait] for r in rows], ((n > 1) | hot)[:wait], hot[:wait])
        if held is not None and len(held[0]) > 1:
            every = np.ones(len(held[0]), dtype=bool)
            yield out(held, every, ~every)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All strings over hot anchors, with their digests."""
        for batch in batches:
            for uid, text, places in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2), strict=True):
                at, last = np.sort(places.values.to_numpy(zero_copy_only=False).astype(np.int64)), -1
                for k in range(0, len(at), 2000):
                    own = np.unique(at[k : k + 2000, None] - np.arange(length - ANCHOR + 1))
                    own = own[(own > last) & (own + length <= len(text))]
                    last = max(last, int(own[-1])) if len(own) else last
                    found = [text[a : a + length] for a in own.tolist()]
                    digests = [hashlib.blake2b(x, digest_size=16).digest() for x in found]
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(np.full(len(own), uid)), pa.array(own.astype(np.int32)), pa.array(found, pa.binary())], ["digest", "uid", "start", "string"])

    heads = ["bucket", "uid", "pos", "stop", "context"]

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts to compare (stop null), and spans that are covered already (context null)."""
        bounds = np.array(cuts, dtype=f"S{ANCHOR}")

        def ready(d: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
            spread = pa.array((d % max(1, 4 * n)).astype(np.int32))
            return pa.RecordBatch.from_arrays([spread, pa.array(d), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.nulls(len(d), pa.binary())], heads)

        for batch in batches:
            for part in groups(batch):
                runs = part.column(3)
                if (of := pc.list_parent_indices(runs).to_numpy(zero_copy_only=False)).size:
                    flat = runs.flatten()
                    yield ready(part.column(0).to_numpy(zero_copy_only=False)[of], flat.field("pos").to_numpy(zero_copy_only=False), flat.field("stop").to_numpy(zero_copy_only=False))
                places = [np.sort(p.values.to_numpy(zero_copy_only=False).astype(np.int64)) for p in part.column(2)]
                for own in portions(part.column(0).to_pylist(), texts_of(part.column(1)), places):
                    made = np.concatenate([contexts(t, p, length) for _, t, p in own])
                    doc, at = np.repeat(np.array([u for u, _, _ in own]), [len(p) for _, _, p in own]), np.concatenate([p for _, _, p in own])
                    old = fold(made, doc, at)
                    d, start, stop = joined(*all_covered(made[old], doc[old], at[old], length))
                    new = np.ascontiguousarray(made[~old])
                    lead = np.ascontiguousarray(new[:, length - ANCHOR : length]).view(f"S{ANCHOR}").ravel()
                    offsets = np.arange(0, new.size + 1, new.shape[1], dtype=np.int32)
                    texts = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets), pa.py_buffer(new)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.searchsorted(bounds, lead, "right").astype(np.int32)), pa.array(doc[~old]), pa.array(at[~old].astype(np.int32)), pa.nulls(len(new), pa.int32()), texts], heads
                    )
                    if len(d):
                        yield ready(d, start, stop)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(doc: Any, start: Any, stop: Any) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["uid", "start", "stop"])

        def sort(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            rows_ = np.frombuffer(b"".join(whole["context"].to_pylist()), dtype=np.uint8).reshape(whole.num_rows, -1)
            for doc, start, stop in compare(rows_, whole["uid"].to_numpy(), whole["pos"].to_numpy().astype(np.int64), length):
                if len(doc):
                    yield out(doc, start.astype(np.int32), stop.astype(np.int32))

        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            ready = batch.column(3).is_valid()
            if ready.true_count:
                done = batch.filter(ready)
                yield out(done.column(1), done.column(2), done.column(3))
                batch = batch.filter(batch.column(3).is_null())
            number = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if number[a] != current and held:
                    yield from sort(held)
                    held = []
                current = number[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from sort(held)

    # not an anti join, which the optimizer would move below the texts' exchange and so take from another one
    first = rows.join(copies.withColumn("copy", F.lit(True)), "uid", "left").filter("copy IS NULL").select("uid", "text")
    twice = first.mapInArrow(find, "h long, uid long, pos int, stop int").repartition(n, "h").sortWithinPartitions("h").mapInArrow(repeated, "uid long, pos int, hot boolean, stop int")
    run = F.when(F.col("stop").isNotNull(), F.struct("pos", "stop"))
    plain = F.when(~F.col("hot") & F.col("stop").isNull(), F.col("pos"))
    places = twice.groupBy("uid").agg(F.collect_list(plain).alias("places"), F.collect_list(F.when(F.col("hot"), F.col("pos"))).alias("hot"), F.collect_list(run).alias("runs"))
    some = places.filter((F.size("places") > 0) | (F.size("runs") > 0))
    dealt = rows.join(some, "uid").select("uid", "text", "places", "runs").mapInArrow(suffixes, "bucket int, uid long, pos int, stop int, context binary")
    spans = dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(buckets, "uid long, start int, stop int")
    near_hot = places.filter(F.size("hot") > 0).select("uid", "hot").repartition(n, "uid")
    each = rows.join(near_hot, "uid").select("uid", "text", "hot").mapInArrow(strings, "digest binary, uid long, start int, string binary")
    each = each.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    low, high = F.min("low").alias("low"), F.max("high").alias("high")
    salted = each.groupBy("digest", "salt").agg(F.min(F.struct("uid", "start")).alias("first"), F.count(F.lit(1)).alias("n"), F.min("string").alias("low"), F.max("string").alias("high"))
    firsts = salted.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"), low, high).filter("n > 1")
    checked = F.when(F.col("low") == F.col("high"), F.col("salts")).otherwise(F.raise_error(F.lit("two different strings share a digest")).cast("array<int>"))
    firsts = firsts.select("digest", "first", F.explode(checked).alias("salt"))
    again = each.select("digest", "salt", "uid", "start").join(firsts, ["digest", "salt"]).filter(F.struct("uid", "start") != F.col("first")).select("uid", "start", (F.col("start") + length).alias("stop"))
    spans = spans.unionByName(again)
    own = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    covered = own.unionByName(copies.select("uid", F.array(F.struct(F.lit(0).alias("start"), F.lit(-1).alias("stop"))).alias("spans")))
    size = F.octet_length("text")
    whole = F.when(size >= length, F.array(F.struct(F.lit(0).alias("start"), size.alias("stop"))))
    found = rows.join(covered, "uid", "left").withColumn("spans", F.when(F.col("spans")[0]["stop"] == -1, whole).otherwise(F.col("spans")))
    return (found.withColumn("doc_id", F.col("uid")), True) if names is None else (found.join(names, "uid"), False)


def merged(spans: list[Any] | None) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that `spans` cover."""
    out: list[tuple[int, int]] = []
    for s in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def remaining(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the parts of characters at their edges."""
    out = []
    for a, b in runs:
        while a < b and a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def span_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch):
                out = []
                for text, spans in zip(texts_of(part.column(1)), part.column(2).to_pylist(), strict=True):
                    runs = merged(spans)
                    out.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(remaining(text, runs)).hexdigest()))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeated_spans(docs, length).select("doc_id", "text", "spans")
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated passages cut out of their texts (at whole characters).

    Documents that nothing was cut from stay as they are; one with only white space left goes.
    All columns stay; n_chars, where there is one, is counted anew. Ids must tell rows with
    different texts apart: a row that repeats another's id and text is dropped.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    counted = "n_chars" if text_col != "n_chars" and "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, T.IntegralType) else None
    payload = [c for c in docs.columns if c != text_col]
    schema = T.StructType([T.StructField(names[c], docs.schema[c].dataType) for c in payload] + [T.StructField(names[text_col], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch):
                *own, void, texts, spans = part.columns
                rests = [remaining(t, whole_characters(t, merged(s))) if s else t for t, s in zip(texts_of(texts), spans.to_pylist(), strict=True)]
                cut = spans.is_valid()
                gone = pa.array([not r.strip() for r in rests])
                made = pc.if_else(void, None, pa.array(rests, pa.binary()).cast(pa.string()))
                if counted:
                    k = payload.index(counted)
                    own[k] = pc.if_else(cut, pc.utf8_length(made).cast(own[k].type), own[k])
                yield pa.RecordBatch.from_arrays([*own, made], schema.names).filter(pc.invert(pc.and_(cut, gone)))

    found, unique = _found(docs, length, id_col, text_col)
    tell = lambda c: F.lit(0).cast("long") if unique else F.xxhash64(c)
    found = found.select(F.col("doc_id").alias("id"), tell(F.col("text")).alias("hash"), "text", "spans")
    own = docs.select(*[col(c).alias(names[c]) for c in payload], col(id_col).cast("long").alias("own_id"), tell(text_or_empty(text_col)).alias("own_hash"), col(text_col).isNull().alias("void"))
    if unique:  # the texts lie by id already
        joined = own.join(found, own["own_id"] == found["id"])
    else:
        joined = own.join(found.dropDuplicates(["id", "hash"]), own["own_id"].eqNullSafe(found["id"]) & (own["own_hash"] == found["hash"]))
    out = joined.select(*[names[c] for c in payload], "void", "text", "spans").mapInArrow(run, schema)
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns])
