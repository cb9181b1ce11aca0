"""Language identification by rank-order n-gram profiles (out-of-place distance).

A text's n-grams are those of its words: runs of letters (Unicode category L), lower-cased, with a
`_` on either side, all n-grams of 1 to NGRAM characters. A language's profile ranks its PROFILE
most frequent n-grams over all learning texts; a document's profile ranks its own most frequent
ones. The out-of-place distance adds, over the document's n-grams, how far each rank lies from the
language's rank, at most PROFILE for one that the language lacks; the smallest distance wins.

Learning counts n-grams per language inside tasks and sums them in Spark; only the profiles,
PROFILE rows for each learned language, come to the driver and go to the tasks. An n-gram is a
64-bit code, 21 bits a character, so the n-grams of a text are shifts of its array of characters, are
counted by one sort, and codes sort as the n-grams do.

Score: 1 - best / runner-up distance (with a single language 1 - best / largest possible).

Defined results: a text that is null or has no letter is `und` with score 0; nothing learned at
all also gives `und`; ties of frequency go to the n-gram that sorts first, ties of distance to the
language that sorts first; repeated rows are judged each; an empty table gives an empty table; a
very long text is counted a part at a time, whole; further columns pass through whatever their
names, but those called lang_pred or score, which are replaced.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktide.llm.common import col, groups, others

NGRAM = 3
PROFILE = 400
#: Characters whose n-grams are counted at a time, and n-grams that a task counts before it adds them up.
PART, HELD = 1 << 18, 1 << 21
MARK = ord("_")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def added(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts (1 each if not given)."""
    order = None if counts is None else np.argsort(codes, kind="stable")
    codes = np.sort(codes) if order is None else codes[order]
    firsts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)])
    if order is None:
        return codes[firsts], np.diff(np.append(firsts, len(codes)))
    return codes[firsts], np.add.reduceat(counts[order], firsts) if len(firsts) else counts[:0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text, in order of code."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[chars]
    if not letter.any():
        return (np.zeros(0, dtype=np.int64),) * 2
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each run between words, the first place stands for the mark
    inner = np.where(letter, chars, MARK)[keep]
    marks = ([MARK] if letter[0] else []), ([MARK] if letter[-1] else [])
    if not letter[0]:
        marks = [MARK], marks[1]
    x = np.concatenate([marks[0], inner, marks[1]]).astype(np.int64)
    found = []
    for at in range(0, len(x), PART):
        own = x[at : at + PART + NGRAM - 1]
        one = own[:PART]
        pair = own[: PART + 1]
        three = own[:-2] << 42 | own[1:-1] << 21 | own[2:]
        found.append(added(np.concatenate([one[one != MARK] << 42, pair[:-1] << 42 | pair[1:] << 21, three[own[1:-1] != MARK]])))
    return found[0] if len(found) == 1 else added(*(np.concatenate(c) for c in zip(*found, strict=True)))


def gram(code: int) -> str:
    return "".join(chr(c) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c)


def code_of(gram_: str) -> int:
    return sum(ord(c) << 42 - 21 * k for k, c in enumerate(gram_))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", profile: int = PROFILE) -> dict[str, dict[str, int]]:
    """Ranks from 0 of each language's most frequent n-grams, over all rows of `docs`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def add_up() -> int:
            for lang, parts in held.items():
                held[lang] = [added(*(np.concatenate(c) for c in zip(*parts, strict=True)))]
            return sum(len(parts[0][0]) for parts in held.values())

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, ((codes, n),) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(map(gram, codes.tolist()), pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for part in groups(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.setdefault(lang, []).append(gram_counts(text))
                    size += len(held[lang][-1][0])
                    if size > HELD and (size := add_up()) > HELD // 2:
                        yield from rows()
                        held, size = {}, 0
        add_up()
        yield from rows()

    known = docs.select(col(lang_col).cast("string").alias("lang"), col(text_col).alias("text")).dropna()
    counts = known.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    out: dict[str, dict[str, int]] = {}
    for row in counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= profile).collect():
        out.setdefault(row["lang"], {})[row["gram"]] = row["rank"] - 1
    return out


class Ranker:
    """Distances of texts to learned profiles."""

    def __init__(self, profiles: dict[str, dict[str, int]], profile: int = PROFILE) -> None:
        self.langs, self.profile = sorted(profiles), profile
        self.codes = np.array(sorted({code_of(g) for p in profiles.values() for g in p}), dtype=np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            for own, rank in profiles[lang].items():
                self.ranks[k, np.searchsorted(self.codes, code_of(own))] = rank

    def judge(self, text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text) if text and self.langs else (np.zeros(0, dtype=np.int64),) * 2
        if not len(codes):
            return "und", 0.0
        if len(codes) > self.profile:  # all that reach the last place's count; ties are settled by code
            last = len(codes) - self.profile
            high = counts >= np.partition(counts, last)[last]
            codes, counts = codes[high], counts[high]
        top = codes[np.argsort(-counts, kind="stable")[: self.profile]]
        at = np.searchsorted(self.codes[:-1], top)
        ranks = self.ranks[:, np.where(self.codes[at] == top, at, len(self.codes))]
        away = np.where(ranks < 0, self.profile, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        order = np.argsort(away, kind="stable")
        best, most = away[order[0]], away[order[1]] if len(order) > 1 else self.profile * len(top)
        return self.langs[order[0]], float(1 - best / most) if most else 0.0


@lru_cache(maxsize=1)
def ranker_of(profiles: str, profile: int) -> Ranker:
    """One per worker process and learned profiles (as JSON), so later tasks find it ready."""
    return Ranker(json.loads(profiles), profile)


def predict(docs: DataFrame, profiles: dict[str, dict[str, int]], text_col: str = "text", profile: int = PROFILE) -> DataFrame:
    """All columns of `docs` but the text, with lang_pred and score."""
    kept = others(docs, [text_col, "lang_pred", "score"])
    name = json.dumps(profiles, sort_keys=True)
    heads = [f"c{i}" for i in range(len(kept))]
    schema = T.StructType([T.StructField(h, docs.schema[c].dataType) for h, c in zip(heads, kept, strict=True)] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = ranker_of(name, profile)
        for batch in batches:
            for part in groups(batch):
                found = [ranker.judge(t) for t in part.column(len(kept)).to_pylist()]
                own = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema.names)

    out = docs.select(*[col(c).alias(h) for c, h in zip(kept, heads, strict=True)], col(text_col).alias("text")).mapInArrow(run, schema)
    return out.select(*[F.col(h).alias(c) for c, h in zip(kept, heads, strict=True)], "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of documents that learning never sees."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 4 == 2, F.lit(False))
