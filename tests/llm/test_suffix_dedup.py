import hashlib
import random

import pytest

from ticktide.llm import suffix_dedup as S


def runs_of(texts, length=100):
    seen, out = set(), []
    for t in texts:
        spans = []
        for a in range(len(t) - length + 1):
            s = t[a : a + length]
            if s in seen:
                spans.append({"start": a, "stop": a + length})
            seen.add(s)
        out.append(S.merged(spans))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in S.span_digests(df).collect()}
    rows = sorted(rows)
    texts = [(t or "").encode() for _, t in rows]
    for (i, _), t, runs in zip(rows, texts, runs_of(texts), strict=True):
        assert got[i] == (len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(S.remaining(t, runs)).hexdigest()), i


@pytest.mark.parametrize("segment,hot", [(1 << 20, 50_000), (700, 50_000), (1 << 20, 6), (700, 1)])
def test_brute_force(spark, monkeypatch, segment, hot):
    monkeypatch.setattr(S, "SEGMENT", segment)
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(segment)
    letters = "abcdefghij klmno éü日"
    shared = ["".join(rng.choice(letters) for _ in range(rng.choice([80, 99, 100, 101, 130, 260, 700]))) for _ in range(20)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind, p = rng.random(), rng.choice(shared)
            if kind < 0.5:
                parts.append(p[rng.choice([0, 0, 7, 30]) : len(p) - rng.choice([0, 0, 5, 40])])
            elif kind < 0.6:
                parts.append("a" * rng.randint(50, 400))
            elif kind < 0.7:
                parts.append("xyz"[: rng.randint(2, 3)] * rng.randint(20, 100))
            else:
                parts.append("".join(rng.choice(letters) for _ in range(rng.randint(1, 300))))
        rows.append((i * 3, None if i % 41 == 0 else "".join(parts)))
    rows += [(1000 + i, rows[5][1]) for i in range(20)]
    check(spark, rows)


@pytest.mark.parametrize("hot,at_once", [(50_000, 100_000), (4, 37)])
def test_runs_of_short_periods(spark, monkeypatch, hot, at_once):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "AT_ONCE", at_once)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows, units = [], [word(n) for n in (1, 2, 3, 31, 32, 33, 67, 68, 69, 70, 71, 99, 100, 101)]
    for i, unit in enumerate(units):
        for k, n in enumerate((90, 450, 900)):
            rows.append((10 * i + k, word(rng.randint(0, 150)) + unit[rng.randrange(len(unit)) :] + unit * (n // len(unit)) + word(rng.randint(0, 150))))
    check(spark, rows)


def test_a_very_long_run_has_few_anchors():
    text = b"start" + b"a" * (3 << 20) + b"end"
    kept, covered = 0, []
    for which, at, h in S.anchors_of([text], 100):
        keep, spans = S.runs_of(which, at, h, [text], 100)
        kept += keep.sum()
        covered += [s[1:] for s in spans]
    assert covered == [(6, len(text) - 3)] and 0 < kept < 400


def test_clashing_names_pass(spark):
    rng = random.Random(9)
    p = "".join(rng.choice("abcdefghijkl mn") for _ in range(130))
    docs = spark.createDataFrame([(1, p, 4, 5, 6), (2, p + " tail", 4, 5, 6)], "doc_id long, text string, `a.b` int, uid int, spans int")
    got = S.suffix_dedup(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [(1, p, 4, 5, 6), (2, " tail", 4, 5, 6)]


def test_multikey_quicksort_orders_rows():
    import numpy as np

    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, (3000, 5)).astype(np.uint64)
    got = words[S.multikey_quicksort(words)].tolist()
    assert got == sorted(words.tolist())


def test_ties_and_empty_tables(spark, odd_docs, no_docs):
    rng = random.Random(8)
    p, q = ("".join(rng.choice("abcdefghijkl mn") for _ in range(130)) for _ in range(2))
    df = spark.createDataFrame([(None, p), (None, p), (1, p), (1, q), (1, p), (2, None), (3, q + p)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in S.span_digests(df).collect()), key=str)
    assert got == sorted([(None, 130, 0), (None, 130, 0), (1, 130, 130), (1, 130, 0), (1, 130, 130), (2, 0, 0), (3, 260, 260)], key=str)
    assert S.span_digests(no_docs).count() == S.suffix_dedup(no_docs).count() == 0
    assert S.span_digests(odd_docs).count() == odd_docs.count()


def test_filter_cuts_at_whole_characters(spark):
    p = "é日𝒳" * 40
    df = spark.createDataFrame([(1, "x" + p, "k", 1), (2, p + "tail", "k", 1), (3, "clean", "k", 5), (4, "x" + p, "k", 9)], "doc_id long, text string, stop string, n_chars long")
    got = {r.doc_id: r for r in S.suffix_dedup(df).collect()}
    assert set(got) == {1, 2, 3} and got[2].text == "tail" and got[2].n_chars == 4 and got[3] == (3, "clean", "k", 5)
