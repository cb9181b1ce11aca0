import random

import numpy as np
import xxhash

from ticktide.llm.components import components
from ticktide.llm.simhash import _links, _keys, Golay, fingerprint, near_dedup, near_duplicate_groups
import pyarrow as pa


def brute(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for t in ["", "one", "One TWO", "a b c", "A b  c\td e f g a b c", "é É x y z " * 50]:
        assert fingerprint(t.encode()) == brute(t)


def test_golay_code_is_perfect_and_keys_hold_neighbours():
    code, rng = Golay(), np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 4000)
    for bits in (21, 23):
        v = x & ((1 << bits) - 1)
        near = code.near(v, bits)
        y = v ^ (1 << rng.integers(0, bits, len(v)))
        assert ((near == code.index(y)[:, None]).any(axis=1)).all()
        assert ((near == code.index(v)[:, None]).any(axis=1)).all()
    words = np.unique(x ^ code.error[code.high[x >> 11] ^ (x & 2047)])
    gaps = np.bitwise_count(words[:300, None] ^ words[None, :300])
    assert gaps[gaps > 0].min() >= 7


def linked(fps, distance=3):
    """Pairs that the keys and the bucket search find, as components."""
    batch = pa.RecordBatch.from_arrays([pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["fp"])
    rows = pa.Table.from_batches(list(_keys(iter([batch])))).sort_by([("key", "ascending"), ("role", "ascending")])
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for out in _links(distance)(iter(rows.combine_chunks().to_batches(max_chunksize=777))):
        for a, b in zip(*(out.column(i).to_numpy().view(np.uint64).tolist() for i in range(2)), strict=True):
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_every_link_up_to_three_bits_is_found_and_no_other():
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:40]:
        for n in (1, 2, 3, 3, 3, 4, 5):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    fps = sorted(set(fps))
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[max(find(a), find(b))] = min(find(a), find(b))
    assert linked(fps) == {f: find(f) for f in fps}


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups(spark, odd_docs, no_docs):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(400)] = "edit"
        texts.append(" ".join(w))
    texts += [None, "", "a b c d", "A b c  d", "other text of this kind"]
    rows = [(50 - i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {i: brute(t) for i, t in rows}
    up = {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", find(i)) for i in ids}
    kept = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in ids})
    assert near_duplicate_groups(no_docs).count() == near_dedup(no_docs).count() == 0
    assert near_duplicate_groups(odd_docs).count() == odd_docs.count()
    assert near_dedup(odd_docs).columns == odd_docs.columns


def test_clashing_names_pass(spark):
    rows = [(1, "a b c d", 5, 6, 7), (2, "A b c  d", 5, 6, 7), (3, "x y z", 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, _text_hash int, text_hash int")
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
