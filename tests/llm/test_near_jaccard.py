import random
from collections import Counter

import corpus_pipeline
from ticktide.llm.near_jaccard import near_jaccard_dedup, near_jaccard_groups


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return sorted({find(i) for i in sets})


def some_texts():
    """Near copies on both sides of 0.8, each with a prose of its own, and one large group of near copies."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for k in range(60):
        base = words(rng.choice([60, 250, 700]))
        other = list(base)
        for _ in range(int(len(base) * (k % 6) / 200)):
            other[rng.randrange(len(base))] = "edit"
        texts += [base, other]
    base = words(300)
    for _ in range(80):
        other = list(base)
        other[rng.randrange(300)] = other[rng.randrange(300)] = "edit"
        texts.append(other)
    return [*map(" ".join, texts), None, "", " ", "a b c d", "A b  c d", "a b c d e f", "a b c d e g"]


def test_stage_links_what_brute_force_links(spark):
    rows = [(1000 - i, t) for i, t in enumerate(some_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_by_brute_force(rows)
    assert 60 < len(want) < 120
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == want


def test_odd_tables(spark, odd_docs, no_docs):
    assert near_jaccard_groups(no_docs).count() == near_jaccard_dedup(no_docs).count() == 0
    assert near_jaccard_groups(odd_docs).count() == odd_docs.count()
    assert near_jaccard_dedup(odd_docs).columns == odd_docs.columns


def test_recall_on_given_documents(spark):
    """All of sf0.01: every pair of 0.8 that a count of shared rare shingles finds lies in one group."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    often = Counter(x for s in sets.values() for x in s)
    by, pairs = {}, set()
    for i, s in sets.items():
        ranked = sorted(s, key=lambda x: (often[x], x))
        for x in ranked[: len(s) - -(-4 * len(s) // 5) + 1]:  # a pair of 0.8 shares one of these rarest
            for j in by.setdefault(x, []):
                if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                    pairs.add((j, i))
            by[x].append(i)
    docs = spark.createDataFrame(rows)
    group = {r["doc_id"]: r["component_id"] for r in near_jaccard_groups(docs).collect()}
    found = sum(group[i] == group[j] for i, j in pairs)
    assert len(pairs) > 3 and found >= 0.98 * len(pairs)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in pairs:
        up[max(find(i), find(j))] = min(find(i), find(j))
    empty = min(i for i, s in sets.items() if not s) if any(not s for s in sets.values()) else None
    assert all(group[i] == find(i) for i, s in sets.items() if s) and all(group[i] == empty for i, s in sets.items() if not s)
