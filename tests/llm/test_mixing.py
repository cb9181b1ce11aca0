import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from ticktide.llm import mixing


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fill(sizes, weights=(5, 2, 1), budget=Fraction(3, 2), most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, whole, capped = {s: weights[i % len(weights)] for i, s in enumerate(order)}, budget * sum(sizes.values()), set()
    while len(capped) < len(order):
        room, rest = whole - sum(most * sizes[s] for s in capped), sum(w[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and w[s] * room / rest > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in capped else float(w[s] * room / rest) for s in order}
        capped |= more
    return {s: most * sizes[s] for s in order}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(i * 37 % 190)), f"s{i % 7}" if i % 3 else "s0") for i in range(240)]
    rows += [(1000 + i, "alone here", None) for i in range(3)] + [(2000, "x " * 5000, "long"), (2001, None, "none"), (None, "no id", "s1"), (None, None, None)]
    rows += [(5, "twice in all " * 9, "s2")] * 40 + [(9, "", "s0"), (11, " \t", "s3")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).cache()


@pytest.mark.parametrize("block", [16, 1024])
def test_targets_are_met_to_the_word(docs, block):
    rows = mixing.taken(mixing.placed(docs, shards=5, block_words=block).withColumn("id", F.col("id"))).collect()
    assert len(rows) == docs.count()
    sizes, own = Counter(), defaultdict(list)
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
        own[r["doc_id"]].append(r["source"])
    want, got = fill(sizes), Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if len(own[r["doc_id"]]) == 1:
            assert r["source_size"] == sizes[own[r["doc_id"]][0]] and r["target"] == pytest.approx(want[own[r["doc_id"]][0]], rel=1e-12)
        got[r["target"], r["source_size"]] += r["taken"]
    assert all(abs(n - target) <= 0.5 for (target, _), n in got.items())
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))


def test_reruns_and_layouts_agree(docs):
    first = sorted(map(tuple, mixing.taken(mixing.placed(docs, block_words=32)).collect()), key=str)
    again = sorted(map(tuple, mixing.taken(mixing.placed(docs.repartition(3), block_words=32)).collect()), key=str)
    assert first == again


def test_shards_are_even_and_no_word_comes_twice_in_an_epoch(docs):
    rows = mixing.placed(docs, shards=6, block_words=16).select("id", "mark", "size", F.explode("pieces").alias("p")).select("id", "mark", "size", "p.*").collect()
    seen, load = set(), Counter()
    for r in rows:
        assert 0 <= r["start"] and r["start"] + r["length"] <= r["size"]
        load[r["shard"]] += r["length"]
        if r["id"] != 5:  # equal rows share a mark
            for k in range(r["start"], r["start"] + r["length"]):
                assert (r["mark"], r["epoch"], k) not in seen
                seen.add((r["mark"], r["epoch"], k))
    assert set(load) == set(range(6)) and max(load.values()) - min(load.values()) < 0.05 * sum(load.values())


def test_texts_of_the_mix(spark, docs, tmp_path):
    small = docs.filter("doc_id < 40 or doc_id is null or doc_id >= 1000")
    mixing.write_mix(small, str(tmp_path / "mix"), shards=3, block_words=64)
    rows = spark.read.parquet(str(tmp_path / "mix")).collect()
    texts = defaultdict(list)
    for r in small.collect():
        texts[r["doc_id"], r["source"]].append(r["text"])
    for r in rows:
        assert any(words(r["text"]) == words(t)[r["start"] : r["start"] + r["length"]] for t in texts[r["doc_id"], r["source"]])
    planned = mixing.taken(mixing.placed(small, shards=3, block_words=64)).agg(F.sum("taken")).first()[0]
    assert sum(len(words(r["text"])) for r in rows) == planned


def test_many_copies_fold_into_portions(spark):
    docs = spark.range(2500).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    docs = docs.union(spark.createDataFrame([(2, "q " * 50, "t")], docs.schema))
    folded = mixing.items(docs)
    assert sorted(r["copies"] for r in mixing.chunks(folded).collect()) == [1, 500, 1000, 1000]
    out = mixing.taken(mixing.placed(docs)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("taken").alias("t")).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, 2500, 11225), (2, 1, 100)]
    assert mixing.mix(docs, shards=2).agg(F.sum("length")).first()[0] == 11325


@pytest.mark.parametrize(("total", "good", "drawn"), [(5, 2, 2), (12, 7, 5), (40, 3, 30), (200, 90, 60)])
def test_draws_follow_the_law(spark, total, good, drawn):
    n = 20_000
    t, g, d = (F.lit(x).cast("long") for x in (total, good, drawn))
    got = {r["x"]: r["count"] for r in spark.range(n).select(mixing.hypergeometric(t, g, d, F.col("id")).alias("x")).groupBy("x").count().collect()}
    chi = cells = 0
    for x in range(max(0, drawn + good - total), min(good, drawn) + 1):
        want = n * comb(good, x) * comb(total - good, drawn - x) / comb(total, drawn)
        if want >= 5:
            chi, cells = chi + (got.get(x, 0) - want) ** 2 / want, cells + 1
    assert sum(got.values()) == n and chi < cells + 5 * (2 * cells) ** 0.5


def test_tree_keeps_both_margins(spark):
    units = [1000, 3, 0, 250, 77, 1]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(units)], "rank long, units long")
    for shards in (1, 2, 5):
        depth = (shards - 1).bit_length()
        rows = {r["rank"]: r["tree"][(1 << depth) - 1 :] for r in mixing.dealt(df, shards).collect()}
        assert [sum(rows[i]) for i in range(6)] == units
        total = sum(units)
        assert [sum(rows[i][s] for i in range(6)) for s in range(shards)] == [total * (s + 1) // shards - total * s // shards for s in range(shards)]


def test_empty_and_wordless(spark, no_docs, odd_docs):
    assert mixing.taken(mixing.placed(no_docs)).count() == 0 and mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.taken(mixing.placed(blank)).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    odd = odd_docs.select("*", F.lit(1).alias("size"), F.lit(2).alias("Taken"), F.lit(3).alias("a.b"), F.lit(4).alias("mark"), F.lit(5).alias("key"))
    assert mixing.taken(mixing.placed(odd)).count() == odd_docs.count()
