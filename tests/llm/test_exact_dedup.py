import hashlib
import re

from ticktide.llm.exact_dedup import exact_dedup, exact_groups


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_groups_match_brute_force(spark, odd_docs):
    rows = [(r.doc_id, norm(r.text)) for r in odd_docs.collect()]
    got = exact_groups(odd_docs, salts=3).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [i for i, t in rows if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same)
        assert r.keep_id == min((i for i in same if i is not None), default=None)
    for digest in {r.text_sha256 for r in got}:
        assert sum(r.kept for r in got if r.text_sha256 == digest) == 1


def test_filter_keeps_one_row_of_each_text_unchanged(spark, odd_docs):
    kept = exact_dedup(odd_docs, salts=3)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert len(rows) == len({norm(r.text) for r in odd_docs.collect()}) == len({norm(r.text) for r in rows})
    assert set(rows) <= set(odd_docs.collect())
    assert {r.doc_id for r in rows if norm(r.text).startswith("the quick")} == {1}


def test_empty_table_and_clashing_columns(spark, no_docs):
    assert exact_groups(no_docs).count() == exact_dedup(no_docs).count() == 0
    df = spark.createDataFrame([(1, "a", "b", 2), (2, "a", "c", 3)], "doc_id long, text string, digest string, salt long")
    assert [tuple(r) for r in exact_dedup(df).collect()] == [(1, "a", "b", 2)]
    assert exact_groups(df).count() == 2


def test_hot_text_over_many_partitions(spark):
    df = spark.range(3000).selectExpr("3000 - id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot  text' ELSE CAST(id AS STRING) END AS text").repartition(16)
    out = exact_groups(df, salts=4)
    hot = out.filter("group_size > 1")
    assert hot.count() == 1000 and hot.select("keep_id").distinct().collect() == [(3,)]
    assert exact_dedup(df, salts=4).count() == 2001
