import zlib

from ticktide.llm.sharding import shard_documents, write_shards


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_match_the_published_walk(spark):
    ids = [0, 1, 2, 7, -1, -(2**63), 2**63 - 1, *range(100, 400, 7)]
    df = spark.createDataFrame([(i, f"text é {i}") for i in ids], "doc_id long, text string")
    for r in shard_documents(df, 24, buckets=4).collect():
        assert r.shard == jump(r.doc_id, 24) and r.grown_shard == jump(r.doc_id, 25)
        assert r.size == len(r.text.encode()) + 8 and r.text_crc32 == zlib.crc32(r.text.encode()) and r.law == "key"


def test_slots_are_gapless_and_growth_moves_only_into_the_new_shard(spark):
    df = spark.range(5000).selectExpr("id * 64 AS doc_id", "CAST(id AS STRING) AS text", "'k' AS shard")
    rows = shard_documents(df, 24).collect()
    for s in range(24):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and 130 < len(slots) < 290
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    assert 120 < sum(r.grown_shard == 24 for r in rows) < 290


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    assert shard_documents(no_docs, 24).count() == 0
    rows = shard_documents(odd_docs, 5).collect()
    assert len(rows) == odd_docs.count()
    assert {r.shard for r in rows if r.doc_id is None} == {jump(0, 5)}
    assert [r.size for r in rows if r.doc_id == 3] == [8]
    write_shards(odd_docs, str(tmp_path / "s"), 5)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd_docs.count()
