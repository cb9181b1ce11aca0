import __spark_entry__ as entry
import corpus_pipeline
from ticktide.llm import entries


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "suffix dedup", "packing"]
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= n
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.count() > 0 and "sequence_id" in pieces.columns


def test_odd_tables_pass_every_stage(spark, odd_docs, no_docs):
    for table in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, "").count()


def test_all_ten_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(entries.ORACLE_SQL) <= set(entries.QUERIES)
