"""Further columns with awkward or clashing names pass through every operator and stage."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ticktide.llm import exact_dedup, html_extract, langid, packing, quality, sentencepiece_codec, sharding, simhash, suffix_dedup, url_filter

EXTRA = ["a.b", "_bucket", "_text_hash", "digest", "salt", "body", "Shard", "words", "node", "uid", "spans", "own", "rank", "x`y", "_own", "n_words", "h", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    prose = " ".join(f"word{i % 83} then{i}" for i in range(60))
    rows = [(i, f"{prose} number{i % 3} {'and more of it ' * (i % 2)}", "en", "s", 9) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(EXTRA)])


def test_stages_keep_the_columns(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        row = out.first()
        assert row is not None and row[docs.columns.index("a.b")] == 0 and row[docs.columns.index("_text_hash")] == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_operators_take_such_tables(spark, docs):
    assert exact_dedup.exact_groups(docs).count() == 12
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() >= 12
    placed = sharding.shard_documents(docs, 5)
    assert "a.b" in placed.columns and "Shard" not in placed.columns and placed.select("`a.b`", "shard").count() == 12
    assert quality.measured(docs).select("`a.b`", "n_words").first()[0] == 0
    assert suffix_dedup.span_digests(docs).count() == simhash.near_duplicate_groups(docs).count() == 12
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path).count() == 12
    assert langid.predict(docs, langid.learn(docs)).select("`a.b`").count() == 12
    pages = docs.select("*", F.lit("http://a.com/x").alias("url"), F.lit("<p>x</p>").alias("html"), F.lit(1).alias("Host"))
    rules = spark.createDataFrame([("com", "/", False)], "host string, path string, allow boolean")
    assert url_filter.judge(pages, rules).select("`a.b`", "host", "verdict").distinct().collect() == [(0, "a.com", "block")]
    assert html_extract.extract(pages).select("`a.b`", "_bucket").count() == 12
