import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ticktide.llm.packing import pack, plan_block
from ticktide.llm.tokens import ChunkTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("text", [
    "", " \n\t", "Don't you'll we've I'm he'd", "x. y, z; q: !? word.. word., a.b", "<|endoftext|>x <|STARTOFTEXT|> y<|startoftext|>", "ＡＢ é é ß ΑΣ İ ǅ", "a\x1cb\x85c d　e",
    "abc123 ४५ ²", "日本語 العربية", "UPPER.", "a" * 5000, "The the THE the.",
])
def test_chunk_ids_equal_the_library(text):
    tokens = ChunkTokenizer(PATH)
    for _ in range(2):  # fresh, then remembered
        assert np.frombuffer(tokens.packed_ids([text.encode()])[0], "<u4").tolist() == ids_of(text)[:-1]


def check(pieces, want):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for doc, ids in want.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096


def test_pieces_cover_every_id_once(spark):
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range((i * 37) % 900))) for i in range(150)] + [(900, None), (901, "long words here " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = pack(df, PATH, with_ids=True, block_tokens=30_000).collect()
    check(pieces, {i: ids_of(t) for i, t in rows})
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
    used = defaultdict(int)
    for p in pieces:
        used[p.sequence_id] += p.length
    assert all(n & (n - 1) == 0 for n in used.values())  # nothing is padded


def test_cost_is_balanced():
    pieces = plan_block([4000] * 10 + [96] * 10 + [100] * 40 + [500] * 8)
    used, load = defaultdict(int), defaultdict(float)
    for _, _, n, seq, _ in pieces:
        used[seq] += n
        load[seq] += n + n * n / 2048
    assert max(used.values()) <= 4096
    assert sum(used.values()) == 10 * 4000 + 960 + 4000 + 4000


def test_odd_rows(spark, odd_docs, no_docs):
    assert pack(no_docs, PATH).count() == 0
    pieces = pack(odd_docs.coalesce(1), PATH, with_ids=False).collect()
    assert sum(p.length for p in pieces) == sum(len(ids_of(r.text)) for r in odd_docs.collect())
