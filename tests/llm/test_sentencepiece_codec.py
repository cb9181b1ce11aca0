import random

import public_tokenizers
import pytest
import sentencepiece

from ticktide.llm import sentencepiece_codec as SP

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return SP.Codec(PATH)


def brute(codec, text):
    """Plain Viterbi over the whole text."""
    best = [(0.0, 0, -1)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - codec.window), end):
            hit = codec.pieces.get(text[start:end]) or ((codec.unknown, -1) if end == start + 1 else None)
            if hit and (best[end] is None or best[start][0] + hit[0] > best[end][0]):
                best[end] = (best[start][0] + hit[0], start, hit[1])
    out, end = [], len(text)
    while end:
        _, start, piece = best[end]
        out[:0] = [piece] if piece >= 0 else [codec.byte_ids[b] for b in text[start:end].encode()]
        end = start
    return out


def texts():
    rng = random.Random(8)
    yield from ["", " ", "a", "Hello  world\n\tfoo", "𝒳 日本語 été", "x" * 3000, "\x00\x7f", "trailing   "]
    for n in (30, 400, 3000):
        yield "".join(rng.choice("abcdefghij klmn ÀÉ.日𝒳") for _ in range(n))
        yield "".join(rng.choice("etaoin") for _ in range(n))


@pytest.mark.parametrize("text", list(texts()))
def test_streaming_search_equals_plain_viterbi_and_round_trips(codec, text):
    marked = SP.MARK + text.replace(" ", SP.MARK) if text else ""
    want = brute(codec, marked)
    score = lambda ids: sum(codec.pieces.get(p, (0,))[0] for p in ids)  # noqa: E731, F841
    assert codec.encode(text) == list(codec.search(marked)) == want
    assert codec.decode(want) == text


def test_search_gives_ids_out_before_the_end(codec):
    pulled = []

    class Text(str):
        pass

    stream = codec.search("the" * 2000)
    for _ in range(5):
        pulled.append(next(stream))
    assert pulled and stream.gi_frame.f_locals["start"] < 3000


def test_decoding_agrees_with_the_library(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in texts():
        ids = codec.encode(text)
        assert codec.decode(ids) == library.decode(ids)


def test_tables(spark, odd_docs, no_docs):
    back = SP.decode(SP.encode(odd_docs, PATH), PATH).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=key)
    assert SP.decode(SP.encode(no_docs, PATH), PATH).count() == 0
