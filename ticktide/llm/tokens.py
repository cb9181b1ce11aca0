"""Token ids of whole texts by a public tokenizer file, one white-space chunk at a time.

No rule of the word-level tokenizer looks across ASCII white space (its normaliser composes and
lower-cases inside a chunk, its splitting pattern and its merges stay inside a word), so the ids
of a text are the ids of its chunks in order. Chunks repeat, so their ids are remembered, packed
as little-endian 32-bit numbers, in two generations of bounded size. Chunks that are new go to
the tokenizer in one call: a word's last id carries the end-of-word mark, so counting the words of
each chunk tells where its ids end.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

#: Chunks that one generation remembers.
REMEMBERED = 300_000
#: Longer chunks are not remembered.
LONGEST = 64
#: New chunks that one call of the tokenizer gets.
TOGETHER = 20_000
#: After ASCII letters, one of these at the end of a chunk is a word of its own.
MARKS = b".,;:!?"
#: The tokenizer's own splitting pattern, a fixed value of its file.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END_OF_WORD = "</w>"


class ChunkTokenizer:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(END_OF_WORD)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, dtype="<u4")

    def _learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        words = [1 if t.isalpha() and t.isascii() else len(WORD.findall(unicodedata.normalize("NFC", t).lower())) for t in texts]
        ids = self._encode(" ".join(texts))
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) == sum(words) and not any("<|" in t for t in texts):
            stops = np.concatenate([[0], at])[np.cumsum([0, *words])] * 4
            packed, cuts = ids.tobytes(), stops.tolist()
            found = {c: packed[a:b] for c, a, b in zip(chunks, cuts, cuts[1:], strict=False)}
        else:
            found = {c: self._encode(t).tobytes() for c, t in zip(chunks, texts, strict=True)}
        return found

    def packed_ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8), four bytes each."""
        chunks = [(t if b"<|" in t else t.lower()).split() for t in texts]  # "<|" may begin a special token
        lost = set().union(*chunks).difference(self.young)
        known = self.young
        known.update((c, self.old[c]) for c in lost.intersection(self.old))
        new = lost.difference(known)
        tails = {c: (c[:-1], c[-1:]) for c in new if c[-1] in MARKS and c[:-1].isalpha()}
        new = list(new.difference(tails).union(*tails.values()).difference(known))
        for k in range(0, len(new), TOGETHER):
            known.update(self._learn(new[k : k + TOGETHER]))
        known.update((c, known[word] + known[mark]) for c, (word, mark) in tails.items())
        ids = [b"".join(map(known.__getitem__, c)) for c in chunks]
        for c in [*new, *tails]:
            if len(c) > LONGEST:
                del known[c]
        if len(known) > REMEMBERED:
            self.old, self.young = known, {}
        return ids


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process, so later tasks know what earlier ones learnt."""
    return ChunkTokenizer(path)
