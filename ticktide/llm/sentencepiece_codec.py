"""SentencePiece encoding and decoding by a streaming Viterbi search over a piece file.

Encoding finds the segmentation with the greatest sum of piece scores (ties: the longer last
piece). The search moves through the text with a window of the longest piece: only ends inside it
can still be extended. Whenever the backpointer paths of all these ends run through one common
boundary, the pieces before it are final and are given out, so memory doesn't grow with the text.
No piece holds a space mark after another character, so every path crosses the boundary before
a run of spaces (and those at a line end, or before a mark that ends a word, where no piece joins the
two): there the search starts anew, and what it found for a short stretch is remembered. In a
stretch the pieces are matched in one pass, by an Aho-Corasick automaton.

A character without a piece becomes the byte pieces of its UTF-8 bytes, at ten less than the
lowest score. Decoding joins the pieces, turns space marks into spaces, byte pieces into bytes and
takes the one leading space away that encoding put there. A round trip gives the text back, but
that the space mark U+2581 itself comes back as a space.

The piece file's scores come from merge ranks; the merge-order segmentation of its own library can
differ from the best-scoring one, which is what is defined here.

Held at a time: the texts of some hundred rows and their ids, the window of a search, and what is
remembered of short stretches; a very long text is parted into its stretches whole.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are
encoded each; an empty table gives an empty table; only the id and text columns are read, whatever else
a table has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from ticktide.llm.common import col, groups

MARK = "▁"
#: What an unknown character costs below the lowest score.
UNKNOWN = 10.0
NONE = float("-inf")
#: Stretches that one generation remembers, and the longest of them.
REMEMBERED = 300_000
LONGEST = 48
#: After letters, one of these at the end of a stretch is searched by itself, where no piece joins the two.
MARKS = ".,;:!?"
_STRETCH = re.compile(f"{MARK}+[^{MARK}]*")


class Codec:
    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = [0] * 256
        self.pieces: dict[str, tuple[float, int]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece] = (model.get_score(i), i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        self.window = max(map(len, self.pieces))
        #: Length of the longest piece by first character.
        self.reach: dict[str, int] = {}
        for piece in self.pieces:
            self.reach[piece[0]] = max(self.reach.get(piece[0], 1), len(piece))
        self.unknown = min(s for s, _ in self.pieces.values()) - UNKNOWN
        self.forced = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        pairs = {(a, b) for p in self.pieces for a, b in zip(p, p[1:], strict=False)}
        self.tails = {m for m in MARKS if not any(b == m and a.isalpha() for a, b in pairs)}
        self.lines = not any("\n" in p for p in self.pieces)
        self.single = {p for p in self.pieces if len(p) == 1}
        self.matches = ahocorasick.Automaton()
        for piece, (score, i) in self.pieces.items():
            self.matches.add_word(piece, (len(piece), score, i))
        self.matches.make_automaton()
        self.mark_ids = {m: np.array(list(self._short(m)), dtype="<i4").tobytes() for m in self.tails}
        self.table = pa.array(self.bytes_of, pa.binary())
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def search(self, text: str) -> Iterator[int]:
        """Ids of the best segmentation of `text`, given out as soon as they are certain."""
        window, pieces, unknown = self.window, self.pieces, self.unknown
        scores: dict[int, float] = {0: 0.0}
        back: dict[int, tuple[int, int]] = {}  # end: (start, piece id, or -1 for an unknown character)
        base, checked = 0, 0
        for start in range(len(text)):
            score = scores.pop(start)
            for end in range(start + 1, min(len(text), start + window) + 1):
                hit = pieces.get(text[start:end])
                if hit is None:
                    if end > start + 1:
                        continue
                    hit = (unknown, -1)
                total = score + hit[0]
                if end not in scores or total > scores[end]:
                    scores[end], back[end] = total, (start, hit[1])
            if start - checked >= 4 * window and start + 1 < len(text):
                checked = start
                common = self._meet(back, list(scores), base)
                if common > base:
                    yield from self._path(text, back, base, common)
                    back = {e: b for e, b in back.items() if e > common}
                    base = common
        if text:
            yield from self._path(text, back, base, len(text))

    def _short(self, text: str) -> Iterator[int]:
        """The same for a stretch that is no longer than a few windows: matches by where they end, longest first."""
        if not self.single.issuperset(text):
            return self.search(text)
        scores, back = [NONE] * (len(text) + 1), [(0, -1)] * (len(text) + 1)
        scores[0] = 0.0
        for last, (size, score, piece) in self.matches.iter(text):
            start = last + 1 - size
            total = scores[start] + score
            if total > scores[last + 1]:
                scores[last + 1], back[last + 1] = total, (start, piece)
        return self._path(text, back, 0, len(text))

    @staticmethod
    def _meet(back: dict[int, tuple[int, int]], ends: list[int], base: int) -> int:
        """The last boundary on the paths of all `ends`."""
        at = set(ends)
        while len(at) > 1:
            last = max(at)
            at.remove(last)
            at.add(back[last][0] if last > base else base)
        return at.pop()

    def _path(self, text: str, back: Any, base: int, end: int) -> Iterator[int]:
        steps = []
        while end > base:
            start, piece = back[end]
            steps.append((start, end, piece))
            end = start
        for start, stop, piece in reversed(steps):
            if piece >= 0:
                yield piece
            else:
                yield from (self.byte_ids[b] for b in text[start:stop].encode("utf-8", "surrogatepass"))

    def _stretches(self, text: str) -> list[str]:
        """Parts of `text` between boundaries that every path crosses.

        A part stands for itself behind a space mark, but one that begins with a space mark or a line
        end is meant as it is.
        """
        if not self.lines or MARK in text:
            return _STRETCH.findall(MARK + text.replace(" ", MARK))
        parts = text.replace("\n", " \n").split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for p in parts:
            if not p:
                spaces += 1
                continue
            if p[0] == "\n":
                if spaces:
                    out.append(MARK * spaces)
                out.append(p)
            else:
                out.append(MARK * (spaces + 1) + p if spaces else p)
            spaces = 0
        return [*out, MARK * spaces] if spaces else out

    def _learn(self, part: str) -> bytes:
        """Ids of a part, packed as little-endian 32-bit numbers."""
        head, body = [], part if part[0] == MARK else MARK + part
        if part[0] == "\n":
            head, body = [self.byte_ids[10]], part[1:]
        found = self._short(body) if len(body) <= LONGEST else self.search(body)
        return np.array([*head, *found], dtype="<i4").tobytes()

    def packed_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        if not self.forced:
            return [np.fromiter(self.search(MARK + t.replace(" ", MARK)) if t else (), dtype="<i4").tobytes() for t in texts]
        parts = [self._stretches(t) if t else [] for t in texts]
        known = self.young
        lost = set().union(*parts).difference(known)
        known.update((p, self.old[p]) for p in lost.intersection(self.old))
        new = lost.difference(known)
        for p in new:
            word, mark = p[:-1], p[-1]
            if mark in self.tails and word.isalpha():
                if word not in known:
                    known[word] = self._learn(word)
                known[p] = known[word] + self.mark_ids[mark]
            elif p not in known:
                known[p] = self._learn(p)
        ids = [b"".join(map(known.__getitem__, own)) for own in parts]
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        if len(known) > REMEMBERED:
            self.old, self.young = known, {}
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed_ids([text])[0], dtype="<i4").tolist()

    def decode_all(self, lists: pa.ListArray) -> list[str]:
        flat = self.table.take(lists.flatten())
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False))])[ends.astype(np.int64)].astype(np.int64).tolist()
        data = b"".join(flat.to_pylist()) if flat.offset else bytes(flat.buffers()[2] or b"")
        return [data[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(sizes, sizes[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0]


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One per worker process, so later tasks know what earlier ones found."""
    return Codec(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        for batch in batches:
            for part in groups(batch):
                ids = codec.packed_ids([t or "" for t in part.column(1).to_pylist()])
                ends = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Rows (doc_id, ids, text) for rows (doc_id, ids); null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        for batch in batches:
            for part in groups(batch):
                texts = codec.decode_all(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
