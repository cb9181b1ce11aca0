"""Cost-balanced packing of documents into token sequences.

The cost of a piece of n tokens is estimated as n + n * n / QUADRATIC (linear layers plus
attention inside the document). Inside a block of about BLOCK_TOKENS tokens:

1. documents longer than a sequence fill whole sequences of their own; the rest goes on;
2. the block's remaining tokens fix its sequences: as many full ones as fit, and for what is left
   one sequence for each power of two in it, so no sequence needs padding;
3. remainders, longest first, go to the lowest-cost sequence with room for them; one that fits
   nowhere is cut over the roomiest sequences.

A block is a run of rows of one input partition, so tokenising and packing take one pass with no
shuffle, memory is bounded by a block (plus a single document), and a lost task is simply redone
with the same result. Sequence ids are unique: input partition, block and place in the block.

Defined results: a null or empty text is the closing id alone; repeated rows are packed once
each; a very long text fills whole sequences of its own, its ids are held whole; an empty table gives no
pieces; only the id and text columns are read, whatever else a table has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ticktide.llm.common import col, groups, texts_of
from ticktide.llm.tokens import chunk_tokenizer

CAPACITY = 4096
CLOSING_ID = 2
BLOCK_TOKENS = 2_000_000
#: Piece length at which the attention part equals the linear part.
QUADRATIC = 2048

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: Any) -> Any:
    return n + n * n / QUADRATIC


def plan_block(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one block of documents."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequences, rests = 0, []
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((doc, k * capacity, capacity, sequences + k, 0))
        sequences += whole
        if n % capacity:
            rests.append((n % capacity, doc, whole * capacity))
    total = sum(r[0] for r in rests)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if (total % capacity) >> b & 1]
    room, spent, size = np.array(sizes, dtype=np.int64), np.zeros(len(sizes)), np.array(sizes, dtype=np.int64)

    def put(doc: int, start: int, n: int, at: int) -> None:
        pieces.append((doc, start, n, sequences + at, int(size[at] - room[at])))
        room[at] -= n
        spent[at] += cost(n)

    for n, doc, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        fits = np.where(room >= n, spent, np.inf)
        at = int(fits.argmin())
        if fits[at] < np.inf:
            put(doc, start, n, at)
            continue
        while n:
            at = int(room.argmax())
            part = min(n, int(room[at]))
            put(doc, start, part, at)
            start, n = start + part, n - part
    return pieces


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece; `with_ids` adds the piece's token ids as an array."""
    closing = closing_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, block = chunk_tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        names: list[Any] = []
        bodies: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            rows = plan_block([len(b) // 4 for b in bodies], capacity)
            cols = list(zip(*rows, strict=True))
            doc, start, length, seq, offset = (np.array(c, dtype=np.int64) for c in cols)
            cuts = [bodies[d][4 * s : 4 * (s + n)] for d, s, n in zip(cols[0], cols[1], cols[2], strict=True)]
            out = [
                pa.array([names[d] for d in cols[0]], pa.int64()), pa.array(start), pa.array(length),
                pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array([len(bodies[d]) // 4 for d in cols[0]], pa.int64()),
                pa.array(seq + ((part << 40) | (block << 20))), pa.array(offset),
            ]
            heads = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(cuts), dtype="<i4"))))
                heads.append("ids")
            return pa.RecordBatch.from_arrays(out, heads)

        for batch in batches:
            for group in groups(batch):
                for name, ids in zip(group.column(0).to_pylist(), tokens.packed_ids(texts_of(group.column(1))), strict=True):
                    names.append(name)
                    bodies.append(ids + closing)
                    held += len(ids) // 4 + 1
                    if held >= block_tokens:
                        yield flush()
                        block, held, names, bodies = block + 1, 0, [], []
        if bodies:
            yield flush()

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
