"""Cost-balanced packing of token ids into sequences of fixed capacity.

Each task reads its documents once, encodes them and packs a window of tokens at a time: whole
sequences are cut off long documents; the remainders, in descending order of estimated cost
(linear plus quadratic attention cost), go to the open sequence of lowest cost, cut where it is
full. As many sequences are opened as the window can fill, so all of them end full; what is left,
less than one sequence, moves to the next window, and at the end of the task is cut into pieces of
powers of two, which need no padding. No shuffle, no state beyond the window.

Cases: null text counts as empty (one token, the end id); repeated rows are packed each; a very
long text is cut; an empty table gives no rows; extra columns are not read; a null doc_id stays null.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import byte_bpe, ship, tokenizer_path

CAPACITY = 1024
WINDOW_TOKENS = 1 << 21
LINEAR_COST = 1.0
QUADRATIC_COST = 1.0 / 1024
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SCHEMA_IDS = SCHEMA + ", ids array<int>"

#: A piece to place: (doc_id, ids of the whole document, start, end).
Piece = tuple[int | None, np.ndarray, int, int]


def attention_cost(n: int) -> float:
    """Estimated cost of a piece of n tokens that attends within itself."""
    return LINEAR_COST * n + QUADRATIC_COST * n * n


def balance(pieces: list[Piece], capacity: int = CAPACITY) -> tuple[list[list[Piece]], list[Piece]]:
    """(full sequences, pieces left over): the left over tokens are fewer than capacity."""
    full: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, ids, a, b in pieces:
        while b - a >= capacity:
            full.append([(doc, ids, a, a + capacity)])
            a += capacity
        if b > a:
            rest.append((doc, ids, a, b))
    rest.sort(key=lambda p: p[2] - p[3])  # cost rises with length
    n = sum(b - a for _, _, a, b in rest) // capacity
    open_: list[tuple[float, int]] = [(0.0, i) for i in range(n)]
    room, filled, left = [capacity] * n, [[] for _ in range(n)], []
    for doc, ids, a, b in rest:
        while a < b and open_:
            cost, i = heapq.heappop(open_)
            take = min(b - a, room[i])
            filled[i].append((doc, ids, a, a + take))
            room[i] -= take
            if room[i]:
                heapq.heappush(open_, (cost + attention_cost(take), i))
            a += take
        if a < b:
            left.append((doc, ids, a, b))
    return full + filled, left


def power_cuts(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences whose lengths are the powers of two that sum up to the pieces' tokens."""
    total, out, queue = sum(b - a for _, _, a, b in pieces), [], list(pieces)[::-1]
    for bit in reversed(range(total.bit_length())):
        need, seq = total & (1 << bit), []
        while need:
            doc, ids, a, b = queue.pop()
            take = min(need, b - a)
            seq.append((doc, ids, a, a + take))
            need -= take
            if a + take < b:
                queue.append((doc, ids, a + take, b))
        if seq:
            out.append(seq)
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, window_tokens: int = WINDOW_TOKENS, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row per piece; see the module's text. with_ids adds the piece's ids."""
    ship(docs.sparkSession)
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        pieces: list[Piece] = []
        tokens = 0

        def rows(sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            cols: list[list] = [[] for _ in range(8)]
            for seq in sequences:
                at = 0
                for doc, ids, a, b in seq:
                    part = ids[a:b]
                    for col, x in zip(cols, (doc, a, b - a, zlib.crc32(part.astype("<u4").tobytes()), len(ids), number, at, part if with_ids else None), strict=True):
                        col.append(x)
                    at += b - a
                number += 1
                if len(cols[0]) >= 8192:
                    yield batch(cols)
                    cols = [[] for _ in range(8)]
            if cols[0]:
                yield batch(cols)

        def batch(cols: list[list]) -> pa.RecordBatch:
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            ids_col, texts = b.column(0), b.column(1)
            for i in range(b.num_rows):
                ids = np.append(encoder.encode(texts[i].as_py() or ""), np.uint32(end_id))
                pieces.append((ids_col[i].as_py(), ids, 0, len(ids)))
                tokens += len(ids)
                if tokens >= window_tokens:
                    done, pieces = balance(pieces, capacity)
                    tokens = sum(e - a for _, _, a, e in pieces)
                    yield from rows(done)
        done, pieces = balance(pieces, capacity)
        yield from rows(done + power_cuts(pieces))

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA_IDS if with_ids else SCHEMA)
