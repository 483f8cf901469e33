"""Token counts of sections from one encoding of the whole document.

A document is encoded once; the encoder's token byte lengths give every token its span, and a merge
of two sorted lists joins token spans with section spans. A token that crosses a boundary is
allocated by an explicit rule: "start" (the section of its first byte) or "majority" (the section
with most of its bytes, the earlier one on ties). token_share also gives the fractional count, by
bytes, so that shares always sum to the document's tokens.

Sections are the document's lines, each with its line break; they tile the text. Offsets are in
characters. Cases: null and empty texts give one empty section 0 with no tokens; repeated rows give
their rows each; a null doc_id stays null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_bpe, ship, tokenizer_path

SCHEMA = "doc_id long, section int, start_char long, end_char long, n_tokens long, token_share double, doc_tokens long"


def line_bounds(raw: np.ndarray) -> np.ndarray:
    """Byte bounds of the lines of a text: 0, after each line break, the end."""
    breaks = np.flatnonzero(raw == 0x0A) + 1
    return np.unique(np.concatenate([[0], breaks, [len(raw)]])) if len(raw) else np.zeros(2, np.int64)


def allocate(lengths: np.ndarray, bounds: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """(whole tokens, fractional tokens) of each section; both lists tile the same bytes."""
    m = len(bounds) - 1
    ends = np.cumsum(lengths)
    first = np.searchsorted(bounds[1:], ends - lengths, side="right")
    last = np.searchsorted(bounds[1:], ends - 1, side="right")
    owner = first.copy()
    share = np.bincount(first[first == last], minlength=m).astype(float)
    for t in np.flatnonzero(first != last).tolist():
        over = np.arange(first[t], last[t] + 1)
        part = np.minimum(bounds[over + 1], ends[t]) - np.maximum(bounds[over], ends[t] - lengths[t])
        share[over] += part / lengths[t]
        if rule == "majority":
            owner[t] = over[int(part.argmax())]
    return np.bincount(owner, minlength=m), share


def section_tokens(docs: DataFrame, tokenizer: str | None = None, rule: str = "start") -> DataFrame:
    """One row per document and line; see the module's text."""
    if rule not in ("start", "majority"):
        raise ValueError(f"unknown rule {rule!r}")
    ship(docs.sparkSession)
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        for b in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            ids, size = [], 0
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py() or ""
                tokens = encoder.encode(text)
                raw = np.frombuffer(text.encode(), np.uint8)
                bounds = line_bounds(raw)
                whole, share = allocate(encoder.n_bytes[tokens], bounds, rule)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
                m = len(bounds) - 1
                ids += [b.column(0)[i].as_py()] * m
                for out, x in zip(parts, (np.arange(m, dtype=np.int32), chars[:-1], chars[1:], whole, share, np.full(m, len(tokens))), strict=True):
                    out.append(x)
                size += m
                if size >= 16384 or i == b.num_rows - 1:
                    arrays = [pa.array(ids, pa.int64()), *(pa.array(np.concatenate(x), k) for x, k in zip(parts, kinds[1:], strict=True))]
                    yield pa.RecordBatch.from_arrays(arrays, names)
                    parts, ids, size = [[] for _ in range(6)], [], 0

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)
