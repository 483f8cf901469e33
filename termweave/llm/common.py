"""Helpers shared by the llm operators: shared-folder tables, byte-level words, tokenizers.

Texts are handled as UTF-8 bytes straight from Arrow buffers, half a megabyte at a time, so a
batch never needs more than a small multiple of its own bytes, whatever the number of rows in it.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import mark, materialize, new_path, release, shared_dir  # noqa: F401  used by the operators

#: Bytes of text that a kernel works on at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 19
#: An Arrow batch between the JVM and a Python worker ends with the row that reaches so many bytes.
BATCH_BYTES = 1 << 21

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even if only the driver's sys.path has it, with one thread of linear algebra each.

    Tasks are the parallelism; more threads in a worker only wait for one another.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    env["OPENBLAS_NUM_THREADS"] = "1"
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def bound_batches(spark: SparkSession) -> None:
    """Hold this session's Arrow batches to BATCH_BYTES, or to its own lower limit.

    By default a batch ends at 10,000 rows or 64 MB, which the JVM's buffers and the worker each hold a few
    times over. The limit counts when a plan runs, so it stays set: what the operators return runs later.
    """
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bitmap(rows: DataFrame, hashed: Column, least: int, most: int) -> np.ndarray:
    """A one-hash Bloom filter of a long column: bit (hash modulo size) is set; about 16 bits a row, within least and most (powers of two)."""
    slots = min(most, max(least, 1 << (16 * rows.count()).bit_length()))
    per = 32_768
    slot = rows.select(F.pmod(hashed, F.lit(slots)).alias("slot"))
    parts = slot.groupBy(F.floor(F.col("slot") / per).alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % per).alias("bits")).collect()  # slots / per rows at most
    bits = np.zeros(slots // 8, np.uint8)
    for r in parts:
        bits[r.part * per // 8 : (r.part + 1) * per // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits


def in_bitmap(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether the bits of these slots are set."""
    return (bits[slot >> 3] >> (slot & 7)) & 1 == 1


# --- bytes and words -----------------------------------------------------------------------------


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Everything but the white space of [\x20\x09-\x0D].
NON_SPACE = ~_table((0x20, 0x20), (0x09, 0x0D))
#: ASCII letters and all non-ASCII bytes.
LETTERS = _table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_CODE = _BYTE_CODE[LOWER]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets) of slices of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        upto = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
        upto = min(upto, n)
        yield row, upto, data[ends[row] : ends[upto]], (ends[row : upto + 1] - ends[row]).astype(np.int64)
        row = upto


def word_spans(buf: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, ptr): byte spans of maximal runs of member bytes; ptr: words before each row."""
    inside = members[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    if len(buf):
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """0 .. n-1 th powers, modulo 2**64; kept between calls."""
    if kind not in _powers or len(_powers[kind]) < n:  # a worker's first slice may have no bytes
        steps = np.full(max(n, SLICE_BYTES + 1), _MULT if kind == "up" else _INV, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64 bits (the splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, A-Z as a-z if lower; the same in every process."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_LOWER_CODE if lower else _BYTE_CODE)[buf] * _power("up", len(buf)), out=sums[1:])
    h = (sums[end] - sums[start]) * _power("down", len(buf) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_words(words: list[str]) -> np.ndarray:
    """span_hashes of single words; for fixtures and brute-force checks."""
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    return span_hashes(buf, ends - [len(x) for x in raw], ends)


# --- tokenizers ----------------------------------------------------------------------------------


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


SPECIAL = "<|endoftext|>"
#: A longer run without white space goes to the slower reference encoder, whose time stays linear.
LONG_RUN = 20_000


def _unicode_bytes() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE, back to bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of a byte-level BPE file, as tokenizers gives them with add_special_tokens=False.

    tiktoken does the merges (the file's ids are merge ranks), about five times as fast; texts that
    it cannot take (a very long run without spaces, or a failure of its pattern) go to tokenizers.
    """

    def __init__(self, path: str) -> None:
        import json

        import public_tokenizers
        import tiktoken

        self.path = path
        spec = json.loads(Path(path).read_text())
        back = _unicode_bytes()
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items()}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.added = set(added)
        self.slow = None
        size = max([*ranks.values(), *added.values()]) + 1
        self.n_bytes = np.zeros(size, np.int64)
        for t, i in ranks.items():
            self.n_bytes[i] = len(t)
        for t, i in added.items():
            self.n_bytes[i] = len(t.encode())

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if len(text) <= LONG_RUN or max(map(len, text.split())  if not text.isspace() else [len(text)], default=0) <= LONG_RUN and "  " * (LONG_RUN // 2) not in text:
            try:
                return np.asarray(self.fast.encode(text, allowed_special=self.added, disallowed_special=()), np.uint32)
            except BaseException as e:  # noqa: BLE001  the pattern engine panics on some very long runs
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def byte_bpe(path: str) -> ByteBpe:
    """One encoder per process and file."""
    kept = sys.modules[__name__].__dict__.setdefault("_encoders", {})
    if path not in kept:
        kept[path] = ByteBpe(path)
    return kept[path]
