"""Terms, postings and pairs of texts in Arrow batches, by numpy.

The JVM cuts a text into items (analysis.items): words and the signs that end a sentence. What
depends on the word alone (parts, stop words, stems) is done once for each distinct word of a task;
the rest works on arrays of ids. A task holds the tokens of one run, so its memory does not grow
with its input.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import analysis
from .porter2 import cached_stem

#: Tokens of a sorted run of postings; raw pairs that are summed before they are sent; terms that a task keeps at most.
RUN_TOKENS, RUN_PAIRS, KEPT_TERMS = 1 << 21, 1 << 23, 1 << 18
#: Characters of the terms that a task keeps at most. Bits of a term's id in the key of a pair.
KEPT_CHARS, ID_BITS = 1 << 24, 26
MOST_WINDOW = 1 << 63 - 2 * ID_BITS
#: Rows of a batch that goes back to the JVM.
OUT_ROWS = 1 << 15
_END, _NOTHING = (-1,), (-2,)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass
class Tokens:
    """Parallel arrays in the order of the texts: term id, row of the batch, position in the row, sentence (ids differ between rows)."""

    term: np.ndarray
    row: np.ndarray
    position: np.ndarray
    sentence: np.ndarray


class Lexicon:
    """Ids of a task's terms in order of arrival, and the terms that each word becomes."""

    def __init__(self, analyzer_name: str) -> None:
        self.plain = analyzer_name == "simple"
        self.language = "" if self.plain else analysis.language_of(analyzer_name)
        self.stops = frozenset() if self.plain else analysis.stop_words(self.language)
        self.clear()

    def clear(self) -> None:
        self.terms: list[str] = []
        self.chars = 0
        self._ids: dict[str, int] = {}
        self._words: dict[str, tuple[int, ...]] = {}

    def _id(self, term: str) -> int:
        n = self._ids.setdefault(term, len(self.terms))
        if n == len(self.terms):
            self.terms.append(term)
            self.chars += len(term)
        return n

    def full(self) -> bool:
        return len(self.terms) > KEPT_TERMS or self.chars > KEPT_CHARS

    def _becomes(self, word: str) -> tuple[int, ...]:
        """Term ids of a word, none for a stop word; _END and _NOTHING for items that are no words."""
        if word in analysis.ENDS:
            return _END
        if self.plain:
            return (self._id(word),)
        if not analysis.has_letter(word):
            return _NOTHING
        parts = [p for p in analysis.parts_of(word) if len(p.encode()) >= 2 and p not in self.stops]
        return tuple(self._id(cached_stem(p) if self.language == "english" else p) for p in parts)

    def tokens(self, column: pa.ListArray) -> Tokens:
        """The terms of rows of items."""
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = column.flatten().dictionary_encode()
        at, known, found = coded.indices.to_numpy(), self._words, []
        for w in coded.dictionary.to_pylist():
            x = known.get(w)
            if x is None:
                x = known[w] = self._becomes(w)
            found.append(x)
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int64, int(count.sum()))
        start = np.cumsum(count) - count
        kind = np.zeros(len(found), np.int64)
        kind[count > 0] = np.minimum(flat[start[count > 0]], 0)
        count[kind < 0] = 0
        row, kind = np.repeat(np.arange(len(sizes)), sizes), kind[at]
        word, sentence = kind == 0, np.cumsum(kind == _END[0]) + row
        placed = np.cumsum(word)
        before = np.concatenate([[0], placed])[np.cumsum(sizes) - sizes]
        position = placed - np.repeat(before, sizes)
        n = count[at]
        if len(n) and n.min() == n.max() == 1:
            return Tokens(flat[start[at]], row, position, sentence)
        own = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        return Tokens(flat[start[at[own]] + inside], row[own], position[own], sentence[own])

    def sorted(self) -> tuple[pa.Array, np.ndarray]:
        """The terms in byte order, and the rank of each id."""
        terms = pa.array(self.terms, pa.string())
        order = pc.sort_indices(terms).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return terms.take(pa.array(order)), rank


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _whole(batch: pa.RecordBatch, name: str) -> pa.Array:
    x = batch.column(name)
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


class _Run:
    """Tokens of several batches, sorted at once by shard, term and row."""

    def __init__(self) -> None:
        self.tokens: list[list[np.ndarray]] = []
        self.meta: list[pa.RecordBatch] = []
        self.rows = self.size = 0

    def add(self, batch: pa.RecordBatch, t: Tokens) -> None:
        self.tokens.append([x.astype(np.int32) for x in (t.term, t.row + self.rows, t.position)])
        self.meta.append(batch.select([c for c in batch.schema.names if c != "items"]))
        self.rows, self.size = self.rows + batch.num_rows, self.size + len(t.term)

    def grouped(self, rank: np.ndarray) -> tuple[pa.Table, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the texts; shards; then for each posting its shard, rank of term, row and first token; positions of the tokens."""
        meta = pa.Table.from_batches(self.meta)
        shard = meta.column("shard_id").combine_chunks().dictionary_encode()
        shard = shard.combine_chunks() if isinstance(shard, pa.ChunkedArray) else shard
        code = pc.fill_null(shard.indices, len(shard.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        term, row, position = (np.concatenate(x) for x in zip(*self.tokens, strict=True))
        self.tokens = []
        bits = max(1, int(len(term)).bit_length())
        key = (code[row] * len(rank) + rank[term]) << bits | np.arange(len(term))
        key.sort()
        at = (key & ((1 << bits) - 1)).astype(np.int32)
        group = np.right_shift(key, bits, out=key)
        row = row[at]
        first = _starts(group, row)
        group = group[first]
        return meta, shard.dictionary, group // max(1, len(rank)), group % max(1, len(rank)), row[first], first, position[at]


def _runs(batches: Iterator[pa.RecordBatch], words: Lexicon) -> Iterator[_Run]:
    run = _Run()
    for b in batches:
        for part in _slices(b):
            run.add(part, words.tokens(_whole(part, "items")))
            if run.size >= RUN_TOKENS or words.full():
                yield run
                run = _Run()
                if words.full():
                    words.clear()
    if run.size:
        yield run


def _slices(b: pa.RecordBatch, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` items, a row at least."""
    sizes = pc.fill_null(pc.list_value_length(_whole(b, "items")), 0).to_numpy(zero_copy_only=False)
    part, begin = np.cumsum(sizes) // most, 0
    for end in [*_starts(part)[1:], b.num_rows]:
        if end > begin:
            yield b.slice(begin, end - begin)
        begin = end


def _out(n: int, columns: dict[str, pa.Array | tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches of n rows; (values, places) are looked up a batch at a time."""
    for i in range(0, n, OUT_ROWS):
        cut = [x[0].take(pa.array(x[1][i : i + OUT_ROWS])) if isinstance(x, tuple) else x.slice(i, OUT_ROWS) for x in columns.values()]
        yield pa.RecordBatch.from_arrays(cut, list(columns))


def postings(analyzer_name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(shard_id, doc_id, items) to (shard_id, doc_id, term, tf, doc_len, positions), in runs sorted by shard and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(analyzer_name)
        for r in _runs(batches, words):
            terms, rank = words.sorted()
            meta, _, _, term, row, first, position = r.grouped(rank)
            tf = np.diff(first, append=len(position))
            length = np.bincount(row, minlength=r.rows)[row]
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(position)).astype(np.int32)), pa.array(position.astype(np.int32)))
            yield from _out(len(row), {
                "shard_id": (meta.column("shard_id").combine_chunks(), row), "doc_id": (meta.column("doc_id").combine_chunks(), row), "term": (terms, term),
                "tf": pa.array(tf.astype(np.int32)), "doc_len": pa.array(length.astype(np.int32)), "positions": lists,
            })

    return run


def frequencies(analyzer_name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(shard_id, items) to (shard_id, term, df), partial sums of rows that have the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(analyzer_name)
        for r in _runs(batches, words):
            terms, rank = words.sorted()
            _, shards, shard, term, _, _, _ = r.grouped(rank)
            at = _starts(shard, term)
            shards = pa.concat_arrays([shards, pa.nulls(1, shards.type)])
            yield from _out(len(at), {"shard_id": (shards, shard[at]), "term": (terms, term[at]), "df": pa.array(np.diff(at, append=len(term)))})

    return run


def window_counts(analyzer_name: str, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(shard_id, doc_id, items) to (shard_id, doc_id, n): pairs of different terms at most `window` places apart in a sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(analyzer_name)
        for b in batches:
            for part in _slices(b):
                t, n = words.tokens(_whole(part, "items")), np.zeros(part.num_rows, np.int64)
                for g in range(1, window + 1):
                    near = (t.sentence[g:] == t.sentence[:-g]) & (t.term[g:] != t.term[:-g])
                    n += np.bincount(t.row[g:][near], minlength=len(n))
                some = np.flatnonzero(n)
                yield from _out(len(some), {"shard_id": (_whole(part, "shard_id"), some), "doc_id": (_whole(part, "doc_id"), some), "n": pa.array(n[some])})
                if words.full():
                    words.clear()

    return run


# --- pairs ---------------------------------------------------------------------------------------


def _pair_runs(keys: np.ndarray, bits: int, weight: np.ndarray) -> list[np.ndarray]:
    """Two terms and code (the gap of a pair met once, else 0) of each pair in keys, which are sorted in place a part at a time; count and weight of pairs of code 0."""
    keys.sort()
    out, begin = [], 0
    while begin < len(keys):
        end = min(begin + (1 << 20), len(keys))
        end = int(np.searchsorted(keys, ((keys[end - 1] >> bits) + 1) << bits))  # a pair is not cut
        part = keys[begin:end]
        first = _starts(part)
        times, part = np.diff(first, append=len(part)), part[first]
        gap, pair = part & ((1 << bits) - 1), part >> bits
        first = _starts(pair)
        cnt, wsum, pair = np.add.reduceat(times, first), np.add.reduceat(times * weight[gap], first), pair[first]
        code = np.where((cnt == 1) & (gap[first] < 255), gap[first] + 1, 0).astype(np.uint8)
        many = code == 0
        out.append(((pair >> ID_BITS).astype(np.int32), (pair & ((1 << ID_BITS) - 1)).astype(np.int32), code, cnt[many], wsum[many]))
        begin = end
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _ship(bucket: np.ndarray, lo: np.ndarray, hi: np.ndarray, code: np.ndarray, cnt: np.ndarray, wsum: np.ndarray, terms: list[str], shard: str | None) -> Iterator[tuple[int, bytes]]:
    """(bucket, bytes) of pair sums, lo < hi places in the sorted terms; steps of lo, and a byte of gap for a pair met once, pack well."""
    order, sums_at = np.argsort(bucket, kind="stable").astype(np.int32), np.cumsum(code == 0, dtype=np.int32) - 1
    ends = np.cumsum(np.bincount(bucket))
    for n in np.flatnonzero(np.diff(ends, prepend=0)):
        at = order[ends[n - 1] if n else 0 : ends[n]]
        at = at[np.argsort(lo[at].astype(np.int64) << 32 | hi[at])]
        own, back = np.unique(np.concatenate([lo[at], hi[at]]), return_inverse=True)
        back, one = back.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32), code[at]
        many = sums_at[at[one == 0]]
        sums = (shard, "\0".join([terms[i] for i in own]), np.diff(back[: len(at)], prepend=back.dtype.type(0)).tobytes(), back[len(at) :].tobytes(), back.dtype.str, one.tobytes(), cnt[many].tobytes(), wsum[many].tobytes())
        raw = pickle.dumps(sums)
        yield int(n), len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _payloads(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["bucket", "payload"])


def pair_parts(analyzer_name: str, window: int, weights: list[float], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(shard_id, items) to (bucket, payload): sums of RUN_PAIRS pairs at a time; a pair always has the same bucket."""
    bits = max(1, (window - 1).bit_length())
    weight = np.array(weights)

    def sent(keys: np.ndarray, terms: list[str], shard: str | None) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        a, b, code, cnt, wsum = _pair_runs(keys, bits, weight)
        order = pc.sort_indices(pa.array(terms, pa.string())).to_numpy()
        terms, rank = [terms[i] for i in order], np.empty(len(terms), np.int32)
        rank[order] = np.arange(len(order))
        a, b = rank[a], rank[b]
        swap = np.flatnonzero(a > b)
        a[swap], b[swap] = b[swap], a[swap]
        h = np.fromiter((zlib.crc32(t.encode()) for t in terms), np.uint64, len(terms))
        bucket = (h * _M1)[a]
        bucket ^= (h * _M2)[b]
        bucket *= _M3
        bucket >>= np.uint64(33)
        bucket %= np.uint64(buckets)
        bucket, held = bucket.astype(np.uint16), []
        for x in _ship(bucket, a, b, code, cnt, wsum, terms, shard):
            held.append(x)
            if len(held) == 64:
                yield _payloads(held)
                held = []
        if held:
            yield _payloads(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys, size, parts = Lexicon(analyzer_name), np.empty(RUN_PAIRS, np.int64), 0, []  # one buffer; parts are (shard, begin, end) in it

        def flushed() -> Iterator[pa.RecordBatch]:
            for s in dict.fromkeys(x[0] for x in parts):
                own = [keys[a:b] for name, a, b in parts if name == s]
                yield from sent(own[0] if len(own) == 1 else np.concatenate(own), words.terms, s)
            parts.clear()
            words.clear()

        for b in batches:
            shard = _whole(b, "shard_id").dictionary_encode()
            for k in [*range(len(shard.dictionary)), None] if shard.null_count else range(len(shard.dictionary)):
                own = b if len(shard.dictionary) == 1 and not shard.null_count else b.filter(pc.is_null(shard) if k is None else pc.fill_null(pc.equal(shard.indices, k), False))
                name = None if k is None else shard.dictionary[k].as_py()
                for part in _slices(own, 1 << 18):
                    t = words.tokens(_whole(part, "items"))
                    if size and (size + len(t.term) * window > len(keys) or words.full()):
                        yield from flushed()
                        size, t = 0, words.tokens(_whole(part, "items"))
                    if len(t.term) * window > len(keys):  # a very long text
                        keys = np.empty(len(t.term) * window, np.int64)
                    begin = size
                    for g in range(1, window + 1):
                        x, y = t.term[g:], t.term[:-g]
                        near = np.flatnonzero((t.sentence[g:] == t.sentence[:-g]) & (x != y))
                        x, y = x[near], y[near]
                        keys[size : size + len(near)] = (np.minimum(x, y) << ID_BITS | np.maximum(x, y)) << bits | (g - 1)
                        size += len(near)
                    if parts and parts[-1][0] == name:
                        begin = parts.pop()[1]
                    parts.append((name, begin, size))
        yield from flushed()

    return run


def pair_sums(weights: list[float], least: int) -> Callable[[pa.Table], pa.Table]:
    """The payloads of one bucket to (shard_id, term_a, term_b, cnt, wsum), pairs met `least` times or more."""
    one = np.array([0.0, *weights])

    def run(table: pa.Table) -> pa.Table:
        shards, words, parts, base = {}, [], [], 0
        for x in table.column("payload"):
            raw = x.as_buffer()
            s, joined, lo, hi, kind, code, cnt, wsum = pickle.loads(pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8].to_pybytes(), "little"), codec="zstd"))
            words.append(pc.split_pattern(pa.array([joined]), "\0").flatten())
            code = np.frombuffer(code, np.uint8)
            c, w = np.ones(len(code), np.int64), one[np.minimum(code, len(one) - 1)]
            c[code == 0], w[code == 0] = np.frombuffer(cnt, np.int64), np.frombuffer(wsum, np.float64)
            parts.append((np.full(len(code), shards.setdefault(s, len(shards)), np.int32), np.cumsum(np.frombuffer(lo, kind), dtype=np.int32) + np.int32(base), np.frombuffer(hi, kind).astype(np.int32) + np.int32(base), c, w))
            base += len(words[-1])
        coded = pa.concat_arrays(words).dictionary_encode()
        shard, lo, hi, cnt, wsum = (np.concatenate(x) for x in zip(*parts, strict=True))
        del words, parts
        at = coded.indices.to_numpy().astype(np.int64)
        key = at[lo] << 32 | at[hi]
        del lo, hi
        order = np.argsort(key) if len(shards) == 1 else np.lexsort((key, shard))
        key, shard = key[order], shard[order]
        first = _starts(key, shard)
        cnt, wsum, key, shard = np.add.reduceat(cnt[order], first), np.add.reduceat(wsum[order], first), key[first], shard[first]
        if least > 1:
            kept = cnt >= least
            cnt, wsum, key, shard = cnt[kept], wsum[kept], key[kept], shard[kept]
        names = pa.array(list(shards), pa.string())
        columns = [names.take(pa.array(shard)), coded.dictionary.take(pa.array(key >> 32)), coded.dictionary.take(pa.array(key & 0xFFFFFFFF)), pa.array(cnt), pa.array(wsum)]
        return pa.Table.from_arrays(columns, ["shard_id", "term_a", "term_b", "cnt", "wsum"])

    return run
