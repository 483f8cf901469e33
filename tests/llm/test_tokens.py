"""Packing, token counts and pieces against the tokenizer libraries themselves."""

import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termweave.llm import packing, pieces, token_counts
from termweave.llm.common import byte_bpe, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "no id"), (4, "two\nlines\n"), (5, "é 漢字🙂 <|endoftext|> x"), (6, "word " * 5000), (7, "x" * 30_000), (8, " " * 25_000), (9, "\n\n")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 5, "z") for i, t in ODD], "doc_id long, text string, length int, start string")


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_fast_encoder_equals_tokenizers(spark):
    t, fast = tokenizer(), byte_bpe(tokenizer_path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [x or "" for _, x in ODD]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert fast.encode(x).tolist() == ids
        assert int(fast.n_bytes[ids].sum()) == len(x.encode())


def check_packing(rows, texts):
    """rows with ids against (doc_id, text) pairs, which may repeat; returns the share of padding."""
    t, pieces_of, sequences = tokenizer(), defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
        pieces_of[r.doc_id].append((r.start, r.ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, x in texts:
        want[i].append([*t.encode(x or "", add_special_tokens=False).ids, 0])
    assert pieces_of.keys() == want.keys()
    for i, found in pieces_of.items():
        if len(want[i]) == 1:
            found.sort()
            assert [x for _, ids, _ in found for x in ids] == want[i][0]
            assert [s for s, _, _ in found] == np.cumsum([0, *(len(ids) for _, ids, _ in found)])[:-1].tolist()
            assert {n for _, _, n in found} == {len(want[i][0])}
        else:
            assert sum(len(ids) for _, ids, _ in found) == sum(map(len, want[i]))
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / total


def test_packing_of_odd_texts(odd):
    assert check_packing(packing.pack_documents(odd, with_ids=True).collect(), ODD) == 0


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small_windows = packing.pack_documents(docs, window_tokens=5000, with_ids=True).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_packing(small_windows, texts) == 0
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_balanced_sequences_have_near_costs():
    r = np.random.default_rng(0)
    parts = [(i, np.zeros(n, np.uint32), 0, int(n)) for i, n in enumerate(r.integers(1, 700, 400))]
    full, left = packing.balance(parts)
    assert all(sum(b - a for _, _, a, b in s) == 1024 for s in full) and sum(b - a for *_, a, b in left) < 1024
    cost = np.array([sum(packing.attention_cost(b - a) for _, _, a, b in s) for s in full])
    naive = np.array([packing.attention_cost(b - a) for *_, a, b in parts]).sum() / len(full)
    assert cost.std() < 0.1 * naive


def test_section_tokens_equal_offsets(odd, spark):
    t = tokenizer()
    for rule in ("start", "majority"):
        got = defaultdict(list)
        for r in token_counts.section_tokens(odd, rule=rule).collect():
            got[r.doc_id].append(r)
        for i, x in ODD:
            if i == 3:
                assert len(got[i]) == 2 * 1
                continue
            rows, x = sorted(got[i], key=lambda r: r.section), x or ""
            lines = x.splitlines(keepends=True) if "\r" not in x else None
            assert [x[r.start_char : r.end_char] for r in rows] == (lines or [""])
            n = len(t.encode(x, add_special_tokens=False).ids)
            assert sum(r.n_tokens for r in rows) == n == rows[0].doc_tokens
            assert sum(r.token_share for r in rows) == pytest.approx(n)
    assert token_counts.section_tokens(odd.limit(0)).collect() == []
    with pytest.raises(ValueError, match="unknown rule"):
        token_counts.section_tokens(odd, rule="end")


@given(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.data())
@settings(max_examples=150, deadline=None)
def test_allocation_equals_byte_loop(lengths, data):
    total = sum(lengths)
    inner = data.draw(st.lists(st.integers(1, max(1, total - 1)), max_size=5, unique=True)) if total > 1 else []
    bounds = np.array(sorted({0, total, *inner}))
    section = [int(np.searchsorted(bounds, b, side="right")) - 1 for b in range(total)]
    for rule in ("start", "majority"):
        whole, share, at = [0] * (len(bounds) - 1), np.zeros(len(bounds) - 1), 0
        for n in lengths:
            own = section[at : at + n]
            for s in own:
                share[s] += 1 / n
            whole[own[0] if rule == "start" else max(sorted(set(own)), key=own.count)] += 1
            at += n
        a, b = token_counts.allocate(np.array(lengths), bounds, rule)
        assert a.tolist() == whole and np.allclose(b, share)


def test_bpe_pieces_equal_runtime_and_round_trip(odd):
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = pieces.encode(odd)
    got = sorted(((r.doc_id or 0, r.ids, r.n_pieces, r.round_trip) for r in rows.collect()), key=lambda r: (r[0], r[1]))
    assert got == sorted(((i or 0, ids := p.encode(x or ""), len(ids), p.decode(ids) == (x or "")) for i, x in ODD), key=lambda r: (r[0], r[1]))
    assert all(r[3] for r in got)
    back = {r.doc_id: r.text for r in pieces.decode(rows).collect()}
    assert all(back[i] == (x or "") for i, x in ODD)


def test_lattice_equals_all_segmentations(spark):
    table = {"a": -1.0, "b": -1.5, "c": -2.0, "ab": -1.8, "bc": -3.2, "abc": -3.9, "ca": -2.4, "cab": -3.1, "é": -2.2}
    words = ["".join(w) for n in (1, 2, 4) for w in product("abcx", repeat=n)] + ["abcabcabcab", "xé", "aé漢b"]
    unknown = min(table.values()) - pieces.UNKNOWN_PENALTY

    def best(w):
        if not w:
            return 0.0
        return max(best(w[:-k]) + (table[w[-k:]] if w[-k:] in table else unknown) for k in range(1, min(3, len(w)) + 1) if k == 1 or w[-k:] in table)

    ids = {t: i + 1 for i, t in enumerate(table)}
    pieces_df = spark.createDataFrame([(t, ids[t], s) for t, s in table.items()], "piece string, id int, score double")
    rows = pieces.lattice_encode(spark.createDataFrame([(w,) for w in [*words, "", words[0]]], "word string"), pieces_df, 3).collect()
    assert sorted(r.word for r in rows) == sorted(set(words))
    back = {i: t for t, i in ids.items()}
    for r in rows:
        assert r.score == pytest.approx(best(r.word))
        at = 0
        for i in r.ids:  # the ids spell the word
            n = len(back[i]) if i else 1
            assert i == 0 or r.word[at : at + n] == back[i]
            at += n
        assert at == len(r.word)


def test_words_of_tile_the_text(spark):
    from pyspark.sql import functions as F

    texts = ["a b", "  a  b ", "", None, "x\ny", " "]
    got = [r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select(pieces.words_of(F.col("t")).alias("w")).collect()]
    assert ["".join(w) for w in got] == [pieces.SPACE + t.replace(" ", pieces.SPACE) if t else "" for t in texts]


def test_hashes_of_no_bytes(monkeypatch):
    """A worker whose first texts are all empty."""
    from termweave.llm import common

    monkeypatch.setattr(common, "_powers", {})
    none = np.zeros(0, np.int64)
    assert len(common.span_hashes(np.zeros(0, np.uint8), none, none)) == 0
