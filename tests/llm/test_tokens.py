import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import bpe, packing, wavelet
from tests.llm.fixtures import documents, empty, rows

pytest.importorskip("public_tokenizers")
LIBRARY = {n: Tokenizer.from_file(bpe.path_of(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
ALPHABET = [" ", "  ", "\n", " \n", "\t", "a", "The", "É", "ß", "1", "23", "'s", "'LL", ".", "!!", "%", "́", "中", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\xa0", "\x85", "\x1c", "²", "İ", "Σ", "…", "x" * 90]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join))
def test_cached_ids_equal_the_library(name, text):
    ids = bpe.loaded(bpe.path_of(name)).encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == LIBRARY[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*ALPHABET, "été", "Þ×", "aaaaaaa", "wordsofsixteenb", "theorthing,", "ïï.", "a÷b"]), max_size=9).map(" ".join), max_size=6))
def test_texts_encoded_together_equal_the_library(name, texts):
    got = [x.tolist() for x in bpe.loaded(bpe.path_of(name)).encode_all([None, *texts])]
    assert got == [[], *(LIBRARY[name].encode(t, add_special_tokens=False).ids for t in texts)]


def test_many_new_words_are_merged_like_the_library(monkeypatch):
    name, r = "byte_bpe_50k.json", np.random.default_rng(3)
    monkeypatch.setattr(bpe, "MAX_PIECES", 900)
    monkeypatch.setattr(bpe, "GROUP", 4000)
    texts = [" ".join("".join(r.choice(list("aeinrst" if i % 2 else "aabbé"), r.integers(1, 12))) + r.choice(["", ".", ","]) for _ in range(100)) for i in range(40)]
    fresh = bpe.Bpe(bpe.path_of(name))
    calls = []
    monkeypatch.setattr(fresh, "encode_piece", lambda *x, f=fresh.encode_piece: calls.append(x) or f(*x))
    assert [x.tolist() for x in fresh.encode_all(texts)] == [LIBRARY[name].encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) < 500  # nearly all of the 4,000 words go without a call each


def test_special_strings_are_their_tokens():
    ids = lambda name, text: np.frombuffer(bpe.loaded(bpe.path_of(name)).encode(text), "<u4").tolist()
    assert ids("byte_bpe_50k.json", "a <|endoftext|> b") == [64, 220, 50256, 275] and ids("word_bpe_49k.json", "a <|endoftext|> b") == [320, 49407, 321]
    assert ids("word_bpe_49k.json", "<|startoftext|><|endoftext|>") == [49406, 49407]


def expected(name, end):
    return [(r[0], [*(LIBRARY[name].encode(r[1], add_special_tokens=False).ids if r[1] else []), end]) for r in rows()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_round_trip(spark):
    name = "byte_bpe_50k.json"
    want = sorted(expected(name, 0), key=lambda x: (x[0] is not None, x[0] or 0))
    at, rest = 0, []
    for i, ids in want:
        rest.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    got = wavelet.token_shards(spark, documents(spark), bpe.path_of(name)).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == rest


def test_empty_tables(spark):
    assert wavelet.token_shards(spark, empty(spark), bpe.path_of("byte_bpe_50k.json")).count() == 0
    assert packing.pack(empty(spark), bpe.path_of("word_bpe_49k.json")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=300))
def test_wavelet_queries(values):
    a = np.array(values, np.uint16)
    w = wavelet.WaveletMatrix(wavelet.packed(a, [(1, len(a))], 6))
    assert (w.all() == a).all()
    for i in range(0, len(a), 7):
        assert w.access(i) == a[i]
    for t in set(values[:5]):
        places = np.flatnonzero(a == t)
        assert w.count(t) == len(places) and w.count(t, 3, len(a)) == int((a[3:] == t).sum())
        assert [w.occurrence(t, r) for r in range(len(places))] == places.tolist()


def test_wavelet_blocks(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    a = np.random.default_rng(1).integers(0, 9, 1000).astype(np.uint16)
    w = wavelet.WaveletMatrix(wavelet.packed(a, [(None, 1000)], 4))
    assert (w.all() == a).all() and w.docs == [(None, 1000)]
    assert [w.occurrence(3, r) for r in range(w.count(3))] == np.flatnonzero(a == 3).tolist()


def test_packing(spark):
    want = {}
    for i, ids in expected("word_bpe_49k.json", 1):
        for p, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            want.setdefault((i, p), []).append((at, len(ids[at : at + packing.CAPACITY]), crc(ids[at : at + packing.CAPACITY])))
    got = packing.pack(documents(spark), bpe.path_of("word_bpe_49k.json")).collect()
    seen = {}
    for r in got:
        seen.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=30))
def test_plan_places_everything(histogram):
    segments, bins = packing.plan(histogram, 64, 8)
    used, ranks = {}, {}
    for length, rank, count, each, first, offset in segments.tolist():
        for i in range(count):
            used.setdefault(first + i // each, []).append((offset + i % each * length, length))
            ranks.setdefault(length, []).append(rank + i)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) == bins


def test_plan_is_near_the_bound():
    r = np.random.default_rng(2)
    lengths = np.minimum(4096, r.gamma(1.2, 1300, 60_000).astype(int) + 1)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    _, bins = packing.plan(histogram)
    assert bins <= 1.003 * lengths.sum() / 4096 + 2
