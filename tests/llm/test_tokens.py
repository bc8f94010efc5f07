"""Encoding, plane files and packing against the tokenizers library, and trie counts against a plain split."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routecover.llm import bitplane, kk_packing
from routecover.llm.texts import crc_joined
from routecover.llm.tokens import WordEncoder, byte_chunks
from routecover.llm.trie_counts import PRE_TOKEN, Trie, count_tokens, rank_scores


@pytest.fixture(scope="module")
def encode(vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    return lambda text, end: np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_pieces_encode_as_whole_texts(vocabulary, encode):
    texts = ["", " ", "a", " a", "a ", "a  b", "\n\nfoo\n bar", "don't stop 's 12,34 !! ", "<|endoftext|> hi", "\x1cfoo a\x1c b", "foo \n", "a\u0085 b", "  x"]
    texts += ["one<|endoftext|>two", "<|endoftext|>", "a\u00a0 \u00a0b", "né×à÷é.", "x" * 300 + " y", "'", "it's 'stuff'll", "Ā1ſ. 字a字"]
    for kept in (1 << 20, 200):
        encoder = WordEncoder(vocabulary, max_bytes=kept, max_piece=8)
        for part in (texts, texts[::-1]):
            flat, at = encoder.encode(part, 9)
            for i, t in enumerate(part):
                assert flat[at[i] : at[i + 1]].tolist() == encode(t, 9).tolist(), repr(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'slé1., \x1c字", max_size=16), max_size=6))
def test_any_text_encodes_as_a_whole(texts):
    from tests.llm.conftest import VOCABULARY

    encoder = ENCODERS.setdefault(0, WordEncoder(VOCABULARY))
    flat, at = encoder.encode(texts, 0)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == [*encoder.library.encode(t, add_special_tokens=False).ids, 0]


def test_the_end_mark_is_one_id_as_the_library_has_it(vocabulary, encode):
    flat, _ = WordEncoder(vocabulary).encode(["see <|endoftext|> there"], 0)
    assert 50256 in flat.tolist() and flat.tolist() == encode("see <|endoftext|> there", 0).tolist()


ENCODERS: dict = {}


@pytest.mark.parametrize("plane", ["bit", "byte"])
@pytest.mark.parametrize("n", [1, 7, 64, 1000])
def test_planes_round_trip(plane, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    frames = bitplane.to_planes(ids, plane)
    assert len(frames) == (32 if plane == "bit" else 4)
    assert (bitplane.from_planes(frames, n, plane) == ids).all()


def test_joined_checksums():
    a, b = b"first part", b"and the second, longer part"
    assert crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert crc_joined(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


@pytest.mark.parametrize(("plane", "block"), [("bit", 100), ("byte", 4096)])
def test_plane_files(docs, rows, vocabulary, encode, plane, block):
    read = bitplane.read_documents(bitplane.write_tokens(docs, vocabulary, block=block, plane=plane, shards=3))
    got = sorted(map(tuple, read.collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode(text, 0)
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_plane_files_of_nothing(no_docs, vocabulary):
    assert bitplane.read_documents(bitplane.write_tokens(no_docs, vocabulary)).count() == 0


def test_packing_keeps_every_id_once(docs, rows, vocabulary, encode):
    got = kk_packing.pack(docs, vocabulary, capacity=256, group_windows=4).collect()
    left = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        left.setdefault(r[0], []).append(encode(r[1], 1).tobytes())
    pieces, sequences = {}, {}
    for p in got:
        pieces.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    for doc_id, texts in left.items():
        own = sorted(pieces[doc_id], key=lambda p: p.start)
        assert sum(p.length for p in own) == sum(len(t) // 4 for t in texts)
        if len(texts) == 1:
            assert b"".join(bytes(p.ids) for p in own) == texts[0] and all(p.doc_tokens == len(texts[0]) // 4 for p in own)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4 > 0
            at += p.length
        assert at <= 256
    assert kk_packing.pack(docs.limit(0), vocabulary).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2047), max_size=40), st.integers(1, 12))
def test_differencing_deals_every_item(sizes, n):
    windows = kk_packing.differencing(sizes, n)
    assert len(windows) == n and sorted(i for w in windows for i in w) == list(range(len(sizes)))


def test_differencing_is_near_equal():
    sizes = [(i * 7919) % 900 + 100 for i in range(400)]
    loads = [sum(sizes[i] for i in w) for w in kk_packing.differencing(sizes, 20)]
    assert max(loads) - min(loads) <= 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2047), min_size=1, max_size=40))
def test_layout_covers_and_pads_little(sizes):
    sequences = kk_packing.lay_out(sizes, 2048)
    seen = {}
    for i, begin, size in sorted(p for s in sequences for p in s):
        assert begin == seen.get(i, 0)
        seen[i] = begin + size
    assert seen == dict(enumerate(sizes)) and all(sum(p[2] for p in s) <= 2048 for s in sequences)


def plain_tokens(word: bytes, scores: dict, unknown: float) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for begin in range(end):
            step = scores.get(word[begin:end], unknown if begin == end - 1 else None)
            if step is not None:
                options.append((best[begin][0] + step, best[begin][1] - 1))
        best.append(max(options))
    return -best[-1][1]


def test_trie_counts(docs, rows, no_docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    scores = rank_scores(path)
    trie = Trie(scores, max_nodes=200)
    kept = {}
    plain = lambda w: kept.setdefault(w, plain_tokens(w, scores, trie.unknown))
    for r in rows:
        for w in set(PRE_TOKEN.findall((r[1] or "").encode())):
            if len(w) < 300:
                assert trie[w] == plain(w), w
    got = {tuple(r) for r in count_tokens(docs.where("doc_id != 11"), path).collect()}
    want = {(r[0], len(c := PRE_TOKEN.findall((r[1] or "").encode())), sum(map(plain, c))) for r in rows if r[0] not in (None, 11)}
    assert got == want
    assert b"".join(PRE_TOKEN.findall(b"  a\n b ")) == b"  a\n b "
    assert count_tokens(no_docs, path).count() == 0
    assert docs.where(F.col("doc_id") == 11).count() == 1 and trie[b"x" * 300] == plain_tokens(b"x" * 300, scores, trie.unknown)


def test_trie_keeps_few_bytes():
    scores = {b"ab": -1.0, b"a": -2.0, b"abc": -1.5}
    trie, plain = Trie(scores, max_bytes=700), Trie(scores)
    words = [b"abcab" * k for k in range(1, 200)] + [b"abz" * 90] * 3
    for w in words + words:
        assert trie[w] == plain[w]
        assert trie.kept_bytes == sum(map(len, trie.terminal)) <= 700


def test_chunks_are_bounded_by_bytes(vocabulary, encode):
    texts = pa.array(["é" * 30, None, "a" * 200, "", "漢字" * 10, "b"])
    assert list(byte_chunks(texts, 100)) == [(0, 2), (2, 3), (3, 6)]
    assert list(byte_chunks(texts.slice(4), 60)) == [(0, 1), (1, 2)] and list(byte_chunks(texts.slice(6))) == []
    flat, at = WordEncoder(vocabulary).encode(texts.slice(3, 2), 1)
    assert flat.tolist() == [1, *encode("漢字" * 10, 1)] and at.tolist() == [0, 1, len(flat)]
