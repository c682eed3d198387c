import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from seqscore.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TABLE = bpe.Transducer(RANKS)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdetionrs ", max_size=80), st.text(alphabet="aé  \n'1", max_size=60)))
def test_encode_equals_the_library(text):
    assert bpe.encode_text(text, PATH, P.PATTERN).tolist() == ENC.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=24))
def test_pieces_equal_merging_by_definition(piece):
    assert [TABLE.bytes_of[t] for t in TABLE.encode(piece)] == bpe.merge(piece, RANKS)


def test_long_pieces_and_bounded_table():
    small = bpe.Transducer(RANKS, max_states=50)
    rng = random.Random(3)
    for n in (5000, 3000):
        for alphabet in ("a", "ab", "tionersand"):
            word = "".join(rng.choice(alphabet) for _ in range(n))
            assert small.encode(word.encode()) == ENC.encode_ordinary(word)
    assert max(len(t) for _, t, _ in TABLE.state) <= 2 * max(map(len, RANKS))


def test_one_long_piece_keeps_to_the_bound():
    """A piece of a million letters, each of them making states of its own."""
    small = bpe.Transducer(RANKS, max_states=1000)
    rng = random.Random(5)
    word = "".join(rng.choice("tionersandlcmp") for _ in range(1_000_000))
    held = []
    grow = small._anew
    small._anew = lambda k: held.append(len(small.state)) or grow(k)
    ids = small.encode(word.encode())
    assert b"".join(map(small.bytes_of.__getitem__, ids)) == word.encode()
    assert len(held) > 100 and max(held) <= 1000 + 64 + 1 and len(small.state) <= 1065
    part = word[:20_000]
    assert small.encode(part.encode()) == ENC.encode_ordinary(part)


def test_token_bytes():
    look_up = bpe.TokenBytes(TABLE.bytes_of)
    ids = [5, 300, 17, 49_000, 5]
    assert look_up(ids) == b"".join(TABLE.bytes_of[i] for i in ids) and look_up([]) == b""


def test_null_ids_and_long_pieces(docs_of):
    rows = [(None, "some text"), (None, None), (4, "ab" * 100_000)]
    got = {(r.doc_id, r.n_tokens) for r in bpe.encode_documents(docs_of(rows), PATH, P.PATTERN, digest=True).collect()}
    assert got == {(i, len(ENC.encode_ordinary(t or ""))) for i, t in rows}


@given(st.text(max_size=40), st.lists(st.integers(0, 160), max_size=8))
def test_stream_decode_round_trip(text, cuts):
    data = text.encode()
    at = sorted({0, len(data), *(c for c in cuts if c < len(data))})
    m = bpe.Utf8Machine()
    parts = [m.feed(data[a:b]) for a, b in zip(at, at[1:])]
    assert "".join(parts) + m.close() == text
    assert all("�" not in p for p in parts) or "�" in text


@pytest.mark.parametrize("extra", [False, True])
def test_query_columns(docs_of, extra):
    texts = [None, "", "Hello wörld 😀 x", "the same", "the same", "a" * 30_000, "\n\n  \t", "don't 123"]
    out = {r.doc_id: r for r in bpe.encode_documents(docs_of(list(enumerate(texts)), extra), PATH, P.PATTERN, digest=True, chunk=3).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        ids = ENC.encode_ordinary(t or "")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert [r.ids for r in bpe.encode_documents(docs_of([(1, "Hello")]), PATH, P.PATTERN).collect()] == [ENC.encode_ordinary("Hello")]
    assert bpe.encode_documents(docs_of([]), PATH, P.PATTERN, digest=True).count() == 0
