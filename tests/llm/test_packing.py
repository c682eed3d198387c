import random
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqscore.llm import packing

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing(sizes):
    plain, room = [], []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, r in enumerate(room) if r >= sizes[item]), len(room))
        if at == len(room):
            plain.append([])
            room.append(20)
        plain[at].append(item)
        room[at] -= sizes[item]
    assert packing.first_fit_decreasing(sizes, 20) == plain


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=40), st.sampled_from([16, 64]))
def test_pack_holds_every_token_once(lengths, capacity):
    seen = [np.zeros(n, int) for n in lengths]
    padding = 0
    for sequence in packing.pack(lengths, capacity, 4):
        n = sum(x for _, _, x in sequence)
        assert 0 < n <= capacity
        padding += 0 if n & (n - 1) == 0 else capacity - n
        assert n == capacity or n & (n - 1) == 0 or capacity - n < 4
        for doc, start, x in sequence:
            seen[doc][start:start + x] += 1
    assert all((s == 1).all() for s in seen)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aB's tionÉé 12.\ń  <|>endofx", max_size=80)))
def test_tokens_equal_the_library(text):
    got = np.frombuffer(packing.token_ids([text.encode()], PATH)[0], "<u4").tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


def test_words_and_marks_equal_the_library():
    rng = random.Random(8)
    words = packing.WordIds(PATH, most=300)
    assert words.plain
    for _ in range(30):
        texts = ["".join(rng.choice(["Ab", "c", "é", "É", "ß", "'s", "'", "t", ",", ".", "!!", "1", "&", "ǅ", "İ", "’", "日", "´"]) for _ in range(rng.randrange(1, 8))) for _ in range(200)]
        for t in texts:
            assert np.frombuffer(words[t.encode()], "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, t


def test_documents(docs_of):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "Beta", "don't", "é", "x9"]) for _ in range(rng.choice([0, 1, 30, 700, 5000]))) for _ in range(60)]
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "y" * 20_000), (3, texts[3]), (None, "no id")]
    out = packing.pack_documents(docs_of(rows, extra=True), PATH, group_bytes=60_000).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1])
    for i, copies in want.items():
        pieces = [r for r in out if r.doc_id == i]
        assert sum(r.length for r in pieces) == sum(map(len, copies))
        ids = copies[0]
        assert sorted((r.start, r.length) for r in pieces)[0][0] == 0
        for r in pieces:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
        if len(copies) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at
                at += r.length
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert len({s >> 32 for s in sequences}) > 3 and padding < 0.01 * sum(r.length for r in out)


def test_empty(docs_of):
    assert packing.pack_documents(docs_of([]), PATH).count() == 0
    one = packing.pack_documents(docs_of([(1, None)]), PATH).collect()
    assert [(r.start, r.length, r.doc_tokens, r.offset) for r in one] == [(0, 1, 1, 0)]


def test_long_words_are_not_kept():
    """Tables are bounded in bytes: words of any length are encoded alike, long ones each time."""
    path, long = P.path("word_bpe_49k.json"), b"ab" * 5000
    one = packing.token_ids([long, b"word, " + long + b" word"], path)
    words = packing._TOKENIZERS[path]
    assert max(map(len, words)) <= packing.LONGEST_KEPT >= max(map(len, words.parts))
    assert one == packing.token_ids([long, b"word, " + long + b" word"], path) and one[0] in one[1]
