import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seqscore.llm import runs


def brute_runs(words):
    """All maximal stretches, period by period; a stretch counts under its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text, loop):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc_id is None else crc32(str(doc_id).encode())
    if loop and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    from fractions import Fraction
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha256(lines.encode()).hexdigest(), sha256(rest.encode()).hexdigest())


def in_one_array(texts):
    sizes = np.array([len(t) for t in texts])
    seq = np.concatenate([np.append(t, 10 ** 6 + k) for k, t in enumerate(texts)]).astype(np.int32)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    out = [[] for _ in texts]
    for place, n, q in runs.runs_in(seq, starts, sizes):
        k = int(np.searchsorted(starts, place, "right")) - 1
        out[k].append((place - int(starts[k]), n, q))
    return [sorted(x) for x in out]


def periodic(rng):
    """Words with runs of many periods, beside and inside one another."""
    out = []
    for _ in range(rng.randrange(1, 6)):
        word = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 64, 70]))]
        if rng.random() < 0.3:
            word = word * 4 + [rng.randrange(9)]
        n = int(len(word) * rng.choice([1, 3.9, 4, 4.5, 6, 9]))
        out += (word * 10)[:n] + [rng.randrange(60) for _ in range(rng.choice([0, 0, 1, 5, 40]))]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 10 ** 6), min_size=1, max_size=6))
def test_runs_are_those_of_all_lags(seeds):
    texts = [periodic(random.Random(s)) for s in seeds] + [[], [1], [2] * 6, [2] * 5]
    assert in_one_array(texts) == [brute_runs(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120))
def test_runs_of_two_words(words):
    assert in_one_array([words]) == [brute_runs(words)]


def test_long_periods():
    rng = random.Random(3)
    for q in (129, 255, 256, 257, 1000):
        word = [rng.randrange(10 ** 5) for _ in range(q)]
        text = [7, 8, *(word * 5)[:4 * q + 3], 9]
        assert in_one_array([text, word * 3]) == [[(2, 4 * q + 3, q)], []]


def test_documents(docs_of):
    rng = random.Random(5)
    texts = {i: " ".join(f"w{x}" for x in periodic(rng)) for i in range(80)}
    texts |= {100: None, 101: "", 102: " \n\t ", 103: "a", 104: "a\x0ba a\x0ca a\ra a", 105: texts[3], 106: "x " * 30_000, 107: "ä b " * 9,
              108: " ".join(str(rng.random()) for _ in range(3_000)), -7: "b a " * 40}
    rows = [*texts.items(), (3, texts[3]), (None, texts[4])]
    for loop in (False, True):
        out = runs.find_runs(docs_of(rows, extra=True), loop=loop, slice_bytes=20_000).collect()
        assert sorted(map(tuple, out), key=repr) == sorted((brute_row(i, t, loop) for i, t in rows), key=repr)


def test_texts_and_empty(docs_of):
    row = runs.find_runs(docs_of([(1, "a b " * 5 + "c")]), keep_text=True).first()
    assert (row.runs, bytes(row.collapsed)) == ([[0, 10, 2]], b"a b c")
    assert runs.find_runs(docs_of([])).count() == 0
