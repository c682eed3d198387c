import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from seqscore.llm import simhash


def brute_fingerprint(text, width=3):
    import re
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def cloud(rng, n):
    """Words of which many are within a few bits of each other, chains included."""
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        w = rng.getrandbits(64) if rng.random() < 0.3 else rng.choice(sorted(out))
        for _ in range(rng.randrange(0, 5)):
            w ^= 1 << rng.randrange(64)
        out.add(w)
    return np.array(sorted(out), np.uint64)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 300), st.integers(0, 10 ** 6), st.integers(0, 3), st.sampled_from([2, 3, 8]))
def test_index_search_is_exact(n, seed, most, fan):
    words = cloud(random.Random(seed), max(n, 2))
    index = simhash.GrayIndex(words, fan)
    got = {(int(q), p) for q, a, b in ((q, a, b) for x in index.search(0, len(words), most) for q, a, b in zip(*x)) for p in range(a, b)}
    got = {(min(p), max(p)) for p in got if p[0] != p[1]}
    near = np.bitwise_count(index.words[:, None] ^ index.words[None, :]) <= most
    assert got == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near[i, j]}


@pytest.mark.parametrize("group_rows", [4096, 3])
def test_components(spark, group_rows):
    words = cloud(random.Random(8), 260)
    df = spark.createDataFrame([(signed(int(w)),) for w in words] * 2, "fingerprint long")
    got = {r.node: r.root for r in simhash.link(df, 3, group_rows).collect()}
    want = brute_components({signed(int(w)): int(w) for w in words})
    assert {w: got.get(w, w) for w in want} == want


def test_documents(docs_of):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["The", "of", "ÄRGER", "x%d" % rng.randrange(9), "and\tto", "\n"]) for _ in range(rng.choice([1, 2, 3, 40, 200]))) for i in range(60)}
    texts |= {100: None, 101: "", 102: " \n ", 103: "one", 104: "One", 105: texts[3], 106: "w " * 40_000, 107: "ab\x0bcd ef\x1c gh"}
    rows = [*texts.items(), (3, texts[3]), (None, texts[4])]
    out = simhash.near_duplicates(docs_of(rows, extra=True)).collect()
    assert len(out) == len(rows)
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(prints)
    for r in out:
        i = 4 if r.doc_id is None else r.doc_id
        assert (r.fingerprint, r.component_id) == (signed(prints[i]), want[i])


def test_empty(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
