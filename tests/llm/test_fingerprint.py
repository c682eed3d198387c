import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from seqscore.llm import fingerprint as fp


def weighted(text, width=5):
    w = text.lower().split()
    return Counter(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_collision_rate_is_the_generalised_jaccard():
    rng = random.Random(2)
    worst, total = 0, []
    for k in range(60):
        words = [rng.choice("abcdefgh") for _ in range(300)]
        other = list(words)
        for _ in range(rng.randrange(0, 250)):
            other[rng.randrange(300)] = rng.choice("abcdefgh")
        a, b = " ".join(words), " ".join(other)
        for width in (2, 5):
            sig = fp.signatures([a.encode(), b.encode()], width, 64)
            off = fp.likeness(sig[:1], sig[1:])[0] - jaccard(weighted(a, width), weighted(b, width))
            worst, total = max(worst, abs(off)), [*total, off]
    assert worst < 0.28 and abs(np.mean(total)) < 0.02


def test_signature_depends_on_the_text_only():
    texts = [b"a b c d e f g", b"", b"x", b"a b c d e f g", b"  \n", b"A  b\tc d e f g", ("ü" * 70_000).encode()]
    together = fp.signatures(texts)
    for i, t in enumerate(texts):
        assert (fp.signatures([t])[0] == together[i]).all()
    assert (together[0] == together[5]).all() and not together[1].any() and not together[4].any()


@pytest.mark.parametrize("cells", [4096, 3])
def test_order_and_edits(docs_of, cells, monkeypatch):
    rng = random.Random(4)
    rows = [(i * 7 - 900, " ".join(rng.choice(["ab", "é", "c😀"]) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    rows += [(None, "no id here"), (5_000_000_000, None), (123456, "x" * 30_000), (4, "one")]
    monkeypatch.setattr(fp.in_order, "__defaults__", ("text", cells, 500))
    out = {r.doc_id: r for r in fp.fingerprint_documents(docs_of(rows, extra=True), batch_bytes=300).collect()}
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = (t[:len(t) - half] + n[:half]).encode()
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited).hexdigest())
        sig = fp.signatures([t.encode(), edited, n.encode()])
        assert (r.fingerprint, r.edited_fingerprint) == (sig[0].tobytes().hex(), sig[1].tobytes().hex())
        assert (r.near_edited, r.near_next) == ((sig[0] == sig[1]).mean(), (sig[0] == sig[2]).mean())


def test_small_tables(docs_of):
    assert fp.fingerprint_documents(docs_of([])).count() == 0
    one = fp.fingerprint_documents(docs_of([(3, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    same = fp.fingerprint_documents(docs_of([(3, "a b c"), (3, "a b c"), (3, "a b c")])).collect()
    assert [(r.doc_id, r.near_next) for r in same] == [(3, 1.0)] * 3


def test_crowded_ids_are_spread(docs_of):
    """One far-off id, many rows without id and many of one id: no run holds more than a share."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(40))
    rows = [(i, word()) for i in range(300)] + [(9 * 10 ** 18, "far")] + [(None, word()) for _ in range(300)] + [(150, word()) for _ in range(300)]
    out = fp.in_order(docs_of(rows), target=3000).collect()
    own = [r for r in out if not r.extra]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in own) == sorted((i is None, i or 0, t) for i, t in rows)
    size = {}
    for r in own:
        size[r.run] = size.get(r.run, 0) + 104
    assert len(size) > 15 and max(size.values()) < 8 * 3000
    place = lambda r: (r.doc_id is None, -(r.doc_id or 0))
    runs = [sorted(map(place, (r for r in own if r.run == k))) for k in sorted(size)]
    assert all(a[-1] <= b[0] for a, b in zip(runs, runs[1:]))
    assert len([r for r in out if r.extra]) == len(size)


def test_edits_of_crowded_ids(docs_of, monkeypatch):
    """Every row's edited text is made with the row after it, across runs too."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 5, 5, 6]), "".join(rng.choice("abc ") for _ in range(30))) for _ in range(200)]
    monkeypatch.setattr(fp.in_order, "__defaults__", ("text", 4096, 400))
    got = sorted((r.n_chars, r.edited_sha256) for r in fp.fingerprint_documents(docs_of(rows)).collect())
    df = docs_of(rows).selectExpr("doc_id", "text", "xxhash64(text) as h").collect()
    order = sorted(df, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = sorted((len(a.text), hashlib.sha256(fp.edited_text(a.text, b.text).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1]))
    assert got == want
