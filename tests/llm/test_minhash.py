import random
import re

import numpy as np
import pytest

from seqscore.llm import minhash


def brute_set(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i:i + width]) for i in range(max(min(len(words), 1), len(words) - width + 1))}


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label[top(a)] = top(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if top(m) == top(k) and rows[m][0] is not None] if sets[k] else [i]
        least = min(ids, default=None)
        out.append((i, len(sets[k]), least, i is not None and i == least))
    return sorted(out, key=repr)


def near_copies(rng, n, words=60, vocabulary=2000):
    """Groups of texts with a few words changed, likeness from 0.5 to 1, chains included."""
    out = []
    while len(out) < n:
        if out and rng.random() < 0.7:
            text = list(rng.choice(out))
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(text))
                text[at:at + rng.randrange(0, 3)] = [f"v{rng.randrange(vocabulary)}"]
        else:
            text = [f"W{rng.randrange(vocabulary)}" for _ in range(rng.randrange(20, words))]
        out.append(text)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("how", [{}, {"posting_rows": 3, "cluster_shingles": 200}])
def test_components(docs_of, how):
    rng = random.Random(2)
    texts = near_copies(rng, 260)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "one"), (2004, "ONE"), (2005, "one two three"), (2006, texts[5].upper()), rows[9], (None, texts[4]),
             (2007, "w " * 40_000), (2008, "w w w w"), (2009, "ä\x0bÄ é\x1c f"), (2010, "ä ä é\x1c f"), (None, "alone by itself here now"), (-3, texts[8])]
    got = minhash.near_documents(docs_of(rows, extra=True).withColumn("class", minhash.F.lit("clash")).withColumn("i", minhash.F.lit(1)), **how)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_one_large_group(docs_of):
    """Hundreds of distinct near copies around the threshold, and a passage that all others share."""
    rng = random.Random(6)
    base, passage = [f"b{k}" for k in range(120)], [f"p{k}" for k in range(40)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(1, 6)):
            text[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(text)))
    for i in range(150, 250):
        own = [f"o{i}_{k}" for k in range(rng.choice([3, 10, 30]))]
        rows.append((i, " ".join(own[:2] + passage + own[2:])))
    got = minhash.near_documents(docs_of(rows), posting_rows=60)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty(docs_of):
    assert minhash.near_documents(docs_of([])).count() == 0
    assert [tuple(r) for r in minhash.near_documents(docs_of([(3, None), (None, "")])).collect()] in ([(3, 0, 3, True), (None, 0, None, False)], [(None, 0, None, False), (3, 0, 3, True)])


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(1)
    salt, odd = minhash._coordinates()
    for n in (30, 300, 3000):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
            a, b = pool[:9 * n // 8], pool[n // 8:10 * n // 8]  # 0.8
            agree.append((minhash.signature(a, salt, odd) == minhash.signature(b, salt, odd)).sum())
        assert abs(np.mean(agree) - 0.8 * 64) < 1.5
        assert min(agree) > minhash.MATCHES


def test_other_thresholds(docs_of):
    with pytest.raises(ValueError):
        minhash.near_documents(docs_of([]), percent=70)
