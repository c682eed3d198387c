import random
import zlib

import numpy as np
import pytest

from seqscore.llm import langid, toxicity
from seqscore.llm.common import held_out

PARTS = {"aa": "ba ke lo mi nu".split(), "bb": "st rg äu ov ix".split(), "cc": "ци да но ру".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_remainder(docs_of):
    out = docs_of([(i, "") for i in range(200)]).select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)


def test_grams_and_masks():
    grams, ends = langid.grams_of([b"Ab", b"", b"x!y"])
    text = lambda s: int.from_bytes(s, "little")
    assert grams.tolist() == [text(g) for g in (b"  ab", b" ab ", b"ab  ", b"    ", b"  x ", b" x y", b"x y ", b" y  ")]
    assert ends.tolist() == [3, 4, 8]
    rng = np.random.default_rng(1)
    sets = {f"l{k:02d}": rng.integers(0, 1 << 32, 500, dtype=np.uint32) for k in range(11)}
    f = langid.build_filters(sets)
    for k, name in enumerate(f.languages):  # members are never missed, others seldom found
        assert ((f.masks(sets[name], k // 8) >> (k % 8)) & 1).all()
        strange = (f.masks(rng.integers(0, 1 << 32, 20_000, dtype=np.uint32), k // 8) >> (k % 8)) & 1
        assert abs(strange.mean() - f.fill[k] ** f.hashes) < 0.01


@pytest.mark.parametrize("extra", [False, True])
def test_languages(docs_of, extra):
    rng = random.Random(1)
    langs = ["aa", "bb", "cc"]
    rows = [(i, sentence(rng, langs[i % 3], rng.randrange(3, 60))) for i in range(240)]
    train = docs_of(rows).drop("lang")
    from pyspark.sql import functions as F
    train = train.withColumn("lang", F.element_at(F.array(*map(F.lit, langs)), (F.col("doc_id") % 3 + 1).cast("int")))
    filters = langid.learn(train, per_language=60)
    test = [(1000 + i, sentence(rng, langs[i % 3], 12)) for i in range(60)]
    odd = [(2000, None), (2001, ""), (2002, "12 345 !?"), (2003, "a"), (2004, sentence(rng, "cc", 20_000)), (None, "bake"), (1000, test[0][1])]
    out = langid.predict(docs_of(test + odd, extra), filters).collect()
    assert len(out) == len(test) + len(odd)
    found = {r.doc_id: r for r in out}
    assert all(found[1000 + i].lang_pred == langs[i % 3] for i in range(60))
    assert [found[i].lang_pred for i in (2000, 2001, 2002, 2004, None)] == ["und"] * 3 + ["cc", "aa"]
    assert found[2003].lang_pred in langs and all(0 <= r.score <= 1 for r in out)
    none = langid.learn(docs_of([(1, "abc"), (2, None)]))
    assert [(r.lang_pred, r.score) for r in langid.predict(docs_of([(1, "abc")]), none).collect()] == [("und", 0.0)]
    assert langid.predict(docs_of([]), filters).count() == 0


def test_sentences():
    words, heads, first, stop, counts = toxicity.features([b"One two. Three!", b"", b"...", b"four\nfive"])
    assert words.shape == (6, 5) and heads.tolist() == [0, 2, 3, 4] and counts.tolist() == [2, 0, 0, 2]
    assert list(zip(first.tolist(), stop.tolist())) == [(0, 7), (9, 14), (0, 4), (5, 9)]
    same = toxicity.features([b"Three"])[0][0]
    assert words[0, 2] == same[0] and (words[1:, 0] == 0).all()  # "One" has no proper prefix of 4
    p = np.array([0.2, 0.5, 0.1])
    assert np.allclose(toxicity.noisy_or(p, np.array([2, 0, 1])), [0.6, 0, 0.1])


def toxic_corpus(rng, n):
    rows, labels, where = [], [], {}
    for i in range(n):
        sentences = [sentence(rng, "aa", rng.randrange(4, 12)) for _ in range(rng.randrange(2, 9))]
        bad = rng.random() < 0.3
        if bad:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(["vile", "foulmouth", "foulness"])
            where[i] = k
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    return rows, labels, where


def test_toxicity(spark, docs_of):
    rng = random.Random(3)
    rows, labels, where = toxic_corpus(rng, 500)
    table = spark.createDataFrame([*labels, (None, 1), (9999, None)], "doc_id long, toxic int")
    held = [i for i, _ in rows if i >= 350]
    from pyspark.sql import functions as F
    model = toxicity.learn(docs_of(rows), table.where(F.col("doc_id") < 350), most=300)
    odd = [(2000, None), (2001, ""), (2002, "!!! ..."), (2003, sentence(rng, "aa", 20_000)), (None, "ba vile"), (0, rows[0][1])]
    out = toxicity.score(docs_of(rows + odd, extra=True), model).collect()
    assert len(out) == len(rows) + len(odd)
    found = {r.doc_id: r for r in out}
    right = [found[i].predicted == dict(labels)[i] for i in held]
    assert sum(right) > 0.95 * len(right)
    texts = dict(rows)
    for i in held:
        if i in where and found[i].predicted:
            spans = [texts[i].encode()[s.start:s.stop].decode() for s in found[i].offending]
            assert texts[i].split(". ")[where[i]].rstrip(".") in spans
    assert [found[i].score for i in (2000, 2001, 2002)] == [0, 0, 0] and found[2003].predicted == 0 and found[None].predicted == 1
    assert toxicity.score(docs_of([]), model).count() == 0
    only = toxicity.learn(docs_of(rows), table.where("toxic = 0"))
    assert [r.predicted for r in toxicity.score(docs_of([(1, "a b"), (2, None)]), only).collect()] == [0, 0]


def test_whole_words_are_read():
    a, b = b"x" * 64 + b"abc", b"x" * 64 + b"abd"
    words = toxicity.features([a, b])[0]
    assert words[0, 0] != words[0, 1] and (words[1:, 0] == words[1:, 1]).all()


def test_scripts_without_spaces():
    """Sentences end at their own marks, and no part of a sentence goes unread."""
    text = "这是第一句话。这是第二句话！第三句话很长很长很长很长很长很长很长很长很长很长很长很长坏词在这里？ok".encode()
    other = text.replace("坏词".encode(), "好词".encode())
    words, heads, first, stop, counts = toxicity.features([text, other])
    assert counts.tolist() == [4, 4]
    assert [text[a:b].decode() for a, b in zip(first[:4], stop[:4])] == [x for x in text.decode().replace("。", "|").replace("！", "|").replace("？", "|").split("|")]
    n = words.shape[1] // 2
    assert 1 <= (words[0, :n] != words[0, n:]).sum() <= 4
    assert toxicity.features(["คำหยาบ".encode()])[0].shape[1] > 2
    model = toxicity.fit([t.encode() for t in ["坏词在这里。很好很好"] * 30 + ["今天天气很好。很好很好"] * 30], np.array([1] * 30 + [0] * 30))
    words, heads, _, _, counts = toxicity.features(["天气很好。坏词在这里".encode(), "天气很好。很好".encode()])
    high, low = toxicity.noisy_or(model.sentence_scores(words, heads), counts)
    assert high > 0.5 > low
