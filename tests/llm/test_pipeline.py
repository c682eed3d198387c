import os
import random
import tempfile
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from seqscore.llm import packing
from test_models import sentence
from test_simhash import brute_components, brute_fingerprint
from test_suffixes import brute


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(9)
    rows, labels = [], []
    langs = ["aa", "bb", "cc"]
    passage = sentence(rng, "aa", 70)
    for i in range(400):
        text = ". ".join(sentence(rng, langs[i % 3], rng.randrange(5, 15)) for _ in range(rng.randrange(1, 7))) + "."
        toxic = i % 3 == 0 and rng.random() < 0.4
        if toxic:
            text += " " + " ".join(["vile"] * 3) + "."
        if i % 40 == 6:
            text += " " + passage
        rows.append((i, text, langs[i % 3], "s", len(text)))
        labels.append((i, 0, int(toxic)))
    rows += [(1000, rows[1][1], "bb", "s", 1), (1001, None, None, None, None), (1002, "123 !", None, None, 5), (1003, "", "aa", "s", 0),
             (None, rows[4][1], "bb", "s", 3), (2, rows[2][1], "cc", "s", 2), (1004, "qqq zzz xyxy wvwv " * 20, None, "s", 3)]
    path = tempfile.mkdtemp(prefix="pipeline-test-")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(os.path.join(path, "labels.parquet"))
    return path, rows, dict((i, t) for i, _, t in labels)


def test_every_stage(spark, folder):
    path, rows, toxic = folder
    docs = spark.read.parquet(path + "/documents.parquet")
    columns = docs.columns
    # language: nothing clean goes, what has no known language does
    one = cp.known_languages(spark, docs, path)
    kept = sorted(map(str, one.collect()))
    assert one.columns == columns
    assert [r.doc_id for r in docs.collect() if str(r) not in set(kept)] == [1001, 1002, 1003, 1004]
    # toxicity
    two = cp.not_toxic(spark, one, path)
    left = {r.doc_id for r in two.collect()}
    assert two.columns == columns
    wrong = [i for i, t in toxic.items() if (i in left) == bool(t)]
    assert len(wrong) <= 4
    # near copies: the smallest id of each group, once
    before = {r.doc_id: r.text for r in two.collect() if r.doc_id is not None}
    three = cp.near_copies(spark, two, path)
    prints = {i: brute_fingerprint(t) for i, t in before.items()}
    want = brute_components(prints)
    got = three.collect()
    assert three.columns == columns
    assert sorted(r.doc_id for r in got) == sorted(set(want.values()))
    assert all(r.text == before[r.doc_id] for r in got)
    # repeated passages
    four = cp.repeated_passages(spark, three, path)
    data = [(r.doc_id, r.text.encode()) for r in got]
    expected = {i: k.decode("utf-8", "ignore") for (i, _), (_, _, k) in zip(data, brute(data, 50))}
    after = {r.doc_id: r for r in four.collect()}
    assert four.columns == columns
    assert {i: r.text for i, r in after.items()} == expected and all(r.n_chars == len(r.text) for r in after.values())
    assert any(expected[i] != t.decode() for i, t in data)
    # packing
    pieces = cp.packed(spark, four, path).collect()
    ids = {i: packing.token_ids([r.text.encode()], cp.public_tokenizers.path(cp.TOKENIZER))[0] + np.array([1], "<u4").tobytes() for i, r in after.items()}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start:4 * (r.start + r.length)]) for r in pieces)
    assert sum(r.length for r in pieces) == sum(len(x) // 4 for x in ids.values())


def test_run_is_the_stages(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(path + "/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, path)
    key = ("doc_id", "start", "length", "ids_crc32")
    assert sorted(map(tuple, cp.run(spark, path).select(*key).collect())) == sorted(map(tuple, cp.packed(spark, docs, path).select(*key).collect()))


def test_empty(spark, folder):
    path = folder[0]
    none = spark.read.parquet(path + "/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, path).count() == 0
