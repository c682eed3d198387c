"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with the logistic probability of the
sum of its words' weights, a word having a weight of its own and one for each of some
prefixes; a document is toxic unless all its sentences are clean (noisy-or:
1 - product of 1 - p). The weights are trained from document labels alone, and are not negative: no number of harmless
words makes an offending one harmless. So the sentences that make a document toxic are found without ever being labelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqscore.llm.common import select_rows, slices

BITS = 20
PREFIXES = (4, 5, 6, 7, 8)  # bytes
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
IN_WORD = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 or c == 39 for c in range(256)])
ENDS = np.array([c in b".!?\n" for c in range(256)])
BASE = 0x100000001B3
#: The ideographic and full-width marks that end a sentence, in UTF-8.
WIDE_ENDS = ["。".encode(), "！".encode(), "？".encode(), "｡".encode()]


def _word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte and end byte of each word, whether a byte ends a sentence). Words are runs of
    letters and digits; in scripts without spaces (kana, ideographs, Thai, Lao) each two letters
    that follow one another are a word, the last also alone."""
    in_word, ends = IN_WORD[raw], ENDS[raw]
    if not (raw >= 0xE0).any():
        edge = np.diff(in_word.astype(np.int8), prepend=0)
        return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), ends
    after = np.append(raw[1:], 0)
    for mark in WIDE_ENDS:
        at = np.flatnonzero((raw == mark[0]) & (after == mark[1]) & (np.append(raw[2:], (0, 0)) == mark[2]))
        ends[at + 2] = True
        in_word[at[:, None] + np.arange(3)] = False
    letter = in_word & ((raw >= 0xE3) & (raw <= 0xE9) | (raw == 0xE0) & (after >= 0xB8) & (after <= 0xBB))
    at = np.flatnonzero(letter)
    at = at[at + 3 <= len(raw)]
    in_word[(at[:, None] + np.arange(3)).ravel()] = False
    edge = np.diff(in_word.astype(np.int8), prepend=0)
    pair = np.append(np.diff(at) == 3, False) if len(at) else np.zeros(0, bool)
    starts, stops = np.concatenate((np.flatnonzero(edge > 0), at)), np.concatenate((np.flatnonzero(edge < 0), at + np.where(pair, 6, 3)))
    order = np.argsort(starts, kind="stable")
    return starts[order], stops[order], ends


def features(texts: list[bytes]):
    """Word and sentence layout of texts: (hashed features of each word: itself and its proper
    prefixes, slot 0 where it has none; first word of each sentence; first byte and end byte of
    each sentence counted from its text; number of sentences of each text). Sentences end at
    . ! ? 。 ！ ？ or a line break; those without words are left out."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_starts = np.cumsum(lengths) - lengths
    starts, stops, ends = _word_spans(raw)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros((1 + len(PREFIXES), 0), np.int32), none, none, none, np.zeros(len(texts), np.int64)
    # a word is hashed by all its bytes and its length, a prefix by its bytes
    sizes = stops - starts
    first = np.cumsum(sizes) - sizes
    within = np.arange(sizes.sum()) - np.repeat(first, sizes)
    powers = np.cumprod(np.concatenate(([1], np.full(max(63, int(sizes.max())), BASE))).astype(np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LOWER[raw[np.repeat(starts, sizes) + within]].astype(np.uint64) * powers[within])))

    def slot(stop: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
        code = (sums[stop] - sums[first] + np.uint64(0x9E3779B97F4A7C15) * np.asarray(salt, np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        return np.maximum((code >> np.uint64(64 - BITS)).astype(np.int32), 1)

    rows = [slot(first + sizes, sizes)]
    for k in PREFIXES:
        rows.append(np.where(sizes > k, slot(np.minimum(first + k, len(sums) - 1), 1 << 40 | k), 0))
    marks = np.cumsum(ends)  # the break between texts ends a sentence too
    sentence = marks[starts]
    heads = np.flatnonzero(np.diff(sentence, prepend=-1))
    tails = np.append(heads[1:], len(starts)) - 1
    of = np.searchsorted(text_starts, starts[heads], "right") - 1
    return np.stack(rows), heads, starts[heads] - text_starts[of], stops[tails] - text_starts[of], np.bincount(of, minlength=len(texts))


@dataclass
class Model:
    weights: np.ndarray  # slot 0 stays 0
    bias: float

    def sentence_scores(self, words: np.ndarray, heads: np.ndarray) -> np.ndarray:
        if not len(heads):
            return np.zeros(0)
        total = np.zeros(words.shape[1])
        for row in words:
            total += self.weights[row]
        return 1 / (1 + np.exp(-np.clip(np.add.reduceat(total, heads) + self.bias, -30, 30)))


def noisy_or(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 - product of 1 - p over consecutive runs of ``counts``; 0 for none."""
    out = np.zeros(len(counts))
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.cumsum(counts[full]) - counts[full]
        out[full] = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), starts))
    return out


def _features_in_parts(texts: list[bytes], most: int = 1 << 20):
    """(words, heads, counts) of ``features``, worked out for about ``most`` bytes at a time: what
    it needs on the way is many times the text."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    cuts = np.unique(np.searchsorted(ends, np.arange(most, (ends[-1] if len(ends) else 0) + most, most), "right").clip(max=len(texts)))
    words, heads, counts, held = [np.zeros((1 + len(PREFIXES), 0), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for a, b in zip([0, *cuts], [*cuts, len(texts)]):
        if a < b:
            w, h, _, _, c = features(texts[a:b])
            words.append(w)
            heads.append(h + held)
            counts.append(c)
            held += w.shape[1]
    return np.concatenate(words, axis=1), np.concatenate(heads), np.concatenate(counts)


def fit(texts: list[bytes], labels: np.ndarray, importance: tuple[float, float] = (1.0, 1.0), rounds: int = 30,
        rate: float = 0.5, support: float = 2.0, support_share: float = 0.08) -> Model:
    """Proximal Adagrad on the noisy-or likelihood of document labels, all documents a round.
    ``importance``: how many documents a clean and a toxic one stand for.

    At the start a toxic document's blame is spread evenly over its sentences, so a word of one
    of them gets one part in the number of sentences. The L1 penalty equals the blame of
    ``support`` toxic documents and ``support_share`` of all: words backed by fewer keep weight
    zero, which keeps chance words of small samples and long clean sentences out. After
    ``rounds`` the words with a weight are fitted for as many rounds with a fifth of it."""
    words, heads, counts = _features_in_parts(texts)
    toxic = labels > 0
    if not len(heads) or not toxic.any() or not counts[toxic].any():
        return Model(np.zeros(1 << BITS), -30.0)
    share = np.where(toxic, importance[1], importance[0])
    share /= share.sum()
    per_text = max(1.0, counts[toxic].mean())
    penalty = (support + support_share * toxic.sum()) * share[toxic].mean() / per_text
    sizes = np.diff(np.append(heads, words.shape[1]))
    model = Model(np.zeros(1 << BITS), float(np.log(max(share[toxic].sum(), 1e-6) / per_text)))
    squares, bias_square = np.full(1 << BITS, 1e-12), 1e-12
    kept = np.ones(1 << BITS, bool)
    for step_no in range(2 * rounds):
        if step_no == rounds:  # the words are chosen; the penalty has made their weights too small
            kept, penalty = model.weights != 0, penalty / 5
        p = model.sentence_scores(words, heads)
        whole = np.clip(noisy_or(p, counts), 1e-9, 1 - 1e-9)
        # d(-log likelihood)/dz of a sentence: p in a clean document, -p (1 - P) / P in a toxic one
        pull = np.repeat(np.where(toxic, -(1 - whole) / whole, 1.0) * share, counts) * p
        each = np.repeat(pull, sizes)
        gradient = sum(np.bincount(row, each, 1 << BITS) for row in words)
        squares += gradient ** 2
        step = rate / np.sqrt(squares)
        moved = model.weights - step * gradient
        model.weights = np.maximum(moved - step * penalty, 0)
        model.weights[~kept] = 0
        model.weights[0] = 0
        bias_square += pull.sum() ** 2
        model.bias -= float(rate / 4 * pull.sum() / np.sqrt(bias_square))
    return model


def learn(docs: DataFrame, labels: DataFrame, most: int = 8_000, text: str = "text", label: str = "toxic") -> Model:
    """A model from the texts of ``docs`` (doc_id, text) and ``labels`` (doc_id, label); rows
    with a null id, text or label teach nothing. ``most`` bounds the labels learned from: beyond
    it about so many are chosen by a hash of the id, half of them of either label where there
    are enough, and each stands for as many as it was chosen from. Only the chosen ids meet the
    texts, so the join broadcasts them; the sample is fitted in one task. Without labels of both
    kinds every score is 0 or 1, by the one that there is."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model(np.zeros(1 << BITS), 30.0 if counts.get(1) else -30.0)
    room = {1: min(counts[1], max(most // 2, most - counts[0]))}
    room[0] = min(counts[0], most - room[1])
    importance = (counts[0] / room[0], counts[1] / room[1])
    rate = F.when(F.col("label") == 1, 1 / importance[1]).otherwise(1 / importance[0])
    ids = rows.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    chosen = texts.join(F.broadcast(ids), "doc_id")  # about ``most`` ids, whatever the input

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"], kind="stable")
        model = fit([t.encode() for t in group["text"]], group["label"].to_numpy(), importance)
        held = np.flatnonzero(model.weights)
        return pd.DataFrame({"word": np.append(held, -1), "weight": np.append(model.weights[held], model.bias)})

    weights, bias = np.zeros(1 << BITS), -30.0
    for r in chosen.groupBy(F.lit(0).alias("one")).applyInPandas(lambda g: train(g), "word long, weight double").collect():
        if r.word < 0:
            bias = r.weight
        else:
            weights[r.word] = r.weight
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, offending: float = 0.3, text: str = "text") -> DataFrame:
    """doc_id, score, predicted and the offending sentences of every row of ``docs``: an array
    of (start, stop, score), in bytes of the UTF-8 text, of the sentences that score
    ``offending`` or more. predicted is 1 if score >= threshold. A text that is null or has no
    words has no sentences and scores 0. Whole texts are read; other columns are not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in slices(batches, "text", 2 << 20):
            words, heads, first, stop, counts = features([t.as_py() or b"" for t in batch.column(1).cast(pa.binary())])
            p = m.sentence_scores(words, heads)
            whole = noisy_or(p, counts)
            bad = np.flatnonzero(p >= offending)
            of = np.repeat(np.arange(len(counts)), counts)[bad]
            offsets = np.searchsorted(of, np.arange(len(counts) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(first[bad]), pa.array(stop[bad]), pa.array(p[bad])], fields=list(span))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(whole), pa.array((whole >= threshold).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets), spans)], ["doc_id", "score", "predicted", "offending"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int, offending array<struct<start:long,stop:long,score:double>>")


def harmless(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def wanted(bodies: list[bytes]) -> list[bool]:
        words, heads, _, _, counts = features(bodies)
        return (noisy_or(shared.value.sentence_scores(words, heads), counts) < threshold).tolist()

    return select_rows(docs, wanted, text, 2 << 20)
