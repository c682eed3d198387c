"""Language identification by language-bitmask n-gram filters.

Every language has the set of byte n-grams that are typical of it. All sets lie in one
bit-sliced Bloom filter: a slot holds one bit per language, so the AND of an n-gram's slots
gives all languages that contain it at once. A text is scored by counting, per language, the
n-grams whose bit is set; the counts are corrected for the filter's false positives, whose
rate is known per language from its share of set bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqscore.llm.common import select_rows, slices

SPACE = 0x20
# bytes that are no letters become spaces, A-Z small letters; bytes of other scripts stay
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else SPACE for c in range(256)], np.uint8)
GRAM = 4
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(4-byte n-grams as numbers, end of each text's n-grams). Texts are folded and stand
    between two spaces on either side, so that every text with a byte has n-grams."""
    raw = FOLD[np.frombuffer(b"  " + b"    ".join(texts) + b"  ", np.uint8)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths + 4)[:-1]))
    n = len(raw) - GRAM + 1
    every = np.ndarray((n,), "<u4", raw, strides=(1,)).astype(np.uint32)
    # a text's block has length + 1 n-grams that lie in it; three more reach into the next
    inside = np.ones(n, bool)
    for k in range(1, GRAM):
        inside[(starts + lengths + k)[starts + lengths + k < n]] = False
    return every[inside], np.cumsum(lengths + 1)


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # (words of 8 languages, slots) of uint8
    hashes: int
    fill: np.ndarray  # share of set bits per language

    def masks(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        shift = np.uint32(32 - int(self.slots.shape[1]).bit_length() + 1)
        out = None
        for multiplier in MULTIPLIERS[:self.hashes]:
            mixed = grams * np.uint32(multiplier)
            mixed ^= mixed >> np.uint32(15)
            at = (mixed * np.uint32(0x2C1B3C6D)) >> shift
            out = self.slots[word][at] if out is None else out & self.slots[word][at]
        return out

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Per text and language the share of n-grams the language contains, corrected: of the
        n-grams it lacks, fill ** hashes are counted by mistake."""
        grams, ends = grams_of(texts)
        counts = np.empty((len(texts), len(self.languages)))
        starts = np.concatenate(([0], ends[:-1]))
        for k in range(len(self.languages)):
            if k % 8 == 0:
                mask = self.masks(grams, k // 8)
            counts[:, k] = np.add.reduceat((mask >> np.uint8(k % 8)) & np.uint8(1), starts, dtype=np.int64)
        total = (ends - starts)[:, None]
        wrong = self.fill ** self.hashes
        return np.clip((counts / total - wrong) / (1 - wrong), 0, 1)


def build_filters(sets: dict[str, np.ndarray], hashes: int = 3, bits_per_gram: int = 10) -> Filters:
    """One bit-sliced filter of all languages' n-gram sets."""
    languages = sorted(sets)
    most = max([1, *map(len, sets.values())])
    size = 1 << max(10, (most * bits_per_gram - 1).bit_length())
    slots = np.zeros((max(1, -(-len(languages) // 8)), size), np.uint8)
    filters = Filters(languages, slots, hashes, np.zeros(len(languages)))
    shift = np.uint32(32 - size.bit_length() + 1)
    for k, language in enumerate(languages):
        own = np.zeros(size, bool)
        grams = sets[language].astype(np.uint32)
        for multiplier in MULTIPLIERS[:hashes]:
            mixed = grams * np.uint32(multiplier)
            mixed ^= mixed >> np.uint32(15)
            own[(mixed * np.uint32(0x2C1B3C6D)) >> shift] = True
        slots[k // 8] |= own.astype(np.uint8) << np.uint8(k % 8)
        filters.fill[k] = own.mean()
    return filters


def learn(labelled: DataFrame, per_language: int = 4000, least: int = 3, share: float = 0.2,
          text: str = "text", lang: str = "lang") -> Filters:
    """Filters from the labelled rows of ``labelled`` (doc_id, text, lang).

    An n-gram is in a language's set if it occurs ``least`` times or more there and its
    relative frequency is at least ``share`` of the highest that it has in any language.
    ``per_language`` bounds the rows learned from: languages with more give a sample of about
    so many, chosen by a hash of the id. Null texts or languages teach nothing.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return build_filters({})
    languages, rate = sorted(counts), F.lit(1.0)
    for name, n in counts.items():
        if n > per_language:
            rate = F.when(F.col("lang") == F.lit(name), F.lit(per_language / n)).otherwise(rate)
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    index = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            of = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            grams, ends = grams_of([t.as_py() for t in batch.column(0).cast(pa.binary())])
            keys, n = np.unique(np.repeat(of, np.diff(ends, prepend=0)) << 32 | grams.astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    found = (chosen.select("text", "lang").mapInArrow(count, "lang long, gram long, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)).collect()
    totals = np.zeros(len(languages))
    for r in found:
        totals[r.lang] += r.n
    best: dict[int, float] = {}
    for r in found:
        best[r.gram] = max(best.get(r.gram, 0.0), r.n / totals[r.lang])
    sets: dict[str, list] = {name: [] for name in languages}
    for r in found:
        if r.n / totals[r.lang] >= share * best[r.gram]:
            sets[languages[r.lang]].append(r.gram)
    return build_filters({name: np.array(x, np.uint32) for name, x in sets.items()})


def has_letter(body: bytes) -> bool:
    return any(map(str.isalpha, body.decode("utf-8", "replace")))


def predict_texts(filters: Filters, bodies: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, coverage) of each text, see ``predict``."""
    known = np.array([len(filters.languages) > 0 and has_letter(b) for b in bodies], bool)
    shares = filters.shares(bodies) if filters.languages else np.zeros((len(bodies), 1))
    every = np.arange(len(bodies))
    top = shares.argmax(axis=1)
    best = shares[every, top]
    rest = shares.copy()
    rest[every, top] = 0
    score = best - rest.max(axis=1) / 2
    return [filters.languages[k] if ok else "und" for k, ok in zip(top, known)], np.where(known, score, 0.0), np.where(known, best, 0.0)


def predict(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, coverage for every row of ``docs``.

    The language is the one with the highest corrected share of the text's n-grams, ties to
    the first by name; coverage is that share, score is it less half the runner-up's share.
    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Whole
    texts are read; other columns are not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            names, score, coverage = predict_texts(shared.value, [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(coverage)],
                                             ["doc_id", "lang_pred", "score", "coverage"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, coverage double")


def known_language(docs: DataFrame, filters: Filters, least: float = 0.2, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language: not ``und``, and with at least
    ``least`` of its n-grams known there."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def wanted(bodies: list[bytes]) -> list[bool]:
        names, _, coverage = predict_texts(shared.value, bodies)
        return [n != "und" and bool(c >= least) for n, c in zip(names, coverage)]

    return select_rows(docs, wanted, text)
