"""Periodic runs of words, by minimizers at several scales.

A run is a maximal stretch of words with smallest period q and at least max(6, 4q) words.
Periods up to ``SHORT`` are found by comparing the words with themselves at each such lag. A
scale covers the periods from w + 1 to g = 2w words: of every w strings of g words the one with
the least hash is a minimizer. Inside a run of such a period the minima repeat at the period's
distance, and a string as long as the period stands nowhere between, so minimizers next to each
other among the equal ones seed a lag; extension in both directions, word by word, gives the run.

Texts of a batch stand in one array, with a mark of its own after each, so that no stretch
crosses texts; a scale reads only the texts long enough for its shortest run.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqscore.llm.common import slices

SHORT = 8


class Numbers(dict):
    """A number for each word, from 0 on in the order they come."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sliding(values: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """Least (or by ``of``) of each ``width`` values that follow one another."""
    out, w = values, 1
    while 2 * w <= width:
        out, w = of(out[:-w], out[w:]), 2 * w
    return of(out[:len(out) - (width - w)], out[width - w:]) if width > w else out


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that have the least hash of some window of ``width`` places."""
    least = sliding(hashes, width)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate((edge, least, edge)), width, np.maximum) == hashes)


def _same_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """Number of places from the start on at which two arrays agree."""
    at, step, n = 0, 64, len(a)
    while at < n:
        differ = a[at:at + step] != b[at:at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, 2 * step
    return n


def stretch(seq: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The places around ``at`` from which the word ``lag`` further on is the same: first, end."""
    end = at + _same_ahead(seq[at:len(seq) - lag], seq[at + lag:])
    first = at - _same_ahead(seq[:at][::-1], seq[lag:at + lag][::-1])
    return first, end


def primitive(word: np.ndarray) -> bool:
    """Whether no shorter period divides the length."""
    n = rest = len(word)
    divisor = 2
    while rest > 1:
        if divisor * divisor > rest:
            divisor = rest
        if rest % divisor == 0:
            while rest % divisor == 0:
                rest //= divisor
            if (word[n // divisor:] == word[:n - n // divisor]).all():
                return False
        divisor += 1
    return True


def long_enough(length: int, period: int) -> bool:
    return length >= max(6, 4 * period)


def runs_in(seq: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(first place, words, period) of all runs of ``seq``, where the texts with ``sizes`` words
    begin at ``starts`` and each is followed by a mark that stands nowhere else."""
    found: list[tuple[int, int, int]] = []

    def take(words: np.ndarray, first: int, end: int, period: int, place) -> None:
        if long_enough(end - first + period, period) and primitive(words[first:first + period]):
            found.append((int(place(first)), end - first + period, period))

    for lag in range(1, SHORT + 1):
        same = np.flatnonzero(seq[lag:] == seq[:-lag])
        cut = np.flatnonzero(np.diff(same) != 1)
        first, last = same[np.concatenate(([0], cut + 1))] if len(same) else same, same[np.append(cut, len(same) - 1)] if len(same) else same
        for a, b in zip(first[last - first + 1 + lag >= max(6, 4 * lag)].tolist(), last[last - first + 1 + lag >= max(6, 4 * lag)].tolist()):
            take(seq, a, b + 1, lag, lambda x: x)
    w = SHORT
    while True:
        fit = np.flatnonzero(sizes >= 4 * (w + 1))
        if not len(fit):
            break
        n = sizes[fit] + 1
        where = np.repeat(starts[fit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        words = seq[where]
        hashes, g = mix(words.astype(np.uint64) + np.uint64(1)), 1
        while g < 2 * w:
            hashes, g = mix(hashes[:-g] * np.uint64(0x9E3779B97F4A7C15) + hashes[g:]), 2 * g
        at = minimizers(hashes, w)
        at = at[np.argsort(hashes[at], kind="stable")]
        lag = np.diff(at)
        equal = (hashes[at[1:]] == hashes[at[:-1]]) & (lag > w) & (lag <= 2 * w)
        at, lag = at[:-1][equal], lag[equal]
        order = np.lexsort((at, lag))
        before, reach = 0, -1
        for i, period in zip(at[order].tolist(), lag[order].tolist()):
            if period == before and i < reach:
                continue  # a seed of the stretch just extended
            first, end = stretch(words, i, period)
            before, reach = period, end
            if end > first:
                take(words, first, end, period, lambda x: where[x])
        w *= 2
    return found


def looped(n: int, doc_id) -> tuple[int, int] | None:
    """(a, p) if the words from a on are to repeat with period p, by the id's checksum."""
    h = crc32(str(doc_id).encode())
    if h % 10 or not n or doc_id is None:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


FIELDS = [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
          ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def find_runs(docs: DataFrame, text: str = "text", loop: bool = False, keep_text: bool = False, slice_bytes: int = 4 << 20) -> DataFrame:
    """For every row of ``docs``: doc_id, n_runs, the run of greatest length / period (ties: the
    smallest start, then period) as start, length, period, exponent_milli, null where there is no
    run, and the hashes of all runs and of the words kept; with ``keep_text`` also runs (array of
    start, length, period) and collapsed (the words kept).

    Words are the text's runs without ASCII white space. ``loop``: some texts, by the checksum of
    their id, are first made periodic (``looped``; a null id never is). A null or empty text has
    no words: no run, and the hash of nothing. Rows that repeat give rows that repeat. Other
    columns are not read. One scan, nothing is shuffled; a task holds the words of one long text
    or of ``slice_bytes`` of text.
    """
    fields = FIELDS + ([("runs", pa.list_(pa.list_(pa.int64()))), ("collapsed", pa.binary())] if keep_text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", slice_bytes):
            ids, numbers = batch.column(0).to_pylist(), Numbers()
            texts: list[list[bytes]] = []
            coded: list[np.ndarray] = []
            for doc_id, body in zip(ids, batch.column(1)):
                words = (body.as_py() or b"").split()  # bytes: only ASCII white space splits
                again = looped(len(words), doc_id) if loop else None
                if again:
                    a, p = again
                    head = words[:a + p]
                    words = head + (head[a:] * (-(-(len(words) - a) // p)))[p:len(words) - a]
                texts.append(words)
                coded.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            starts = np.cumsum(sizes + 1) - (sizes + 1)
            marks = np.arange(len(numbers), len(numbers) + len(coded), dtype=np.int32)
            seq = np.concatenate([x for words, mark in zip(coded, marks) for x in (words, [mark])]).astype(np.int32)
            runs: list[list[tuple[int, int, int]]] = [[] for _ in coded]
            for place, length, period in runs_in(seq, starts, sizes):
                of = int(np.searchsorted(starts, place, "right")) - 1
                runs[of].append((place - int(starts[of]), length, period))
            rows = []
            for doc_id, words, found in zip(ids, texts, runs):
                found.sort(key=lambda r: (r[0], r[2]))
                best = (None,) * 3
                for r in found:
                    if best[0] is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
                rest = _collapsed(words, found)
                rows.append((doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
                             sha256(listed.encode()).hexdigest(), sha256(rest).hexdigest(), *([found, rest] if keep_text else [])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), fields)], schema=pa.schema(fields))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(run, DDL + (", runs array<array<long>>, collapsed binary" if keep_text else ""))
