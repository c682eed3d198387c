"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its shingles of five words, each weighing as often as it
occurs. For every sample and term there are fixed random numbers r, c ~ Gamma(2, 1) and
beta ~ U(0, 1); a term of weight w has t = floor(ln w / r + beta) and the value
c exp(-r (t - beta) - r), and the sample is the (term, t) of least value. Two texts agree in
a sample with a probability equal to the generalised Jaccard similarity of their terms.

The random numbers of a term are taken from one table of ``ROWS`` by ``WIDE``: a term's hash
names a row for each run of ``WIDE`` samples. Terms are told apart by their own hash, not by
their row, so that rows met twice don't make texts alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqscore.llm.common import cut_lineage

ROWS, WIDE, SAMPLES = 1 << 16, 16, 64
BLANK = np.array([c in b" \t\n\r\x0b\x0c" for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_TABLE: list = []


def table() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value for weight 1 in the upper half of 64 bits, r, ln c, beta), each ROWS by WIDE."""
    if not _TABLE:
        rng = np.random.Generator(np.random.PCG64(20))
        r, c = rng.gamma(2.0, 1.0, (ROWS, WIDE)), rng.gamma(2.0, 1.0, (ROWS, WIDE))
        beta = rng.random((ROWS, WIDE))
        _TABLE.extend((_ordered(np.log(c) + r * beta - r), r, np.log(c), beta))
    return tuple(_TABLE)


def _ordered(log_value: np.ndarray) -> np.ndarray:
    """Positive floats sort as their bits do."""
    return np.exp(log_value).astype("<f4").view("<u4").astype(np.uint64) << np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def terms(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts, number for each text). Words are runs without
    ASCII white space, A-Z lowered; a text with fewer than ``width`` words has one shingle of
    all of them, a text without words has none."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    word = ~BLANK[raw]
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    sizes = stops - starts
    powers = np.cumprod(np.concatenate(([1], np.full(int(sizes.max()), 0x100000001B3))).astype(np.uint64))
    first = np.cumsum(sizes) - sizes
    codes = LOWER[raw[word]].astype(np.uint64) * powers[np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)]
    words = _mix(np.add.reduceat(codes, first) + sizes.astype(np.uint64))
    # a shingle for each word with width - 1 more in its text, or for a short text's first word
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - place
    out, step = np.zeros(len(words), np.uint64), 1
    for k in range(width):
        step = step * (0x9E3779B97F4A7C15 + 2 * k) % (1 << 64)
        shifted = np.zeros_like(words)
        shifted[:max(0, len(words) - k)] = words[k:]
        out += np.where(left > k, shifted * np.uint64(step), np.uint64(0))
    whole = (left >= width) | (place == 0)
    return _mix(out[whole]), np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))


def signatures(texts: list[bytes], width: int = 5, samples: int = SAMPLES) -> np.ndarray:
    """16 bits of each sample's (term, t), a row per text; zeros for a text without words."""
    hashes, counts = terms(texts, width)
    out = np.zeros((len(texts), samples), np.uint16)
    if not len(hashes):
        return out
    of = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]))))
    weights = np.diff(np.append(new, len(hashes)))
    hashes, of = hashes[new], of[new]
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    repeated = np.flatnonzero(weights > 1)
    first, r, log_c, beta = table()
    name = hashes & np.uint64(0xFFFFFFFF)
    state = hashes
    for k in range(0, samples, WIDE):
        state = _mix(state + np.uint64(0x9E3779B97F4A7C15))
        row = (state >> np.uint64(48)).astype(np.int64)
        value = first[row]
        value |= name[:, None]
        if len(repeated):
            rr, bb = r[row[repeated]], beta[row[repeated]]
            t = np.floor(np.log(weights[repeated])[:, None] / rr + bb)
            own = _mix(name[repeated][:, None] + t.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) & np.uint64(0xFFFFFFFF)
            own = np.where(t == 0, name[repeated][:, None], own)
            value[repeated] = _ordered(log_c[row[repeated]] - rr * (t - bb) - rr) | own
        least = np.minimum.reduceat(value, starts, axis=0)[:, :samples - k]
        out[of[starts], k:k + WIDE] = (_mix(least & np.uint64(0xFFFFFFFF)) >> np.uint64(13)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def _places(key: np.ndarray, tie: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For rows of (key, tie), in falling key and rising tie, the number of cuts (key, tie) at or
    before each."""
    n = len(cuts)
    falling = ~np.concatenate((cuts[:, 0], key))
    order = np.lexsort((np.arange(n + len(key)) >= n, np.concatenate((cuts[:, 1], tie)), falling))
    out = np.empty(n + len(key), np.int32)
    out[order] = np.cumsum(order < n)
    return out[n:]


def in_order(docs: DataFrame, text: str = "text", cells: int = 4096, target: int = 4 << 20, *, sample: int = 64) -> DataFrame:
    """doc_id, text and ``extra``, dealt to partitions in contiguous runs of descending doc_id, rows of
    equal id by a hash of their text (``run``; null ids last). Every run is followed by the row
    that comes next to its last one, with ``extra`` set; the first row follows the last run.

    Runs are cut to about ``target`` bytes (more if that gave over ``cells`` runs) on a sample of
    about ``sample`` rows a run, drawn from the distinct (id, hash) with the bytes of each. So far-off
    ids, dense clusters of them, and many rows without id or of one id, are spread like others;
    only rows equal in id and text stay together. Texts are shuffled once.
    """
    lowest = -(1 << 63)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key")).withColumn("tie", F.xxhash64("text"))
    sizes = cut_lineage(keyed.groupBy("key", "tie").agg(F.sum(F.octet_length("text") + F.lit(64)).alias("size")))
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    target = max(target, whole["size"] // cells + 1)
    rate = min(1.0, sample * (whole["size"] // target + 1) / max(whole["n"], 1))
    drawn = sizes.where(F.pmod(F.xxhash64(F.lit(5), "key", "tie"), F.lit(1 << 20)) <= rate * (1 << 20)).collect()
    cuts, room = [], target * rate
    for r in sorted(drawn, key=lambda r: (-r["key"], r["tie"])):
        if room < 0:
            cuts.append((r["key"], r["tie"]))
            room = target * rate
        room -= r["size"]
    bounds = np.array(cuts, np.int64).reshape(-1, 2)

    @F.pandas_udf("int")
    def run_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(_places(key.to_numpy(), tie.to_numpy(), bounds))

    first = sizes.select(run_of("key", "tie").alias("run"), F.struct(F.bitwise_not("key").alias("falling"), "tie", "key").alias("row")).groupBy("run").agg(F.min("row").alias("row"))
    tops = {r["run"]: (r["row"]["key"], r["row"]["tie"]) for r in first.collect()}  # a row a run
    there = sorted(tops) or [0]
    before = {r: there[i - 1] for i, r in enumerate(there)}
    n = len(bounds) + 1
    at = F.col("run") + 1
    top_key, top_tie = (F.element_at(F.lit([tops.get(r, (0, 0))[i] for r in range(n)]), at) for i in (0, 1))
    back = F.element_at(F.lit([before.get(r, 0) for r in range(n)]), at)
    own = F.struct(F.col("run").cast("int").alias("run"), F.lit(False).alias("extra"))
    also = F.struct(back.cast("int").alias("run"), F.lit(True).alias("extra"))
    dealt = keyed.withColumn("run", run_of("key", "tie")).withColumn(
        "to", F.when((F.col("key") == top_key) & (F.col("tie") == top_tie), F.array(own, also)).otherwise(F.array(own)))
    return (dealt.select("doc_id", "text", "key", "tie", F.explode("to").alias("to"))
            .select("doc_id", "text", "key", "tie", "to.run", "to.extra").repartition("run")
            .sortWithinPartitions("run", "extra", F.desc("key"), "tie")
            .select("doc_id", "text", "run", "extra"))


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of the characters replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, width: int = 5, text: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex of the samples),
    near_edited, near_next. The next document is the next smaller doc_id; null ids come last,
    rows of equal id in the order of a hash of their text, and the first row follows the last.
    A null text counts as empty. Texts without words have the fingerprint zero and are alike.
    Rows are read as a stream: a task holds one batch of about ``batch_bytes``, not a run.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def finished(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, run, extra), in order; a result for each that has a next one."""
        pairs = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
        bodies = [r[1] for r in rows]
        edited = [edited_text(bodies[i], bodies[i + 1]).encode() for i in pairs]
        own, other = signatures([t.encode() for t in bodies], width), signatures(edited, width)
        at = np.array(pairs, np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][0] for i in pairs], pa.int64()), pa.array([len(bodies[i]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array([own[i].tobytes().hex() for i in pairs], pa.string()), pa.array([x.tobytes().hex() for x in other], pa.string()),
            pa.array(likeness(own[at], other)), pa.array(likeness(own[at], own[at + 1]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            bodies = (t.as_py().decode("utf-8", "replace") for t in batch.column(1).cast(pa.binary()))
            for row in zip(batch.column(0).to_pylist(), bodies, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                held.append(row)
                size += len(row[1])
                if size >= batch_bytes and len(held) > 1:
                    yield finished(held)
                    held, size = held[-1:], len(row[1])
        if len(held) > 1:
            yield finished(held)

    return in_order(docs, text).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                                "edited_fingerprint string, near_edited double, near_next double")
