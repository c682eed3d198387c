"""SimHash fingerprints and their linking by a Gray-order hierarchical index.

Fingerprints that differ in at most three of 64 bits agree in one of four 16-bit blocks at
least, so each distinct fingerprint is dealt to four groups, by a part of each block just
long enough to give groups of about ``group_rows``. Groups that are much larger are dealt
again: by the whole block, and then by each of four parts of the other 48 bits.

Inside a group the fingerprints are sorted by Gray rank, which puts words with few differing
bits next to each other. Runs of them form nodes, runs of nodes upper nodes. A node holds
the bits that all below it share, without those its ancestors hold already; a search adds up
the differences on its way down, leaves out a node when they pass the limit, and takes a
whole node when the bits that may still differ cannot pass it. Only a spanning forest of the
links leaves a group, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqscore.llm.common import cut_lineage, slices
from seqscore.llm.components import connected_components

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def text_hashes(body: bytes, width: int, seed: int) -> list[int]:
    """XXH64 of each shingle of ``width`` words, repeats included; of all words if fewer."""
    words = body.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    line = b" ".join(words)
    starts = np.zeros(len(words), np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts[1:] = ends[:-1] + 1
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive runs of ``counts`` hashes the word of the bits set in over half of a run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little")
        out[full] = packed.view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, text: str = "text") -> DataFrame:
    """doc_id, hash (of the text), fingerprint (long, the 64 bits) of every row. Words are the
    text's runs without ASCII white space, A-Z lowered. No words, or a null text: 0. Nothing is
    shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            found = [text_hashes(t.as_py() or b"", width, seed) for t in batch.column(2).cast(pa.binary())]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((h for x in found for h in x), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(majority_bits(flat, counts).view(np.int64))], ["doc_id", "hash", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, hash long, fingerprint long")


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Place of each word in the reflected Gray sequence."""
    out = words.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Hierarchical index of distinct 64-bit words, by Gray order."""

    def __init__(self, words: np.ndarray, fan: int = 8):
        self.words, self.fan = words[np.argsort(gray_rank(words), kind="stable")], fan
        shared, pattern = np.full(len(words), ALL), self.words
        levels = [(shared, pattern)]
        while len(levels[-1][0]) > 1:
            shared, pattern = levels[-1]
            starts = np.arange(0, len(shared), fan)
            first = np.repeat(pattern[starts], np.diff(np.append(starts, len(shared))))
            differ = np.bitwise_or.reduceat(first ^ pattern | ~shared, starts)
            levels.append((~differ, pattern[starts] & ~differ))
        self.levels = []  # from the top: bits first held here, their values, number of bits not held yet
        above = np.zeros(1, np.uint64)
        for shared, pattern in reversed(levels):
            held = np.repeat(above, fan)[:len(shared)] if self.levels else np.zeros(1, np.uint64)
            own = shared & ~held
            self.levels.append((own, pattern & own, 64 - np.bitwise_count(shared).astype(np.int16)))
            above = shared

    def search(self, first: int, last: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Links of the words at places first to last with words at later places or in nodes
        with such: (query place, first place, last place + 1); every word between is linked."""
        query = np.arange(first, last)
        node, total = np.zeros(len(query), np.int64), np.zeros(len(query), np.int16)
        size = self.fan ** (len(self.levels) - 1)
        for depth, (own, pattern, left) in enumerate(self.levels):
            if depth:
                node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                query, total = np.repeat(query, self.fan), np.repeat(total, self.fan)
                keep = (node < len(own)) & ((node + 1) * size > query + 1)
                node, query, total = node[keep], query[keep], total[keep]
            total = total + np.bitwise_count((self.words[query] ^ pattern[node]) & own[node])
            near = total <= most
            whole = near & (total + left[node] <= most)
            if whole.any():
                yield query[whole], node[whole] * size, np.minimum((node[whole] + 1) * size, len(self.words))
            near &= ~whole
            node, query, total = node[near], query[near], total[near]
            size //= self.fan


def local_forest(words: np.ndarray, most: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(word, root) for all words that the links inside the group join to another root."""
    index = GrayIndex(np.unique(words))
    label = np.arange(len(index.words))
    for at in range(0, len(label), block):
        for query, start, stop in index.search(at, min(at + block, len(label)), most):
            # a query joins all words of a node it takes, so they hang on the node's first word;
            # each node is spread out once, however many queries take it
            node, where = np.unique(start, return_index=True)
            n = stop[where] - node
            member = np.repeat(node, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            _join(label, np.repeat(node, n), member)
            _join(label, query, start)
    for_root = np.flatnonzero(label != np.arange(len(label)))
    return index.words[for_root], index.words[label[for_root]]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def link(words: DataFrame, most: int = 3, group_rows: int = 4096) -> DataFrame:
    """(node, root) of the components of the distinct ``fingerprint`` values of ``words``, for
    all but the smallest of a component; links join values that differ in at most ``most`` <= 3
    bits."""
    if not 0 <= most <= 3:
        raise ValueError("four blocks guarantee an equal one up to 3 differing bits")
    distinct = cut_lineage(words.select("fingerprint").distinct())
    bits = min(16, max(0, (distinct.count() // group_rows).bit_length()))
    f = F.col("fingerprint")

    def part(of, at: int, n: int):
        return F.shiftrightunsigned(of, at).bitwiseAND(F.lit((1 << n) - 1))

    def dealt(df: DataFrame, keys: list) -> DataFrame:
        return df.select(f, F.explode(F.array(*keys)).alias("key"))

    def struct(*xs):
        return F.struct(*[F.lit(x).cast("long").alias(n) if isinstance(x, int) else x.cast("long").alias(n) for x, n in zip(xs, "jvkw")])

    first = dealt(distinct, [struct(j, part(f, 16 * j + 16 - bits, bits), -1, 0) for j in range(4)])
    crowded = first.groupBy("key").count().where(F.col("count") > 8 * group_rows).select("key", F.lit(True).alias("crowded"))
    marked = first.join(crowded, "key", "left")
    calm = marked.where(F.col("crowded").isNull()).select("fingerprint", "key")
    whole = F.lit(None)
    inner = F.lit(None)
    for j in range(4):
        at = F.col("key.j") == j
        value = part(f, 16 * j, 16)
        # the other 48 bits, as one number
        rest = F.shiftrightunsigned(f, 16 * j + 16) if j < 3 else F.lit(0).cast("long")
        below = f.bitwiseAND(F.lit((1 << (16 * j)) - 1)) if j else F.lit(0).cast("long")
        other = F.shiftleft(rest, 16 * j).bitwiseOR(below)
        whole = F.when(at, value).otherwise(whole)
        inner = F.when(at, other).otherwise(inner)
    hot = (marked.where("crowded").select("fingerprint", F.col("key.j").alias("j"), whole.alias("v"), inner.alias("o"))
           .select("fingerprint", F.explode(F.array(*[
               F.struct(F.col("j"), F.col("v"), F.lit(k).cast("long").alias("k"), part(F.col("o"), 12 * k, 12).alias("w")) for k in range(4)])).alias("key")))
    groups = calm.unionByName(hot).select("fingerprint", F.xxhash64("key").alias("group"))

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        node, root = local_forest(group["fingerprint"].to_numpy().view(np.uint64), most)
        return pd.DataFrame({"a": node.view(np.int64), "b": root.view(np.int64)})

    return connected_components(groups.groupBy("group").applyInPandas(forest, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3, seed: int = 42, text: str = "text",
                    group_rows: int = 4096) -> DataFrame:
    """doc_id, fingerprint (long), component_id for every row of ``docs``.

    Fingerprints link at ``most`` or fewer differing bits; component_id is the smallest doc_id
    that links reach. Rows with equal fingerprints are one class from the start, so copies never
    make pairs. A null text has fingerprint 0, linked like any other; null ids never name a
    component unless all its ids are null. An empty table gives no rows.
    """
    rows = cut_lineage(fingerprints(docs, width, seed, text))
    names, classes = _components(rows, most, group_rows)
    return rows.join(classes.join(names, "root").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def _components(rows: DataFrame, most: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """(root, component_id, its text's hash) and (fingerprint, root)."""
    roots = link(rows, most, group_rows).withColumnRenamed("node", "fingerprint")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")  # null ids come last
    classes = rows.groupBy("fingerprint").agg(F.min(first).alias("first")).join(roots, "fingerprint", "left")
    classes = classes.withColumn("root", F.coalesce("root", "fingerprint"))
    names = classes.groupBy("root").agg(F.min("first").alias("first"))
    return names.select("root", F.col("first.doc_id").alias("component_id"), F.col("first.hash").alias("hash")), classes.select("fingerprint", "root")


def one_of_each(docs: DataFrame, width: int = 3, most: int = 3, seed: int = 42, text: str = "text",
                group_rows: int = 4096) -> DataFrame:
    """The rows of ``docs`` that name their component: one row of each group of near
    duplicates stays, the one with the smallest id (of null ids only: with the smallest text
    hash). Of rows that repeat id and text one stays. Texts are shuffled once."""
    rows = cut_lineage(fingerprints(docs, width, seed, text))
    kept = _components(rows, most, group_rows)[0].select(F.col("component_id").alias("_kept_id"), F.col("hash").alias("_kept_hash"))
    marked = docs.withColumns({"_own_id": F.col("doc_id").cast("long"), "_own_hash": F.xxhash64(text)})
    found = marked.join(kept, marked["_own_id"].eqNullSafe(kept["_kept_id"]) & (marked["_own_hash"] == kept["_kept_hash"]), "left_semi")
    return found.dropDuplicates(["_own_id", "_own_hash"]).drop("_own_id", "_own_hash")
