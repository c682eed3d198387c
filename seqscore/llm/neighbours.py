"""Approximate nearest neighbours by an inverted multi-index, for the inner product.

Vectors are cut in halves, and each half has a codebook of its own; a vector lies in the cell
of its two nearest centroids. The inner product with a query is nearly the sum of the query
halves' products with the two centroids, so a heap over the two sorted lists of products
yields the pairs of centroids in falling order of that sum. A query visits cells in this
order until they hold enough entries, and those entries are ranked by the true product.

Equal vectors are one entry with its smallest ids. The entries of neighbouring first-half
centroids form a group; large groups are cut into chunks, and a query goes to each chunk of
the groups it visits, with one bit a cell. Chunks give their best entries, so nothing grows
with a group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqscore.llm.common import cut_lineage


def centroids(points: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k-means (squared distance) from random distinct points."""
    rng = np.random.default_rng(seed)
    found = np.unique(points, axis=0)
    found = found[np.sort(rng.permutation(len(found))[:k])]
    for _ in range(rounds):
        at = nearest(points, found)
        total = np.zeros_like(found)
        np.add.at(total, at, points)
        n = np.bincount(at, minlength=len(found))
        found = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], found)
    return found


def nearest(points: np.ndarray, found: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    for at in range(0, len(points), 8192):
        part = points[at:at + 8192]
        out[at:at + 8192] = ((found ** 2).sum(1) - 2 * part @ found.T).argmin(1)
    return out


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(second) + j) in falling order of first[i] + second[j], those without
    entries left out, until they hold ``enough`` entries."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y, a, b = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    heap, pushed, cells, held = [(-(x[0] + y[0]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        n = counts[a[i], b[j]]
        if n:
            cells.append(a[i] * len(b) + b[j])
            held += int(n)
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(x) and q < len(y) and (p, q) not in pushed:
                pushed.add((p, q))
                heapq.heappush(heap, (-(x[p] + y[q]), p, q))
    return cells


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, k: int = 20, every: int = 20, share: float = 0.3, least: int = 2000, sample: int = 20_000,
           chunk: int = 8192, codebook: int = 256, most_lengths: int = 64, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id is divisible
    by ``every``, among all rows but itself, by falling inner product (double), ties to the
    smaller id.

    Null, empty or zero vectors and those with null or non-finite components take no part, nor
    do rows without id. Vectors of several lengths have no product, so each length is a search
    of its own, one after another (``most_lengths`` of them; more raise). Codebooks of up to ``codebook``
    centroids are fitted on about ``sample`` distinct vectors; every vector is indexed. A query
    visits cells until they hold ``share`` of all distinct vectors, ``least`` at least: vectors
    without clusters need that much for a recall of 0.9. Rows that
    repeat an id and vector count once; an id with several vectors counts with each.
    """
    double = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_).cast("long").alias("id"), double.alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    sizes = sorted(r.n for r in rows.groupBy(F.size("v").alias("n")).count().limit(most_lengths + 1).collect())
    if len(sizes) > most_lengths:
        raise ValueError(f"vectors of more than {most_lengths} lengths")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for place, n in enumerate(sizes):
        found = _search_length(rows.where(F.size("v") == n) if len(sizes) > 1 else rows, n, k, every, share, least, sample, chunk, codebook)
        out = out.unionByName(found) if place else found
    return out


def _search_length(rows: DataFrame, length: int, k: int, every: int, share: float, least: int, sample: int, chunk: int, codebook: int) -> DataFrame:
    """``search`` among rows (id, v) of one length."""
    entries = cut_lineage(rows.groupBy("v").agg(F.min("id").alias("entry")))
    named = rows.join(entries, "v").select("id", "entry").distinct()
    # the k + 1 smallest ids of an entry, found within salted parts first
    salted = Window.partitionBy("entry", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    alone = Window.partitionBy("entry").orderBy("id")
    members = (named.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
               .withColumn("r", F.row_number().over(alone)).where(F.col("r") <= k + 1)
               .groupBy("entry").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    members = cut_lineage(members)
    asking = named.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), F.col("entry").alias("asked"))
    total = entries.count()
    rate = min(1.0, sample / total)
    fitted = entries.where(F.pmod(F.xxhash64(F.lit(1), "entry"), F.lit(1 << 20)) <= rate * (1 << 20)).select("v").toArrow()["v"].combine_chunks()
    points = matrix(fitted)
    half = max(1, length // 2)
    cells = max(1, min(codebook, total // 2))
    books = [centroids(points[:, :half], cells, seed=11)]
    books.append(centroids(points[:, half:], cells, seed=12) if half < length else np.zeros((1, 0)))
    wide = len(books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column(1))
            if len(m):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(m[:, :half], books[0])), pa.array(nearest(m[:, half:], books[1]))],
                                                 ["entry", "v", "a", "b"])

    indexed = cut_lineage(entries.select("entry", "v").mapInArrow(assign, "entry long, v array<double>, a long, b long"))
    counts = np.zeros((len(books[0]), wide), np.int64)
    for r in indexed.groupBy("a", "b").count().collect():  # at most codebook squared
        counts[r.a, r.b] = r["count"]
    enough = max(least, k + 1, int(share * total))
    near = -(-len(books[0]) // max(1, min(len(books[0]), total // chunk)))  # first-half centroids in a group
    groups = -(-len(books[0]) // near)
    chunks = np.array([max(1, -(-int(counts[g * near:(g + 1) * near].sum()) // chunk)) for g in range(groups)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column(1))
            x, y = m[:, :half] @ books[0].T, m[:, half:] @ books[1].T
            for at in range(0, len(m), 64):
                found: list[tuple] = []
                for row in range(at, min(at + 64, len(m))):
                    seen = np.zeros((groups * near, wide), bool)
                    seen.ravel()[visit(x[row], y[row], counts, enough)] = True
                    for g in range(groups):
                        mine = seen[g * near:(g + 1) * near]
                        if mine.any():
                            found += [(batch.column(0)[row].as_py(), m[row].tolist(), g, p, np.packbits(mine).tobytes()) for p in range(chunks[g])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (
                    pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.binary()))], ["asked", "v", "g", "part", "cells"])

    def rank(have: pa.Table, want: pa.Table) -> pa.Table:
        result = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if have.num_rows and want.num_rows:
            e, q = matrix(have["v"].combine_chunks()), matrix(want["v"].combine_chunks())
            ids, asked = have["entry"].to_numpy(), want["asked"].to_numpy()
            cell = have["a"].to_numpy() % near * wide + have["b"].to_numpy()
            parts = []
            for at in range(0, len(q), 512):
                bits = np.frombuffer(b"".join(want["cells"][at:at + 512].to_pylist()), np.uint8)
                open_ = np.unpackbits(bits.reshape(min(512, len(q) - at), -1), axis=1).astype(bool)
                score = np.where(open_[:, cell], q[at:at + 512] @ e.T, -np.inf)
                # all that reach the (k + 1)-th best of their row, ties and rounding included
                nth = min(k + 1, len(ids))
                bar = -np.partition(-score, nth - 1, axis=1)[:, nth - 1]
                row, col = np.nonzero((score >= bar[:, None] - 1e-9 * np.maximum(1, abs(np.where(np.isfinite(bar), bar, 0)))[:, None]) & np.isfinite(score))
                exact = np.einsum("ij,ij->i", q[at + row], e[col])
                order = np.lexsort((ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                first = np.searchsorted(row, row, "left")
                kept = np.arange(len(row)) - first <= k
                parts.append((asked[at + row[kept]], ids[col[kept]], exact[kept]))
            result = [np.concatenate(x) for x in zip(*parts)]
        return pa.table({"asked": pa.array(result[0], pa.int64()), "entry": pa.array(result[1], pa.int64()), "score": pa.array(result[2], pa.float64())})

    part = F.pmod(F.xxhash64("entry"), F.element_at(F.lit(chunks.tolist()), (F.col("g") + 1).cast("int")))
    have = indexed.withColumn("g", F.floor(F.col("a") / near).cast("long")).withColumn("part", part)
    want = (asking.select(F.col("asked").alias("entry")).distinct().join(entries, "entry").select("entry", "v")
            .repartition(max(1, -(-total // (64 * every))), "entry")  # walks over the heap cost more than their bytes tell
            .mapInArrow(ask, "asked long, v array<double>, g long, part long, cells binary"))
    found = have.groupBy("g", "part").cogroup(want.groupBy("g", "part")).applyInArrow(rank, "asked long, entry long, score double")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "entry")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    spread = top.join(members, "entry").select("asked", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    spread = spread.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = spread.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))  # k + 1 each
    answers = asking.join(lists, "asked").select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return answers.select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
