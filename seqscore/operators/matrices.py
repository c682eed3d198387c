"""Motifs as weight matrices (D16, D17): seeds, refinement, exact score law, scored sites.

A matrix is a table (group..., rank, motif, pos, letter, n, weight): ``n`` letters seen at each
place of the motif's sites and ``weight``, the log-odds against the background in thousandths of
a bit, rounded to whole numbers. Sums of weights are then exact in any order, ties are ties, and
the law of a site's score can be tabulated over whole scores.

Matrices have a row for each motif, place and letter, so they are small; ``held`` checks that
before a scan takes them to its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqscore.operators.motifs import fisher_upper

LETTERS = "ACGT"
MOST_CELLS = 1_000_000
PSEUDO = 1.0  # letters added to a place, spread as the background


def _weight(n: Column, total: Column, background: float) -> Column:
    odds = (n + PSEUDO * background) / ((total + PSEUDO) * background)
    return F.round(F.log2(odds) * 1000.0).cast("long")


def whole_weights(counts: np.ndarray, background: float = 0.25) -> np.ndarray:
    """Weights of places x letters counts, as ``_weight``."""
    odds = (counts + PSEUDO * background) / ((counts.sum(axis=1, keepdims=True) + PSEUDO) * background)
    return np.floor(np.abs(np.log2(odds) * 1000.0) + 0.5).astype(np.int64) * np.sign(np.log2(odds)).astype(np.int64)


def seed_matrices(seqs: DataFrame, seeds: DataFrame, mismatches: int = 1, group: list[str] | None = None,
                  col: str = "sequence") -> DataFrame:
    """Matrices of the ``seeds`` (group..., rank, motif): letters of every substring of the motif's
    length that differs from it in at most ``mismatches`` places. A seed that nothing comes near has
    no rows. Substrings are joined to the seeds by group and by one of ``mismatches`` + 1 parts that
    is the same, so a substring meets the seeds it may be near only."""
    g = group or []
    parts = mismatches + 1
    own = seeds.select(*g, "rank", "motif", F.length("motif").alias("w"))
    cut = lambda i, w: F.floor(w * F.lit(i) / F.lit(parts)).cast("int")
    key = lambda s, w: F.array(*[F.struct(F.lit(i).alias("part"), s.substr(cut(i, w) + 1, cut(i + 1, w) - cut(i, w)).alias("same")) for i in range(parts)])
    probe = own.select(*g, "rank", "motif", "w", F.inline(key(F.col("motif"), F.col("w"))))
    widths = [r[0] for r in own.select("w").distinct().collect()]
    n = F.length(col)
    sub = seqs.where(n >= min(widths, default=1)).select(*g, col, F.explode(F.array(*[F.lit(w) for w in widths] or [F.lit(1)])).alias("w"))
    sub = sub.where(n >= F.col("w")).select(*g, "w", F.explode(F.sequence(F.lit(1), n - F.col("w") + 1)).alias("i"), col)
    sub = sub.select(*g, "w", F.expr(f"substr({col}, i, w)").alias("site")).groupBy(*g, "w", "site").agg(F.count(F.lit(1)).alias("times"))
    met = sub.select(*g, "w", "site", "times", F.inline(key(F.col("site"), F.col("w")))).join(probe, [*g, "w", "part", "same"])
    near = met.select(*g, "rank", "motif", "w", "site", "times").distinct()
    place = near.select("*", F.posexplode(F.split("site", "")).alias("p", "letter")).where("letter <> ''")
    differ = F.sum(F.when(F.col("letter") != F.expr("substr(motif, p + 1, 1)"), 1).otherwise(0))
    sites = place.groupBy(*g, "rank", "motif", "site", "times").agg(differ.alias("differ")).where(F.col("differ") <= mismatches)
    letters = sites.select(*g, "rank", "motif", "times", F.posexplode(F.split("site", "")).alias("p", "letter"))
    seen = letters.groupBy(*g, "rank", "motif", (F.col("p") + 1).alias("pos")).agg(
        *[F.sum(F.when(F.col("letter") == x, F.col("times")).otherwise(0)).alias(x) for x in LETTERS], F.sum("times").alias("total"))
    cells = F.array(*[F.struct(F.lit(x).alias("letter"), F.col(x).alias("n")) for x in LETTERS])
    return seen.select(*g, "rank", "motif", "pos", "total", F.inline(cells)).select(
        *g, "rank", "motif", "pos", "letter", F.col("n").cast("double").alias("n"), _weight(F.col("n"), F.col("total"), 0.25).alias("weight"))


def held(matrices: DataFrame, group: list[str]) -> dict:
    """(group value..., rank) -> (motif, counts, weights), on the driver; raises beyond
    ``MOST_CELLS`` cells."""
    if matrices.limit(MOST_CELLS + 1).count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of matrices: scan fewer groups at a time")
    rows = {}
    for r in matrices.collect():
        rows.setdefault((*[r[c] for c in group], r["rank"]), (r["motif"], {}))[1][r["pos"], r["letter"]] = (r["n"], r["weight"])
    out = {}
    for k, (motif, cells) in rows.items():
        places = max(p for p, _ in cells)
        grid = np.array([[cells.get((p, x), (0.0, 0)) for x in LETTERS] for p in range(1, places + 1)], float)
        out[k] = (motif, grid[:, :, 0], grid[:, :, 1].astype(np.int64))
    return out


def letter_numbers(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, lengths): A, C, G, T as 0 to 3, all else, and what lies beyond the end, as 4."""
    table = np.full(256, 4, np.uint8)
    table[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(4)
    raw = [s.encode("ascii", "replace") for s in seqs]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    width = int(sizes.max(initial=1))
    return table[np.frombuffer(b"".join(s.ljust(width, b"-") for s in raw), np.uint8)].reshape(-1, width), sizes


def best_sites(numbers: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first place, score) of the best site of every sequence long enough; the first of equal
    ones. Letters other than A, C, G, T weigh nothing.

    Every second place, starts are given up that can't reach the row's best any more: what they have
    and the most the places left can give is less than what another has and the least they give."""
    w = len(weights)
    full = np.concatenate((weights, np.zeros((w, 1), np.int64)), axis=1)
    most = np.append(np.cumsum(full.max(axis=1)[::-1])[::-1], 0)
    least = np.append(np.cumsum(full.min(axis=1)[::-1])[::-1], 0)
    n = np.maximum(sizes - w + 1, 0)
    row = np.repeat(np.arange(len(sizes)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    score = np.zeros(len(row), np.int64)
    for k in range(w):
        score += full[k][numbers[row, start + k]]
        if k % 2 and k + 1 < w and len(row):
            head = np.flatnonzero(np.diff(row, prepend=-1))
            sure = np.maximum.reduceat(score, head) + least[k + 1]
            alive = score + most[k + 1] >= np.repeat(sure, np.diff(np.append(head, len(row))))
            if alive.mean() < 0.8:
                row, start, score = row[alive], start[alive], score[alive]
    order = np.lexsort((start, -score, row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return row[first], start[first], score[first]


def score_law(weights: np.ndarray, background: tuple = (0.25,) * 4) -> tuple[np.ndarray, np.ndarray]:
    """(scores, chance of a site with this score or more) for random letters: the exact law, place by
    place, over the whole scores that occur."""
    scores, chance = np.zeros(1, np.int64), np.ones(1)
    for place in weights:
        total = (scores[:, None] + place[None, :]).ravel()
        scores, where = np.unique(total, return_inverse=True)
        chance = np.bincount(where, (chance[:, None] * np.asarray(background)[None, :]).ravel())
    return scores, np.cumsum(chance[::-1])[::-1]


def motif_sites(seqs: DataFrame, matrices: DataFrame, group: list[str] | None = None, col: str = "sequence",
                key: str = "seq_index") -> DataFrame:
    """For every motif of a sequence's group its best site: (group..., rank, motif, key,
    site_start, site_end, site_score, p_site). p_site is the chance of such a score at one random
    place. A sequence shorter than the motif has no site. One scan, nothing is shuffled."""
    g = group or []
    known = held(matrices, g)
    of_group: dict = {}
    for k, (motif, _, weights) in known.items():
        of_group.setdefault(k[:-1], []).append((k[-1], motif, weights, *score_law(weights)))
    types = {f.name: f.dataType.simpleString() for f in seqs.schema.fields}
    names = [*g, key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups = list(zip(*[table.column(c).to_pylist() for c in g])) if g else [()] * len(table)
            texts = table.column(col).to_pylist()
            for value in sorted(set(groups), key=repr):
                mine = [i for i, x in enumerate(groups) if x == value and texts[i] is not None]
                numbers, sizes = letter_numbers([texts[i] for i in mine])
                where = np.array(mine, np.int64)
                for rank, motif, weights, scores, chance in of_group.get(value, []):
                    row, start, score = best_sites(numbers, sizes, weights)
                    part = table.select(names).take(pa.array(where[row]))
                    at = np.searchsorted(scores, score)
                    p = chance[at.clip(max=len(chance) - 1)]
                    yield pa.RecordBatch.from_arrays([
                        *[part.column(c).combine_chunks() for c in names], pa.array(np.full(len(row), rank, np.int32)), pa.array([motif] * len(row), pa.string()),
                        pa.array(start + 1), pa.array(start + len(weights)), pa.array(score), pa.array(p)],
                        [*names, "rank", "motif", "site_start", "site_end", "site_score", "p_site"])

    ddl = ", ".join([*(f"{c} {types[c]}" for c in names), "rank int, motif string, site_start long, site_end long, site_score long, p_site double"])
    return seqs.select(*names, col).mapInArrow(scan, ddl)


def refine(seqs: DataFrame, matrices: DataFrame, rounds: int = 8, group: list[str] | None = None, col: str = "sequence") -> DataFrame:
    """Matrices after ``rounds`` of expectation-maximisation on ``seqs`` (each sequence has one site
    of the motif or none): same columns, with the letters expected at each place.

    A round is one scan: a task sums, over its sequences, the chance of each start times its
    letters; the sums, a row a task, motif and place, are added up by Spark, and the new matrices
    (as many cells as the old ones) go into the next scan."""
    g = group or []
    known = held(matrices, g)
    share = {k: 0.5 for k in known}
    kept = seqs.select(*g, col).where(F.col(col).isNotNull()).persist()
    fields = [*(f"g{i} string" for i in range(len(g))), "rank int", "pos int", *(f"{x} double" for x in LETTERS), "sites double", "rows double"]
    for _ in range(rounds):
        model = {}
        for k, (_, counts, _w) in known.items():
            letters = (counts + PSEUDO / 4) / (counts.sum(axis=1, keepdims=True) + PSEUDO)
            model.setdefault(tuple(map(str, k[:-1])), []).append((k[-1], np.log(letters * 4), share[k]))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict = {}
            for batch in batches:
                groups = list(zip(*[map(str, batch.column(i).to_pylist()) for i in range(len(g))])) if g else [()] * batch.num_rows
                texts = batch.column(len(g)).to_pylist()
                for value in set(groups):
                    numbers, sizes = letter_numbers([t for t, x in zip(texts, groups) if x == value])
                    for rank, logs, gamma in model.get(value, []):
                        _expected(numbers, sizes, logs, gamma, sums.setdefault((*value, rank), [np.zeros((len(logs), 4)), 0.0, 0.0]))
            rows = [(*k, p + 1, *letters, sites, rows) for k, (grid, sites, rows) in sums.items() for p, letters in enumerate(grid.tolist())]
            yield pa.RecordBatch.from_pylist([dict(zip((f.split()[0] for f in fields), r)) for r in rows], pa.schema(
                [(f.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]]) for f in fields]))

        sums = kept.mapInArrow(expect, ", ".join(fields)).groupBy(*[f.split()[0] for f in fields[:len(g)]], "rank", "pos").agg(
            *[F.sum(x).alias(x) for x in (*LETTERS, "sites", "rows")]).collect()  # as many rows as there are places
        fresh = {(*[r[f"g{i}"] for i in range(len(g))], r["rank"], r["pos"]): r for r in sums}
        for k, (motif, counts, _w) in known.items():
            rows = [fresh.get((*map(str, k[:-1]), k[-1], p + 1)) for p in range(len(counts))]
            if all(rows):
                grid = np.array([[r[x] for x in LETTERS] for r in rows])
                known[k] = (motif, grid, whole_weights(grid))
                share[k] = min(0.999, max(0.001, rows[0]["sites"] / max(rows[0]["rows"], 1.0)))
    kept.unpersist()
    types = {f.name: f.dataType.simpleString() for f in matrices.schema.fields}
    cells = [(*k[:-1], k[-1], motif, p + 1, x, float(counts[p, i]), int(weights[p, i]))
             for k, (motif, counts, weights) in known.items() for p in range(len(counts)) for i, x in enumerate(LETTERS)]
    ddl = ", ".join([*(f"{c} {types[c]}" for c in g), "rank int, motif string, pos int, letter string, n double, weight long"])
    return seqs.sparkSession.createDataFrame(cells, ddl)


def _expected(numbers: np.ndarray, sizes: np.ndarray, logs: np.ndarray, gamma: float, sums: list) -> None:
    """Adds the letters expected at each place, the sites and the sequences."""
    w = len(logs)
    fit = np.flatnonzero(sizes >= w)
    sums[2] += len(sizes)
    if not len(fit):
        return
    padded = np.concatenate((logs, np.zeros((w, 1))), axis=1)
    numbers, starts = numbers[fit], numbers.shape[1] - w + 1
    score = sum(padded[k][numbers[:, k:k + starts]] for k in range(w))
    n = (sizes[fit] - w + 1)[:, None]
    odds = np.where(np.arange(starts)[None, :] < n, np.exp(score), 0.0) * (gamma / n)
    chance = odds / (1.0 - gamma + odds.sum(axis=1, keepdims=True))
    sums[1] += chance.sum()
    for k in range(w):
        seen = numbers[:, k:k + starts]
        sums[0][k] += [chance[seen == x].sum() for x in range(4)]


def matrix_enrichment(sites: DataFrame, sizes: DataFrame, role: str = "role", chance: float = 1e-4, group: list[str] | None = None) -> DataFrame:
    """Significance of matrices: sequences of either role whose best site has p_site <= ``chance``,
    and the one-sided Fisher p of more of them in the foreground; E is p times the group's motifs.
    ``sites`` as of ``motif_sites`` with the role; ``sizes`` (group..., N_fg, N_bg)."""
    g = group or []
    hit = F.col("p_site") <= chance
    is_fg = F.col(role) == "fg"
    n = sites.groupBy(*g, "rank", "motif").agg(F.sum((hit & is_fg).cast("long")).alias("fg_n"), F.sum((hit & ~is_fg).cast("long")).alias("bg_n"))
    n = n.join(sizes, g)
    tested = n.groupBy(*g).agg(F.count(F.lit(1)).alias("tested"))

    def fisher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(float) for c in ("fg_n", "bg_n", "N_fg", "N_bg"))
            yield batch.append_column("p_value", pa.array(fisher_upper(a, a + b, x, x + y), pa.float64()))

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in n.schema.fields) + ", p_value double"
    return n.mapInArrow(fisher, ddl).join(tested, g).withColumn("E_value", F.col("p_value") * F.col("tested")).drop("tested")
