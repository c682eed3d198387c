"""Motif discovery and motif reports.

Re-aimed motif search (the reference calls an external motif finder): for each width in
[wmin, wmax], the distinct k-mers of every sequence; foreground / background sequence
counts per k-mer (one partial aggregation); log-odds and the one-sided Fisher exact p
of enrichment; E = p x number of tested k-mers; then a greedy top-n selection that
skips k-mers overlapping an already selected motif. The greedy step is exact and
distributed: n rounds, each picking the best remaining k-mer per group (aggregation)
and dropping its overlaps (broadcast of one motif per group).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqscore.session import broadcast_if_small, cut_lineage

_lgam = np.frompyfunc(math.lgamma, 1, 1)


def _lchoose(n, k):
    return (_lgam(n + 1) - _lgam(k + 1) - _lgam(n - k + 1)).astype(float)


def fisher_upper(a: np.ndarray, K: np.ndarray, n_fg: np.ndarray, N: np.ndarray) -> np.ndarray:
    """P(X >= a) for X ~ Hypergeometric(N total, K successes, n_fg draws), elementwise.
    Terms are summed from a upward until they vanish (exact series, no truncation of
    non-negligible terms); rows with a at or below the mode use 1 - lower tail."""
    a, K, n_fg, N = (np.asarray(x, dtype=float) for x in (a, K, n_fg, N))
    hi = np.minimum(K, n_fg)
    lo = np.maximum(0.0, n_fg - (N - K))
    mode = np.floor((n_fg + 1) * (K + 1) / (N + 2))
    out = np.ones_like(a)
    lden = _lchoose(N, n_fg)

    upper = a > mode
    if upper.any():
        idx = np.flatnonzero(upper)
        tot = np.zeros(len(idx))
        x = a[idx].copy()
        act = np.ones(len(idx), dtype=bool)
        Ki, Ni, ni, hii, ld = K[idx], N[idx], n_fg[idx], hi[idx], lden[idx]
        while act.any():
            xs = x[act]
            t = np.exp(_lchoose(Ki[act], xs) + _lchoose(Ni[act] - Ki[act], ni[act] - xs) - ld[act])
            tot[act] += t
            x[act] = xs + 1
            done = (x[act] > hii[act]) | (t <= 1e-17 * tot[act])
            a_idx = np.flatnonzero(act)
            act[a_idx[done]] = False
        out[idx] = np.minimum(1.0, tot)
    lower = ~upper & (a > lo)
    if lower.any():
        idx = np.flatnonzero(lower)
        tot = np.zeros(len(idx))
        x = a[idx] - 1
        act = np.ones(len(idx), dtype=bool)
        Ki, Ni, ni, loi, ld = K[idx], N[idx], n_fg[idx], lo[idx], lden[idx]
        while act.any():
            xs = x[act]
            t = np.exp(_lchoose(Ki[act], xs) + _lchoose(Ni[act] - Ki[act], ni[act] - xs) - ld[act])
            tot[act] += t
            x[act] = xs - 1
            done = (x[act] < loi[act]) | (t <= 1e-17 * tot[act])
            a_idx = np.flatnonzero(act)
            act[a_idx[done]] = False
        out[idx] = np.clip(1.0 - tot, 0.0, 1.0)
    return out


@F.pandas_udf(T.DoubleType())
def _fisher_udf(a: pd.Series, K: pd.Series, n_fg: pd.Series, N: pd.Series) -> pd.Series:
    return pd.Series(fisher_upper(a.to_numpy(), K.to_numpy(), n_fg.to_numpy(), N.to_numpy()))


def suffixes(seqs: DataFrame, wmin: int, wmax: int, group: list[str], role: str, col: str = "sequence") -> DataFrame:
    """(group..., suffix, least, fg, bg): what follows each place of a sequence, up to ``wmax`` letters, with
    the number of foreground and background sequences. Its prefixes of ``least`` letters or more (at
    least ``wmin``) are the k-mers that occur at this place first in their sequence; an earlier
    occurrence of a k-mer means one of each of its prefixes, so one number says it for all widths."""
    n, is_fg = F.length(col), (F.col(role) == "fg").cast("long")
    e = seqs.filter(n >= wmin).select(*group, is_fg.alias("_fg"), col, F.explode(F.sequence(F.lit(1), n - wmin + 1)).alias("_i"))
    e = e.withColumn("suffix", F.expr(f"substr({col}, _i, {wmax})"))
    first = F.expr(f"instr({col}, substr(suffix, 1, {wmin})) = _i")
    later = F.expr(f"array_min(filter(sequence({wmin}, length(suffix)), w -> instr({col}, substr(suffix, 1, w)) = _i))")
    e = e.withColumn("least", F.when(first, F.lit(wmin)).otherwise(later)).filter(F.col("least").isNotNull())
    return e.groupBy(*group, "suffix", "least").agg(F.sum("_fg").alias("fg"), F.sum(1 - F.col("_fg")).alias("bg"))


def _counted(texts: pa.Array, least: np.ndarray, fg: np.ndarray, bg: np.ndarray, wmin: int, wmax: int):
    """(row, width, fg, bg, open) of every prefix of ``wmin`` to ``wmax`` letters of sorted suffixes: the first
    row that has it, its counts, and whether it is one of the first or last row, so that other rows
    may have it too."""
    raw = texts.cast(pa.binary())
    starts = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64)
    data, sizes = np.frombuffer(raw.buffers()[2], np.uint8), np.diff(starts)
    place = np.arange(wmax)
    inside = place[None, :] < sizes[:, None]
    grid = np.where(inside, data[np.minimum(starts[:-1, None] + place[None, :], len(data) - 1)], 0)
    same = (grid[1:] == grid[:-1]) & inside[1:] & inside[:-1]
    common = np.where(same.all(axis=1), wmax, (~same).argmax(axis=1))  # letters that neighbours share
    for w in range(wmin, wmax + 1):
        rows = np.flatnonzero(sizes >= w)
        if not len(rows):
            continue
        joined = np.concatenate(([False], (common >= w)[rows[1:] - 1] & (np.diff(rows) == 1)))
        head = np.flatnonzero(~joined)
        counts = least[rows] <= w
        f, b = (np.add.reduceat(np.where(counts, v[rows], 0), head) for v in (fg, bg))
        ends = np.append(head[1:], len(rows)) - 1
        yield rows[head], w, f, b, (rows[head] == 0) | (rows[ends] == len(sizes) - 1)


def motif_counts(fg: DataFrame, bg: DataFrame, wmin: int = 8, wmax: int = 25, group: list[str] | None = None,
                 col: str = "sequence", key: str = "seq_index") -> DataFrame:
    """Per (group, k-mer): foreground / background sequence counts and set sizes."""
    tagged = fg.withColumn("_role", F.lit("fg")).unionByName(bg.withColumn("_role", F.lit("bg")))
    return motif_counts_tagged(tagged, "_role", wmin, wmax, group, col, key)


def motif_counts_tagged(seqs: DataFrame, role: str = "role", wmin: int = 8, wmax: int = 25, group: list[str] | None = None,
                        col: str = "sequence", key: str = "seq_index", least: int = 0) -> DataFrame:
    """``motif_counts`` over one table whose ``role`` column is 'fg' or 'bg'. Rows are made unique per
    (group, role, sequence).

    Every k-mer of a sequence is a prefix of what follows its first letter, so suffixes, not k-mers,
    are shuffled and sorted; in sorted order the suffixes with a prefix are neighbours, and a batch
    counts the prefixes of each width. Prefixes at a batch's borders, some widths a batch, are added up
    after. With ``least``, k-mers of fewer foreground sequences are left out before they are rows, and
    ``tested`` says how many k-mers the group has in all."""
    g = group or []
    s = cut_lineage(seqs.select(*g, role, key, col).dropDuplicates([*g, role, key]))
    is_fg = (F.col(role) == "fg").cast("long")
    sizes = s.groupBy(*g).agg(F.sum(is_fg).alias("N_fg"), F.sum(1 - is_fg).alias("N_bg"))
    rows = suffixes(s, wmin, wmax, g, role, col).repartitionByRange(*g, "suffix").sortWithinPartitions(*g, "suffix")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.zeros(batch.num_rows, np.int64)
            for c in g:  # rows of a group are neighbours
                codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                of[1:] |= codes[1:] != codes[:-1]
            edges = [0, *np.flatnonzero(of).tolist(), batch.num_rows]
            for at, to in zip(edges, edges[1:]):
                part = batch.slice(at, to - at)
                if not part.num_rows:
                    continue
                col_of = lambda c: part.column(c).to_numpy()
                found, total = [], 0
                for first, w, f, b, open_ in _counted(part.column("suffix"), col_of("least"), col_of("fg"), col_of("bg"), wmin, wmax):
                    kept = open_ | (f >= least) if least else np.ones(len(f), bool)
                    total += int((~open_).sum())
                    found.append((first[kept], np.full(int(kept.sum()), w), f[kept], b[kept], open_[kept]))
                first, width, f, b, open_ = (np.concatenate(x) for x in zip(*found))
                kmers = pa.concat_arrays([pa.array([], pa.string()), *[pc.utf8_slice_codeunits(part.column("suffix").take(pa.array(x[0])), 0, int(x[1][0])) for x in found if len(x[0])]])
                own = [part.column(c).take(pa.array(np.append(first, 0))) for c in g]
                yield pa.RecordBatch.from_arrays([*own, pa.concat_arrays([kmers, pa.array([None], pa.string())]), pa.array(np.append(f, 0)), pa.array(np.append(b, 0)),
                                                  pa.array(np.append(open_, False)), pa.array(np.append(np.zeros(len(f), np.int64), total))],
                                                 [*g, "kmer", "fg_n", "bg_n", "open", "tested"])

    ddl = ", ".join([*(f"{c} {types[c]}" for c in g), "kmer string, fg_n long, bg_n long, open boolean, tested long"])
    found = cut_lineage(rows.mapInArrow(count, ddl))
    border = found.where("open").groupBy(*g, "kmer").agg(F.sum("fg_n").alias("fg_n"), F.sum("bg_n").alias("bg_n"))
    c = found.where("not open and kmer is not null").select(*g, "kmer", "fg_n", "bg_n").unionByName(border.where(F.col("fg_n") >= least))
    if least:
        more = border.select(*g, F.lit(1).cast("long").alias("tested")).unionByName(found.where("kmer is null").select(*g, "tested"))
        tested = more.groupBy(*g).agg(F.sum("tested").alias("tested"))
        sizes = sizes.join(tested, g) if g else sizes.crossJoin(tested)
    if g:
        return c.join(broadcast_if_small(sizes), g)  # one row per group
    row = sizes.first().asDict()
    return c.withColumns({k: F.lit(v) for k, v in row.items()})


def enrichment(counts: DataFrame, group: list[str] | None = None, min_fg: int = 2) -> DataFrame:
    """Log-odds (0.5 pseudo-counts), one-sided Fisher p and E-value per k-mer. ``counts`` are of all
    k-mers, or have their number in ``tested``."""
    g = group or []
    c = counts.filter(F.col("fg_n") >= min_fg)
    lo = F.log((F.col("fg_n") + 0.5) / (F.col("N_fg") + 1.0)) - F.log((F.col("bg_n") + 0.5) / (F.col("N_bg") + 1.0))
    c = c.withColumn("log_odds", lo).filter(F.col("log_odds") > 0)
    c = c.withColumn("p_value", _fisher_udf(F.col("fg_n"), F.col("fg_n") + F.col("bg_n"), F.col("N_fg"),
                                            F.col("N_fg") + F.col("N_bg")))
    if "tested" in counts.columns:
        c = c.withColumnRenamed("tested", "_tested")
    elif g:
        tested = counts.groupBy(*g).agg(F.count(F.lit(1)).alias("_tested"))
        c = c.join(broadcast_if_small(tested), g)  # one row per group
    else:
        c = c.withColumn("_tested", F.lit(counts.count()))
    return c.withColumn("E_value", F.col("p_value") * F.col("_tested")).drop("_tested")


def _overlaps() -> "F.Column":
    """Candidate ``kmer`` overlaps selected ``_sel``: one contains the other, or (equal
    widths) they overlap by all but one letter."""
    same = F.length("kmer") == F.length("_sel")
    shift = (F.expr("substr(kmer, 2)") == F.expr("substr(_sel, 1, length(_sel) - 1)")) | \
            (F.expr("substr(_sel, 2)") == F.expr("substr(kmer, 1, length(kmer) - 1)"))
    return F.col("kmer").contains(F.col("_sel")) | F.col("_sel").contains(F.col("kmer")) | (same & shift)


def select_motifs(enriched: DataFrame, n: int = 10, group: list[str] | None = None, short: int = 2000) -> DataFrame:
    """Greedy top-n: repeatedly take the best remaining k-mer per group (lowest p, then
    highest log-odds, then the k-mer itself) and drop every candidate overlapping it.

    A group's picks are first sought among its candidates of lowest p, some ``short`` of them (a
    sketch of p says where to cut; ties stay together). What comes before the cut comes first in the
    order, so ``n`` picks found there are those of all candidates; a group that has fewer and has more
    candidates is searched as a whole."""
    g = group or []
    gg = g if g else ["_g"]
    cand = enriched if g else enriched.withColumn("_g", F.lit(1))
    cand = cut_lineage(cand.select(*gg, "kmer", "fg_n", "bg_n", "log_odds", "p_value", "E_value"))
    size = cand.groupBy(*gg).agg(F.count(F.lit(1)).alias("_all"))
    share = cand.groupBy(*gg).agg(F.percentile_approx("p_value", F.array(*[F.lit(10.0 ** -k) for k in range(9)]), F.lit(100_000)).alias("_cuts"))
    rank = F.least(F.lit(8), F.greatest(F.lit(0), F.floor(F.log10(F.col("_all") / F.lit(float(short)))))).cast("int")
    cut = broadcast_if_small(size.join(share, gg).select(*gg, "_all", F.col("_cuts")[rank].alias("_cut")))
    out = _greedy(cut_lineage(cand.join(cut, gg).where(F.col("p_value") <= F.col("_cut")).drop("_cut", "_all")), n, gg)
    done = out.groupBy(*gg).agg(F.count(F.lit(1)).alias("_picked"))
    below = cand.join(cut, gg).groupBy(*gg).agg(F.sum((F.col("p_value") <= F.col("_cut")).cast("long")).alias("_near"), F.first("_all").alias("_all"))
    rest = cut_lineage(below.where(F.col("_near") < F.col("_all")).join(done.where(F.col("_picked") >= n), gg, "left_anti").select(*gg))
    if not rest.isEmpty():
        whole = _greedy(cut_lineage(cand.join(broadcast_if_small(rest), gg, "left_semi")), n, gg)
        out = out.join(broadcast_if_small(rest), gg, "left_anti").unionByName(whole)
    out = out.withColumnRenamed("kmer", "motif").withColumn("width", F.length("motif"))
    return out if g else out.drop("_g")


def _greedy(cand: DataFrame, n: int, gg: list[str]) -> DataFrame:
    """The picks of ``select_motifs`` in rounds: (group..., rank, kmer, fg_n, bg_n, log_odds, p_value, E_value)."""
    picked = []
    for rank in range(1, n + 1):
        best = cand.groupBy(*gg).agg(F.min(F.struct("p_value", (-F.col("log_odds")).alias("nlo"), "kmer",
                                                     "fg_n", "bg_n", "log_odds", "E_value")).alias("b"))
        best = cut_lineage(best.select(*gg, F.lit(rank).alias("rank"), "b.kmer", "b.fg_n", "b.bg_n",
                                       "b.log_odds", "b.p_value", "b.E_value"))
        picked.append(best)
        groups = best.count()
        if not groups or rank == n:
            break
        sel = best.select(*gg, F.col("kmer").alias("_sel"))  # one row a group, already written
        cand = cand.join(F.broadcast(sel) if groups <= 200_000 else sel, gg, "left")
        cand = cut_lineage(cand.filter(F.col("_sel").isNull() | ~_overlaps()).drop("_sel"))
    out = picked[0]
    for p in picked[1:]:
        out = out.unionByName(p)
    return out


def enriched_motifs(fg: DataFrame, bg: DataFrame, wmin: int = 8, wmax: int = 25, n: int = 10,
                    group: list[str] | None = None) -> DataFrame:
    """Top-n enriched, non-overlapping motifs of the foreground against the control."""
    return enriched_motifs_tagged(fg.withColumn("_role", F.lit("fg")).unionByName(bg.withColumn("_role", F.lit("bg"))), "_role", wmin, wmax, n, group)


def enriched_motifs_tagged(seqs: DataFrame, role: str = "role", wmin: int = 8, wmax: int = 25, n: int = 10,
                           group: list[str] | None = None) -> DataFrame:
    """D16 over one role-tagged table (fg / bg rows)."""
    return select_motifs(enrichment(motif_counts_tagged(seqs, role, wmin, wmax, group, least=2), group), n, group)


def motif_hits(seqs: DataFrame, motifs: DataFrame, group: list[str] | None = None,
               col: str = "sequence", key: str = "seq_index") -> DataFrame:
    """D17 + W1: for every motif, the sequences it occurs in and its first position;
    site score = motif log-odds; per motif the best-scoring sites, ties kept.
    Sequences are matched through an equi-join on the k-mer of each motif width."""
    g = group or []
    widths = [r[0] for r in motifs.select("width").distinct().collect()]  # distinct motif widths (<= wmax)
    n = F.length(col)

    def windows(w: int):
        # the lambda has one parameter: a second one would be the index
        return F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.struct(i.alias("pos"), F.col(col).substr(i, F.lit(w)).alias("kmer")))

    none = F.expr("cast(array() as array<struct<pos:int,kmer:string>>)")
    pos = F.flatten(F.array(*[F.when(n >= w, windows(w)).otherwise(none) for w in widths])) if widths else none
    occ = seqs.select(*g, key, F.inline(pos)).filter(F.col("pos") >= 1)
    m = motifs.select(*g, F.col("motif").alias("kmer"), "rank", "log_odds")
    hits = occ.join(broadcast_if_small(m), [*g, "kmer"])  # n motifs per group
    first = hits.groupBy(*g, "kmer", "rank", key).agg(F.min("pos").alias("site_start"),
                                                      F.first("log_odds").alias("site_score"))
    first = first.withColumn("site_end", F.col("site_start") + F.length("kmer") - 1)
    return first.withColumnRenamed("kmer", "motif")


def min_eval_motif(motifs: DataFrame, group: list[str]) -> DataFrame:
    """The lowest-E motif(s) per group, ties kept."""
    w = Window.partitionBy(*group).orderBy("E_value")
    return motifs.withColumn("_r", F.rank().over(w)).filter(F.col("_r") == 1).drop("_r")


def motif_pivot(motifs: DataFrame, group: list[str], n: int = 5) -> DataFrame:
    """The 1st..n-th motif of each group as columns Motif_1..Motif_n (NULL when a
    group has fewer, Q22)."""
    return motifs.filter(F.col("rank") <= n).groupBy(*group).agg(
        *[F.max(F.when(F.col("rank") == i, F.col("motif"))).alias(f"Motif_{i}") for i in range(1, n + 1)])


def join_motif_reports(sequences: DataFrame, sites: DataFrame, summary: DataFrame) -> DataFrame:
    """Report sequences x sites on (motif_ID, motif, seq_ID), then x summary on
    (motif_ID, motif); each side first reduced to its best-scoring rows per motif (W1)."""
    s, t = _best_rows(sequences, "motif", "seq_Score"), _best_rows(sites, "motif", "site_Score")
    return s.join(t, ["motif_ID", "motif", "seq_ID"]).join(broadcast_if_small(summary), ["motif_ID", "motif"])


def _best_rows(df: DataFrame, group: str, score: str) -> DataFrame:
    """Distinct rows that reach their group's best score, ties kept; a group without scores keeps all. The
    best is an aggregate, so a group, of which there may be few, is never sorted in one task."""
    best = df.groupBy(F.col(group).alias("_g")).agg(F.max(score).alias("_best"))
    met = df.join(broadcast_if_small(best), F.col(group).eqNullSafe(F.col("_g")) & F.col(score).eqNullSafe(F.col("_best")), "left_semi")
    return met.dropDuplicates()
