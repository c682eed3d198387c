"""Cluster membership, filters, joins and cluster statistics (S4 parse, F1-F8, J1-J9, J16,
A1-A15, A26-A27, O1-O3, W3-W4, W7).

Design notes for scale:
- every per-cluster statistic is a partial (map-side combined) aggregation, so a cluster
  holding a third of all rows costs one combiner entry per task, not one hot task;
- size filters are aggregate + left-semi join (AQE may turn the semi side into a
  broadcast at run time, or split a skewed partition), never a window over a hot key;
- leave-one-out statistics use totals minus own moments (no row x cluster product);
- global orderings over cluster ids use range partitioning + per-partition offsets
  (``dense_index``) instead of a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqscore.functions.sequence import gc_content, seqid_index
from seqscore.operators.ordered import cumulative_sum, global_quantiles, histogram_quantiles, ranged
from seqscore.session import cut_lineage

CLS = "ClsID"
SCORE = "prediction_score"


# ---------------------------------------------------------------- parsing and filters

def parse_membership(mem: DataFrame, shift: int = 1) -> DataFrame:
    """Add ``seq_index`` parsed from ``SeqID`` (``>gi|index|score``) minus ``shift``."""
    return mem.withColumn("seq_index", seqid_index("SeqID", shift))


def status_filter(df: DataFrame, keep=("C", "M")) -> DataFrame:
    """keep centre and member rows."""
    return df.filter(F.col("Status").isin(list(keep)))


def score_range(df: DataFrame, lo: int | None, hi: int | None, col: str = SCORE) -> DataFrame:
    """F2: inclusive score range (either bound may be open)."""
    c = F.col(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= lo)
    if hi is not None:
        cond = cond & (c <= hi)
    return df.filter(cond)


def cluster_sizes(df: DataFrame, key: str = CLS, distinct_col: str | None = None) -> DataFrame:
    """A1: rows (and optionally distinct values of ``distinct_col``) per cluster."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if distinct_col:
        aggs.append(F.countDistinct(distinct_col).alias("n_distinct"))
    return df.groupBy(key).agg(*aggs)


def size_filter(df: DataFrame, lim: int = 2, strict: bool = False, key: str = CLS,
                distinct_col: str | None = None) -> DataFrame:
    """keep rows of clusters with >= lim (``strict``: > lim) members.

    Sizes come from a partial aggregation; rows are kept by a left-semi join."""
    size = F.countDistinct(distinct_col) if distinct_col else F.count(F.lit(1))
    sizes = df.groupBy(key).agg(size.alias("_n"))
    keep = sizes.filter(F.col("_n") > lim if strict else F.col("_n") >= lim).select(key)
    return df.join(keep, key, "left_semi")


def band_column(mean: str | Column, low: float = 17, high: float = 21) -> Column:
    """F8: 'low' (mean < low), 'high' (mean > high), else 'mid'."""
    m = F.col(mean) if isinstance(mean, str) else mean
    return F.when(m < low, "low").when(m > high, "high").otherwise("mid")


# ---------------------------------------------------------------- joins

def join_membership(mem: DataFrame, scores: DataFrame, on: str = "seq_index") -> DataFrame:
    """Inner equi-join of membership and scores on the sequence index."""
    return mem.join(scores, on, "inner")


def cluster_scores(mem: DataFrame, scores: DataFrame, shift: int = 1,
                   keep=("C", "M")) -> DataFrame:
    """S4 -> J1 -> F1: membership rows with their score. The status filter is applied
    before the join so it prunes the shuffle input (and pushes into Parquet scans)."""
    m = status_filter(parse_membership(mem, shift), keep)
    return join_membership(m, scores)


# ---------------------------------------------------------------- aggregations

def cluster_stats(df: DataFrame, value: str = SCORE, key: str = CLS) -> DataFrame:
    """A2: mean, sample std (NULL for one member) and count per cluster."""
    return df.groupBy(key).agg(F.avg(value).alias("predictions_mean"),
                               F.stddev_samp(value).alias("predictions_std"),
                               F.count(F.lit(1)).alias("Count"))


def cluster_profile(df: DataFrame, key: str = CLS) -> DataFrame:
    """A3: min, mean, median, sample std, max of score and GC content per cluster.
    Medians are exact, from each cluster's value histogram (bounded-precision values),
    so a huge cluster is never buffered in one task."""
    aggs = []
    for c, p in ((SCORE, "predictions"), ("gc_content", "gc_content")):
        aggs += [F.min(c).cast("double").alias(f"{p}_min"), F.avg(c).alias(f"{p}_mean"),
                 F.stddev_samp(c).alias(f"{p}_std"), F.max(c).cast("double").alias(f"{p}_max")]
    aggs.append(F.count(F.lit(1)).alias("Count"))
    base = df.groupBy(key).agg(*aggs)
    m1 = histogram_quantiles(df, [key], SCORE, {"predictions_median": 0.5})
    m2 = histogram_quantiles(df, [key], "gc_content", {"gc_content_median": 0.5})
    out = base.join(m1, key).join(m2, key)
    cols = [key]
    for p in ("predictions", "gc_content"):
        cols += [f"{p}_min", f"{p}_mean", f"{p}_median", f"{p}_std", f"{p}_max"]
    return out.select(*cols, "Count")


def identity_sweep(tagged: DataFrame, lim: int = 2, key: str = CLS, perc: str = "Perc",
                   member: str = "seq_index") -> DataFrame:
    """A4 + P6: per identity threshold, total clusters and clusters below / at-or-above
    ``lim`` distinct members, with their percentages (rounded to 3, complement 100-x)."""
    if lim < 2:
        raise ValueError(f"lim must be 2 or more, not {lim}")
    per = tagged.groupBy(perc, key).agg(F.countDistinct(member).alias("_n"))
    out = per.groupBy(perc).agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.sum(F.when(F.col("_n") < lim, 1).otherwise(0)).cast("bigint").alias("n_small"),
        F.sum(F.when(F.col("_n") >= lim, 1).otherwise(0)).cast("bigint").alias("n_large"))
    return pct_columns(out, "n_small", "total_clusters", "pct_small", "pct_large")


def pct_columns(df: DataFrame, part: str, total: str, pct: str, complement_name: str) -> DataFrame:
    """100*part/total rounded to 3 decimals, and 100 minus it."""
    p = F.round(F.col(part) * 100.0 / F.col(total), 3)
    return df.withColumn(pct, p).withColumn(complement_name, F.lit(100.0) - F.col(pct))


def singleton_report(df: DataFrame, key: str = CLS) -> DataFrame:
    """A5: total / singleton / non-singleton clusters and the largest cluster."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.sum(F.when(F.col("_n") == 1, 1).otherwise(0)).cast("bigint").alias("singletons"),
        F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)).cast("bigint").alias("non_singletons"),
        F.max("_n").alias("largest_size"),
        F.min_by(key, F.struct(-F.col("_n"), F.col(key))).alias("largest_cluster"))


def in_out_std(df: DataFrame, cols=(SCORE, "gc_content"), key: str = CLS, min_size: int = 2) -> DataFrame:
    """Population std inside each cluster (>= ``min_size`` rows) and over all rows
    outside it, in one pass over the rows: per-cluster (n, mean, M2) are merged into
    global moments (Chan et al.) and the outside moments are the global ones minus the
    cluster's. The global moments are scalar subqueries over the per-cluster table."""
    aggs = [F.count(F.lit(1)).alias("Count")]
    for c in cols:
        aggs += [F.avg(c).alias(f"_m_{c}"), (F.var_pop(c) * F.count(F.lit(1))).alias(f"_M2_{c}")]
    per = df.groupBy(key).agg(*aggs)
    N = per.select(F.sum("Count").cast("double")).scalar()
    sel = [F.col(key)]
    n = F.col("Count").cast("double")
    n_out = N - n
    for c in cols:
        mean = per.select((F.sum(F.col("Count") * F.col(f"_m_{c}")) / F.sum("Count")).alias("x")).scalar()
        m2 = per.select(F.sum(F.col(f"_M2_{c}")).alias("a"), F.sum(F.col(f"_m_{c}") * F.col(f"_m_{c}") * F.col("Count")).alias("b"),
                        F.sum(F.col(f"_m_{c}") * F.col("Count")).alias("s"), F.sum("Count").alias("n")) \
            .select((F.col("a") + F.col("b") - F.col("s") * F.col("s") / F.col("n")).alias("x")).scalar()
        mc, m2c = F.col(f"_m_{c}"), F.col(f"_M2_{c}")
        mean_out = (N * mean - n * mc) / n_out
        delta = mc - mean_out
        m2_out = m2 - m2c - delta * delta * n * n_out / N
        name = "predictions" if c == SCORE else c
        sel += [F.sqrt(F.greatest(m2c / n, F.lit(0.0))).alias(f"{name}_std"),
                F.when(n_out > 0, F.sqrt(F.greatest(m2_out / n_out, F.lit(0.0)))).alias(f"{name}_std_out")]
    sel.append(F.col("Count"))
    return per.filter(F.col("Count") >= min_size).select(*sel)


def score_histogram(df: DataFrame, col: str = SCORE) -> DataFrame:
    """Frequency per integer score."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("frequency"))


def binned_histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """``bins`` equal-width bins between min and max, the last bin right-closed.

    Two passes: a one-row min/max aggregate, then a partial aggregation by bin."""
    mm = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    if mm["lo"] is None:  # no values: no bins
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, frequency long")
    lo, hi = float(mm["lo"]), float(mm["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.floor((F.col(col).cast("double") - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo if hi > lo else 1.0))
    b = F.least(b, F.lit(bins - 1)).cast("int")
    out = df.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("frequency"))
    return out.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"), "frequency")


def clusters_per_score(df: DataFrame, lim: int = 10, key: str = CLS,
                       member: str = "sequence") -> DataFrame:
    """Distinct clusters per score over clusters with >= 1, >= lim and < lim
    distinct members. One pass of conditional distinct counts after a size aggregate;
    the '<lim' count is filled with 0 where absent, '>=lim' stays NULL (reference)."""
    sizes = df.groupBy(key).agg(F.countDistinct(member).alias("_n"))
    j = df.select(SCORE, key).join(sizes, key)
    out = j.groupBy(SCORE).agg(
        F.countDistinct(key).alias("clusters_ge1"),
        F.countDistinct(F.when(F.col("_n") >= lim, F.col(key))).alias("clusters_ge_lim"),
        F.countDistinct(F.when(F.col("_n") < lim, F.col(key))).alias("clusters_lt_lim"))
    return out.withColumn("clusters_ge_lim", F.when(F.col("clusters_ge_lim") > 0, F.col("clusters_ge_lim")))


def sequences_per_score(df: DataFrame, lim: int = 10, key: str = CLS) -> DataFrame:
    """A10: distinct sequences per score over clusters with >= lim distinct sequences."""
    kept = size_filter(df, lim, key=key, distinct_col="sequence")
    return kept.groupBy(SCORE).agg(F.countDistinct("sequence").alias("n_sequences"))


def gc_by_score(df: DataFrame) -> DataFrame:
    """GC distribution per score: min, quartiles (exact, linear, from the GC value
    histogram of each score), max, count."""
    base = df.groupBy(SCORE).agg(F.min("gc_content").alias("gc_min"), F.max("gc_content").alias("gc_max"),
                                 F.count(F.lit(1)).alias("n"))
    q = histogram_quantiles(df, [SCORE], "gc_content", {"gc_q1": 0.25, "gc_median": 0.5, "gc_q3": 0.75})
    return base.join(q, SCORE).select(SCORE, "gc_min", "gc_q1", "gc_median", "gc_q3", "gc_max", "n")


def quantile_cuts(stats: DataFrame, lo: float = 0.09, hi: float = 0.9,
                  col: str = "predictions_mean") -> DataFrame:
    """Exact linear quantiles of cluster means (distributed ranks), floored / ceiled
    into band limits."""
    q = global_quantiles(stats, col, {"q_low": lo, "q_high": hi})
    return q.select("q_low", "q_high", F.floor("q_low").cast("int").alias("low"),
                    F.ceil("q_high").cast("int").alias("high"))


def multi_membership(df: DataFrame, key: str = CLS, member: str = "seq_index") -> DataFrame:
    """Clusters per sequence, reported as min and max over sequences."""
    per = df.groupBy(member).agg(F.countDistinct(key).alias("_c"))
    return per.agg(F.min("_c").alias("min_clusters"), F.max("_c").alias("max_clusters"))


def minmax_profile(df: DataFrame, cols) -> DataFrame:
    """Min / max of several columns in one pass."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(*aggs)


def pair_count(a: Column, b: Column) -> tuple[Column, Column]:
    """a+b and (a+b)(a+b-1)/2 pairs."""
    s = a + b
    return s, (s * (s - 1) / 2).cast("bigint")


# ---------------------------------------------------------------- ordering

def top_clusters(df: DataFrame, n: int = 20, lim: int = 10, key: str = CLS,
                 member: str = "sequence") -> DataFrame:
    """O1 + U6 + J5: clusters with >= lim distinct members, the ``n`` largest of them
    (ties by id), then their member rows. The top-n list is bounded by ``n``, so the
    final semi join broadcasts it."""
    sizes = df.groupBy(key).agg(F.countDistinct(member).alias("_n")).filter(F.col("_n") >= lim)
    top = sizes.orderBy(F.desc("_n"), F.asc(key)).limit(n).select(key)
    return df.join(F.broadcast(top), key, "left_semi")


def dense_index(values: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """Dense 1-based rank of the distinct values of ``col`` without a single-partition
    window: frozen range partitions, row numbers inside each, per-partition offsets (a table
    with one row per partition, broadcast)."""
    d = ranged(values.select(col).distinct(), F.col(col))
    d = d.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(col)))
    cnt = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offs = cnt.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.join(F.broadcast(offs.select("_pid", "_off")), "_pid") \
        .select(col, (F.col("_off") + F.col("_local")).cast("bigint").alias(name))


def label_slice(df: DataFrame, start: int, end: int, key: str = CLS) -> DataFrame:
    """Rows of the clusters at positions [start, end) of the sorted id list."""
    ranks = dense_index(df, key, "_r")
    keep = ranks.filter((F.col("_r") > start) & (F.col("_r") <= end)).select(key)
    return df.join(keep, key, "left_semi")


def overlapping_chunks(spark, n: int, num_chunks: int = 4, overlap: float = 0.3) -> DataFrame:
    """(chunk, start, end) windows over n sorted labels, adjacent ones overlapping by
    ``overlap`` of a chunk; the last chunk runs to n; ``end`` is exclusive + 1 as in the
    reference. A ``num_chunks``-row table built by ``range``."""
    size = n // num_chunks
    ov = int(size * overlap)
    c = F.col("id")
    return spark.range(num_chunks).select(
        (c + 1).cast("int").alias("chunk"),
        (c * (size - ov)).cast("bigint").alias("start"),
        (F.when(c == num_chunks - 1, F.lit(n)).otherwise((c + 1) * size) + 1).cast("bigint").alias("end"))


def chunk_labels(df: DataFrame, chunks: DataFrame, key: str = CLS) -> DataFrame:
    """W4 applied: each cluster id tagged with every chunk whose [start, end) covers its
    0-based position. The chunk table is ``num_chunks`` rows (broadcast range join)."""
    ranks = dense_index(df, key, "_r").withColumn("_pos", F.col("_r") - 1)
    cond = (F.col("_pos") >= F.col("start")) & (F.col("_pos") < F.col("end"))
    return ranks.join(F.broadcast(chunks), cond).select("chunk", key, "_pos")


def density_groups(df: DataFrame, col: str = SCORE, eps: float = 10, min_size: int = 20) -> DataFrame:
    """1-D density grouping of a bounded-precision column: over its distinct values in
    order, a gap > ``eps`` starts a new group; groups with fewer than ``min_size`` rows are
    noise (-1). Works on the value histogram (one row per distinct value)."""
    h = ranged(df.groupBy(col).agg(F.count(F.lit(1)).alias("n")), F.col(col))
    ends = h.groupBy("_pid").agg(F.max(col).alias("_end"))  # one row a partition
    before = ends.select("_pid", F.max("_end").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    last = F.coalesce(F.lag(col).over(Window.partitionBy("_pid").orderBy(col)), F.col("_before"))
    h = h.join(before, "_pid").withColumn("_gap", F.when(F.col(col) - last > eps, 1).otherwise(0)).drop("_pid", "_before")
    h = cut_lineage(cumulative_sum(h, [], [col], ["_gap"], ["_g"]))
    sizes = h.groupBy("_g").agg(F.sum("n").alias("_gn"))
    return h.join(sizes, "_g").select(col, "n", F.when(F.col("_gn") >= min_size, F.col("_g")).otherwise(-1).cast("int").alias("group"))


def with_gc(df: DataFrame, col: str = "sequence") -> DataFrame:
    return df.withColumn("gc_content", gc_content(col))
