"""Score bands, band trials and cluster pairs.

Per cluster, the integer score histogram (scores 0..max_score) is a sufficient statistic
for the t, Mann-Whitney and Fligner-Killeen tests, so the row table is aggregated once
(partial aggregation, one shuffle) and everything after works on one row per cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqscore.session import cut_lineage, many_parts

CLS = "ClsID"
SCORE = "prediction_score"

# Reference trial plan: (low, high) once, then five fresh mid draws against high and low.
DEFAULT_TRIALS = [(1, "low", "high", 0)] + [(1 + i, "mid", "high", i) for i in range(1, 6)] + \
                 [(6 + i, "low", "mid", i) for i in range(1, 6)]


def cluster_histograms(df: DataFrame, value: str = SCORE, key: str = CLS, max_score: int = 24) -> DataFrame:
    """One row per cluster: n, sum, sumsq, mean, histogram ``h`` (array<bigint>, one bin per
    integer score), counts below each bin ``cb``, median ``med`` (NumPy convention) and
    the histogram of doubled absolute deviations from the median ``dev`` (2*max+1 bins).
    ``max_score`` is the number of prediction columns summed (24, or 27 with the baseline set
    kept); a score outside 0..max_score raises, null scores are not counted."""
    M = max_score
    checked = F.when(F.col(value).between(0, M), F.col(value)).otherwise(F.raise_error(F.concat(
        F.lit(f"score outside 0..{M}: "), F.col(value).cast("string"))).cast("int"))
    df = df.filter(F.col(value).isNotNull()).withColumn(value, checked)
    c = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    per = c.repartition(many_parts(df.sparkSession), key).groupBy(key).agg(  # few rows, much work on each
        F.map_from_entries(F.collect_list(F.struct(F.col(value).cast("int"), F.col("_c")))).alias("_m"),
        F.sum("_c").alias("n"), F.sum(F.col(value) * F.col("_c")).cast("double").alias("s"),
        F.sum(F.col(value) * F.col(value) * F.col("_c")).cast("double").alias("q"))
    per = per.withColumn("h", F.expr(f"transform(sequence(0, {M}), i -> coalesce(_m[i], 0L))"))
    per = per.withColumn("cum", F.expr(f"transform(sequence(0, {M}), i -> aggregate(slice(h, 1, i + 1), 0L, (a, x) -> a + x))"))
    per = per.withColumn("cb", F.expr(f"transform(sequence(0, {M}), i -> cum[i] - h[i])"))
    kth = lambda k: f"array_min(filter(sequence(0, {M}), v -> cum[v] >= {k}))"
    med = F.expr(f"case when n % 2 = 1 then cast({kth('(n + 1) div 2')} as double) "
                 f"else ({kth('n div 2')} + {kth('n div 2 + 1')}) / 2.0 end")
    per = per.withColumn("med", med)
    # |2 v - m| = d for v = (m + d) / 2 and (m - d) / 2; m is bound once, not worked out for every d
    per = per.withColumn("dev", F.expr(
        f"element_at(transform(array(cast(2 * med as int)), m -> transform(sequence(0, {2 * M}), d -> if((m + d) % 2 = 0, "
        f"coalesce(get(h, cast((m + d) div 2 as int)), 0L) + if(d > 0, coalesce(get(h, cast((m - d) div 2 as int)), 0L), 0L), 0L))), 1)"))
    # Fixed-width columns h0..hM / cb0..cbM: pair statistics become plain generated
    # arithmetic (whole-stage codegen) instead of interpreted array lambdas.
    flat = [F.col("h")[i].alias(f"h{i}") for i in range(M + 1)] + [F.col("cb")[i].alias(f"cb{i}") for i in range(M + 1)]
    return per.select(key, "n", "s", "q", (F.col("s") / F.col("n")).alias("mean"), "med", "dev", *flat)


def hist_columns(max_score: int = 24, fligner: bool = True) -> list[str]:
    """Per-cluster columns a pair needs from ``cluster_histograms`` (the deviation
    histogram only for the Fligner-Killeen test)."""
    cols = ["n", "s", "q"] + [f"h{i}" for i in range(max_score + 1)] + [f"cb{i}" for i in range(max_score + 1)]
    return cols + (["dev"] if fligner else [])


def band_of(mean: Column, low: float, high: float) -> Column:
    """F8: low (< low), high (> high), mid otherwise."""
    return F.when(mean < low, "low").when(mean > high, "high").otherwise("mid")


def mid_hash(key: Column, seed: Column | int) -> Column:
    """Repeatable draw order of a cluster for a seed (same md5 in DuckDB)."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(key.cast("string"), F.lit("|"), s.cast("string")))


def top_k_per_group(df: DataFrame, group: list[str], order: Column, k: int, buckets: int | None = None,
                    tiebreak: str = CLS) -> DataFrame:
    """The k smallest rows by ``order`` per group, in two rounds so that no task holds a
    whole group: top-k inside (group, hash bucket), then top-k of the survivors
    (at most k * buckets rows per group). There are four buckets for each shuffle partition,
    so their size follows the cluster's."""
    buckets = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_o", order).withColumn("_b", F.pmod(F.xxhash64(F.col(tiebreak)), F.lit(buckets)))
    w1 = Window.partitionBy(*group, "_b").orderBy("_o", tiebreak)
    d = d.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    w2 = Window.partitionBy(*group).orderBy("_o", tiebreak)
    d = d.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k)
    return d.drop("_o", "_b", "_r")


def cluster_bands(stats: DataFrame, low: float = 17, high: float = 21, nmid: int = 100,
                  seed: int = 0, mean: str = "mean", key: str = CLS) -> DataFrame:
    """Band per cluster and whether a mid cluster is in the seeded draw of ``nmid``."""
    b = stats.withColumn("band", band_of(F.col(mean), low, high))
    mids = b.filter(F.col("band") == "mid").orderBy(mid_hash(F.col(key), seed), key).limit(nmid).select(key, F.lit(True).alias("_s"))
    return b.join(mids, key, "left").withColumn(
        "drawn", F.when(F.col("band") == "mid", F.coalesce(F.col("_s"), F.lit(False))).otherwise(F.lit(True))).drop("_s")


def trial_members(hist: DataFrame, low: float = 17, high: float = 21, nmid: int = 100,
                  trials=DEFAULT_TRIALS, key: str = CLS) -> DataFrame:
    """(trial, cluster, side) for every trial; 'A'/'B' sides are the two bands. Mid
    clusters enter a trial through its own seeded top-``nmid`` draw. The trial list is a
    literal array filtered per cluster (no join)."""
    arr = F.array(*[F.struct(F.lit(t).alias("trial"), F.lit(a).alias("band_a"), F.lit(b).alias("band_b"),
                             F.lit(s).alias("seed")) for t, a, b, s in trials])
    h = cut_lineage(hist.withColumn("band", band_of(F.col("mean"), low, high)))  # read by both branches
    h = h.withColumn("_t", F.explode(F.filter(arr, lambda t: (t["band_a"] == F.col("band")) | (t["band_b"] == F.col("band")))))
    h = h.select("*", "_t.*").drop("_t")
    fixed = h.filter(F.col("band") != "mid")
    mid = top_k_per_group(h.filter(F.col("band") == "mid"), ["trial"], mid_hash(F.col(key), F.col("seed")), nmid)
    m = fixed.unionByName(mid)
    return m.withColumn("side", F.when(F.col("band") == F.col("band_a"), "A").otherwise("B"))


def _triangle_buckets(n_rows: int, target: int = 600) -> int:
    """About ``target`` members per bucket, i.e. ~target^2 pairs per join task; a member is
    copied once per bucket."""
    return max(1, math.ceil(n_rows / target))


def cluster_pairs(members: DataFrame, buckets: int | None = None, key: str = CLS,
                  carry: list[str] | None = None) -> DataFrame:
    """Every unordered pair (c1 < c2) of clusters inside each trial, with an
    ``inter`` flag for pairs across the two bands.

    Pairs are generated by a bucketed triangle join: members are hashed into B buckets
    and the (bi <= bj) bucket pairs become join keys, so one trial's n(n-1)/2 pairs are
    spread over B(B+1)/2 tasks instead of one. ``carry`` columns come along from both
    sides with suffixes 1 and 2."""
    carry = carry or []
    if buckets is None:
        buckets = _triangle_buckets(members.count())
    base = members.withColumn("_b", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))
    rng = F.sequence(F.lit(0), F.lit(buckets - 1))
    left = base.select("trial", "band_a", "band_b", F.col("_b").alias("_bi"),
                       F.explode(F.filter(rng, lambda j: j >= F.col("_b"))).alias("_bj"),
                       F.col(key).alias("_k1"), F.col("side").alias("_s1"),
                       *[F.col(c).alias(f"{c}1") for c in carry])
    right = base.select("trial", F.col("_b").alias("_bj"),
                        F.explode(F.filter(rng, lambda i: i <= F.col("_b"))).alias("_bi"),
                        F.col(key).alias("_k2"), F.col("side").alias("_s2"),
                        *[F.col(c).alias(f"{c}2") for c in carry])
    j = left.join(right, ["trial", "_bi", "_bj"])
    j = j.filter((F.col("_bi") < F.col("_bj")) | (F.col("_k1") < F.col("_k2")))
    swap = F.col("_k1") > F.col("_k2")
    cols = [F.col("trial"), F.col("band_a"), F.col("band_b"),
            F.when(swap, F.col("_k2")).otherwise(F.col("_k1")).alias("c1"),
            F.when(swap, F.col("_k1")).otherwise(F.col("_k2")).alias("c2"),
            (F.col("_s1") != F.col("_s2")).alias("inter")]
    for c in carry:
        cols.append(F.when(swap, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(f"{c}1"))
        cols.append(F.when(swap, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"{c}2"))
    # side of c1 / c2, to orient inter pairs as (band A id, band B id)
    cols.append(F.when(swap, F.col("_s2")).otherwise(F.col("_s1")).alias("side1"))
    return j.select(*cols)


def pair_counts(bands: DataFrame) -> DataFrame:
    """For the band pairs (low, mid), (mid, high), (low, high): a, b, a+b and the
    number of unordered pairs (a+b)(a+b-1)/2."""
    c = bands.groupBy().agg(*[F.sum((F.col("band") == b).cast("int")).cast("bigint").alias(b)
                              for b in ("low", "mid", "high")])
    rows = F.array(*[F.struct(F.lit(a).alias("band_a"), F.lit(b).alias("band_b"), F.col(a).alias("a"),
                              F.col(b).alias("b")) for a, b in (("low", "mid"), ("mid", "high"), ("low", "high"))])
    r = c.select(F.inline(rows))
    s = F.col("a") + F.col("b")
    return r.select("band_a", "band_b", "a", "b", s.alias("total"), (s * (s - 1) / 2).cast("bigint").alias("pairs"))
