"""Shared Spark inputs of the registered queries (mirrors the oracle's v_* views)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqscore.functions.sequence import gc_content
from seqscore.operators import clusters as C
from seqscore.sources import fixtures as X


def gc_table(spark: SparkSession, d: str) -> DataFrame:
    """v_gc: seq_index, sequence, gc_content."""
    return X.library(spark, d).select("seq_index", "sequence", gc_content("sequence").alias("gc_content"))


def cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    """v_cs: membership (C/M) x scores x library. Three inputs on one key: a single
    hash partitioning on ``seq_index`` serves both joins."""
    cs = C.cluster_scores(X.membership(spark, d), X.scores(spark, d))
    return cs.join(gc_table(spark, d), "seq_index").select(
        "ClsID", "seq_index", "Status", "Score", "prediction_score", "sequence", "gc_content")


def dedup_scores(spark: SparkSession, d: str) -> DataFrame:
    """v_dedup: distinct (sequence, gc_content, prediction_score)."""
    return gc_table(spark, d).join(X.scores(spark, d), "seq_index") \
        .select("sequence", "gc_content", "prediction_score").distinct()


def big_cluster_scores(spark: SparkSession, d: str, lim: int = 2) -> DataFrame:
    return C.size_filter(cluster_scores(spark, d), lim)


def stats(spark: SparkSession, d: str) -> DataFrame:
    """v_stats: A2 over clusters with >= 2 members: one join, one aggregation, and the size
    filter on the count that it gives."""
    return C.cluster_stats(C.cluster_scores(X.membership(spark, d), X.scores(spark, d))).filter("Count >= 2")


def eval_table(spark: SparkSession, d: str) -> DataFrame:
    """v_eval: long predictions with the test set and true label of each row."""
    return X.pred_long(spark, d, beside=X.labels(spark, d))


def sweep_membership(spark: SparkSession, d: str) -> DataFrame:
    """Membership at three identity thresholds: 80 (as given), 70 and 60 (ids merged
    pairwise / four-wise), tagged ``Perc``. Generated per row, no union."""
    m = C.parse_membership(X.membership(spark, d))
    grid = F.array(*[F.struct(F.lit(p).alias("Perc"), F.lit(div).alias("div")) for p, div in ((80, 1), (70, 2), (60, 4))])
    m = m.select("ClsID", "seq_index", F.inline(grid))
    return m.select("Perc", F.floor(F.col("ClsID") / F.col("div")).cast("bigint").alias("ClsID"), "seq_index")
