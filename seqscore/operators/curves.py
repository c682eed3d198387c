"""Curves of a distribution: smoothed density (A29) and quantiles against the normal law."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqscore.functions.normal import inverse_normal
from seqscore.operators.models import row_numbers


def smoothed_density(hist: DataFrame, value: str, weight: str, group: list[str] | None = None, points: int = 200, cut: float = 0.0,
                     factor: float | None = None) -> DataFrame:
    """Gaussian kernel density of a histogram (``value``, ``weight`` rows) on ``points`` even
    steps from the least to the greatest value, ``cut`` bandwidths beyond: (group..., x, density).

    The bandwidth is the sample deviation times ``factor``, or Scott's n ** (-1/5). A group of one
    value or one row has no bandwidth and no rows. The kernel sum is over distinct values, not rows,
    so work is values times points and a hot value costs what any does."""
    g = group or []
    h = hist.where(F.col(value).isNotNull()).select(*g, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w"))
    h = h.groupBy(*g, "_v").agg(F.sum("_w").alias("_w"))
    sums = h.groupBy(*g).agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum(F.col("_w") * F.col("_v") * F.col("_v")).alias("_q"),
                             F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / F.nullif(F.col("_n") - 1, F.lit(0.0))
    scale = F.lit(factor) if factor is not None else F.pow(F.col("_n"), F.lit(-0.2))
    grid = sums.withColumn("_bw", F.sqrt(var) * scale).where((F.col("_bw") > 0) & (F.col("_hi") > F.col("_lo")))
    step = (F.col("_hi") - F.col("_lo") + 2 * cut * F.col("_bw")) / F.lit(points - 1)
    grid = grid.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
        *g, "_n", "_bw", (F.col("_lo") - cut * F.col("_bw") + F.col("_i") * step).alias("x"))
    met = h.join(grid, g) if g else h.withColumn("_one", F.lit(1)).join(grid.withColumn("_one", F.lit(1)), "_one")
    z = (F.col("x") - F.col("_v")) / F.col("_bw")
    return met.groupBy(*g, "x", "_n", "_bw").agg(F.sum(F.col("_w") * F.exp(z * z * -0.5)).alias("_k")).select(
        *g, "x", (F.col("_k") / (F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def normal_quantiles(df: DataFrame, value: str, key: str) -> DataFrame:
    """Every row's ordered value beside the normal quantile of its place: (key, value, position =
    r / (n + 1), theoretical, standardised, line = mean + deviation * theoretical), with the
    deviation of the whole (not of a sample). Ties are placed by ``key``; null values take no part.
    Equal values have no standardised value."""
    v = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("value"))
    s = v.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).first()
    ranked = row_numbers(v.withColumn("_o", F.struct("value", key)), "_o", "_r").drop("_o")
    position = (F.col("_r") + 1) / F.lit(float(s["n"] + 1))
    mean, std = F.lit(s["mean"]).cast("double"), F.lit(s["std"]).cast("double")
    out = ranked.select(key, "value", position.alias("position")).withColumn("theoretical", inverse_normal(F.col("position")))
    return out.select(key, "value", "position", "theoretical", ((F.col("value") - mean) / F.nullif(std, F.lit(0.0))).alias("standardised"),
                      (mean + std * F.col("theoretical")).alias("line"))
