"""Order statistics without single-task groups.

- ``cumulative_sum``: running sums in (group, order) via range partitioning, local
  window sums inside each partition and per-(partition, group) offsets;
- ``histogram_quantiles``: exact linear-interpolation quantiles (``percentile`` /
  ``quantile_cont`` semantics) of a bounded-precision column from its value histogram,
  so a group's values are never buffered in one task;
- ``global_quantiles``: exact quantiles of an arbitrary column from distributed ranks.

Offsets are joined to rows by partition number. Two plans that range-partition the same rows
may sample and coalesce differently, so the rows are frozen with their partition number
(``ranged``) before any of them is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqscore.session import cut_lineage


def ranged(df: DataFrame, *by: Column) -> DataFrame:
    """``df`` range-partitioned by ``by``, with the partition number ``_pid``, written once to
    the shared checkpoint folder: every reader sees the same partition for a row."""
    return cut_lineage(df.repartitionByRange(*by).withColumn("_pid", F.spark_partition_id()))


def cumulative_sum(df: DataFrame, group: list[str], order: list[str], values: list[str], outs: list[str],
                   inclusive: bool = True, descending: bool = False) -> DataFrame:
    """``outs[i]`` = sum of ``values[i]`` over the rows of the same group that come before
    (and, if ``inclusive``, at) each row in ``order``. Rows are expected unique per
    (group, order), e.g. a histogram over distinct scores."""
    ordc = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    d = ranged(df, *[F.col(g) for g in group], *ordc)
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    wl = Window.partitionBy("_pid", *group).orderBy(*ordc).rowsBetween(*frame)
    for v, o in zip(values, outs):
        d = d.withColumn(f"_loc_{o}", F.coalesce(F.sum(v).over(wl), F.lit(0)))
    tot = d.groupBy("_pid", *group).agg(*[F.sum(v).alias(f"_t_{o}") for v, o in zip(values, outs)])
    wo = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    for o in outs:
        tot = tot.withColumn(f"_off_{o}", F.coalesce(F.sum(f"_t_{o}").over(wo), F.lit(0)))
    d = d.join(tot.select("_pid", *group, *[f"_off_{o}" for o in outs]), ["_pid", *group])
    for o in outs:
        d = d.withColumn(o, F.col(f"_off_{o}") + F.col(f"_loc_{o}")).drop(f"_off_{o}", f"_loc_{o}")
    return d.drop("_pid")


def histogram_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group, interpolated between order statistics at (n-1)p, from
    the (group, value) histogram: the window runs over one row per distinct value."""
    h = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("_start", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    n = h.groupBy(*group).agg(F.sum("_c").alias("_n"))
    h = h.join(n, group)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.max(F.when(F.col("_start") <= lo, F.col(value))).alias(f"_lo_{name}"),
                 F.max(F.when(F.col("_start") <= hi, F.col(value))).alias(f"_hi_{name}"),
                 F.first(pos - lo).alias(f"_f_{name}")]
    a = h.groupBy(*group).agg(*aggs)
    sel = [F.col(g) for g in group]
    for name in probs:
        lo_v, hi_v, f = (F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double"),
                         F.col(f"_f_{name}"))
        sel.append(F.when(f == 0, lo_v).otherwise((F.lit(1.0) - f) * lo_v + f * hi_v).alias(name))
    return a.select(*sel)


def global_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of one column over all rows: one count, distributed ranks, and only
    the rows at the needed ranks are kept (a one-row result)."""
    from seqscore.operators.models import row_numbers
    v = df.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    n = v.count()
    if n == 0:
        return df.sparkSession.createDataFrame([tuple(None for _ in probs)],
                                               ", ".join(f"{k} double" for k in probs))
    need = {}
    for name, p in probs.items():
        pos = (n - 1) * p
        lo = int(pos // 1)
        need[name] = (lo, min(lo + 1, n - 1), pos - lo)
    ranks = sorted({r for lo, hi, _ in need.values() for r in (lo, hi)})
    r = row_numbers(v, "_v", "_r").filter(F.col("_r").isin(ranks))
    vals = r.groupBy().agg(*[F.max(F.when(F.col("_r") == k, F.col("_v"))).alias(f"_r{k}") for k in ranks])
    sel = []
    for name, (lo, hi, f) in need.items():
        lo_v, hi_v = F.col(f"_r{lo}"), F.col(f"_r{hi}")
        sel.append((lo_v if f == 0 else (F.lit(1.0 - f) * lo_v + F.lit(f) * hi_v)).alias(name))
    return vals.select(*sel)
