"""Classification metrics as grouped aggregations.

Everything starts from a (group..., score/pred, label) table. Rank statistics work on
the per-group score histogram (one row per distinct score), never on a global row
order, so the only windows run over small aggregated tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqscore.operators.ordered import cumulative_sum

METRICS = ["accuracy", "f1", "precision", "recall", "TNR"]


def _div(a: Column, b: Column) -> Column:
    """a / b with zero_division = 0."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def confusion(df: DataFrame, group: list[str], pred: str = "pred", label: str = "label") -> DataFrame:
    """Tp, fp, tn, fn per group (conditional sums, partial aggregation)."""
    p, y = F.col(pred), F.col(label)
    s = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    return df.groupBy(*group).agg(s((p == 1) & (y == 1)).alias("tp"), s((p == 1) & (y == 0)).alias("fp"),
                                  s((p == 0) & (y == 0)).alias("tn"), s((p == 0) & (y == 1)).alias("fn"))


def metric_columns(conf: DataFrame, average: str = "macro", keep_counts: bool = False) -> DataFrame:
    """A17 (``binary``) / A18 (``macro``, plus FPR and TPR) from confusion counts, zero_division=0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    acc = _div(tp + tn, n)
    p1, r1, f1_1 = _div(tp, tp + fp), _div(tp, tp + fn), _div(2 * tp, 2 * tp + fp + fn)
    tnr = _div(tn, tn + fp)
    if average == "binary":
        cols = {"accuracy": acc, "f1": f1_1, "precision": p1, "recall": r1, "TNR": tnr}
    elif average == "macro":
        p0, f1_0 = _div(tn, tn + fn), _div(2 * tn, 2 * tn + fn + fp)
        cols = {"accuracy": acc, "f1": (f1_1 + f1_0) / 2, "precision": (p1 + p0) / 2,
                "recall": (r1 + tnr) / 2, "TNR": tnr, "FPR": _div(fp, fp + tn), "TPR": r1}
    else:
        raise ValueError(f"average must be 'binary' or 'macro', not {average!r}")
    out = conf
    for k, v in cols.items():
        out = out.withColumn(k, v)
    if not keep_counts:
        out = out.drop("tp", "fp", "tn", "fn")
    return out


def confusion_of_histogram(h: DataFrame, group: list[str], pred: Column) -> DataFrame:
    """``confusion`` of 0 / 1 labels from what ``score_histogram`` gives; ``pred`` follows from the score."""
    s = lambda p, n: F.coalesce(F.sum(F.when(p, F.col(n))), F.lit(0)).cast("bigint")
    return h.groupBy(*group).agg(s(pred == 1, "pos").alias("tp"), s(pred == 1, "neg").alias("fp"),
                                 s(pred == 0, "neg").alias("tn"), s(pred == 0, "pos").alias("fn"))


def mcc(conf: DataFrame) -> DataFrame:
    """Matthews correlation (0 when a marginal is empty)."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return conf.withColumn("mcc", F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(F.lit(0.0)))


def score_histogram(df: DataFrame, group: list[str], score: str, label: str = "label") -> DataFrame:
    """Positives and negatives per (group, distinct score): the sufficient statistic of
    every rank metric below."""
    return df.groupBy(*group, score).agg(F.sum(F.col(label)).cast("bigint").alias("pos"),
                                         F.sum(1 - F.col(label)).cast("bigint").alias("neg"))


def roc_auc(df: DataFrame, group: list[str], score: str, label: str = "label") -> DataFrame:
    """AUC in rank form, (R1 - n1(n1+1)/2) / (n1 n0) with average ranks for ties,
    computed as sum_s pos(s) * (neg(< s) + neg(s)/2) / (P N) over the per-group score
    histogram; the running negative count is a distributed cumulative sum, so a group
    with many distinct scores is not one task. NULL for a one-class group."""
    return auc_of_histogram(score_histogram(df, group, score, label), group, score)


def auc_of_histogram(h: DataFrame, group: list[str], score: str) -> DataFrame:
    """``roc_auc`` of what ``score_histogram`` gives."""
    h = cumulative_sum(h, group, [score], ["neg"], ["_neg_below"], inclusive=False)
    agg = h.groupBy(*group).agg(
        F.sum(F.col("pos") * (F.col("_neg_below") + F.col("neg") / 2.0)).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return agg.select(*group, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                     F.col("_u") / (F.col("_p") * F.col("_n")).cast("double")).alias("auc"))


def roc_curve(df: DataFrame, group: list[str], score: str, label: str = "label") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score (score >= threshold is
    positive): descending cumulative sums over the per-group histogram (distributed).
    No intermediate points are dropped."""
    h = score_histogram(df, group, score, label)
    tot = h.groupBy(*group).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    h = cumulative_sum(h, group, [score], ["pos", "neg"], ["_tp", "_fp"], inclusive=True, descending=True)
    h = h.join(tot, group)
    return h.select(*group, F.col(score).alias("threshold"), _div(F.col("_fp"), F.col("_N")).alias("fpr"),
                    _div(F.col("_tp"), F.col("_P")).alias("tpr"))


def trapezoid_auc(curve: DataFrame, group: list[str]) -> DataFrame:
    """Trapezoid area under a bounded (fpr, tpr) curve such as the threshold sweep,
    points ordered by (fpr, tpr), starting from the first point."""
    w = Window.partitionBy(*group).orderBy("fpr", "tpr")
    c = curve.withColumn("_pf", F.lag("fpr").over(w)).withColumn("_pt", F.lag("tpr").over(w))
    return c.groupBy(*group).agg(
        F.coalesce(F.sum((F.col("fpr") - F.col("_pf")) * (F.col("tpr") + F.col("_pt")) / 2.0),
                   F.lit(0.0)).alias("trapezoid_auc"))


def grid_cell(score: Column, steps: int = 1000, tol: float = 1e-7) -> Column:
    """Largest i in [0, steps] with i / steps <= score (-1 below 0): the grid of
    ``arange(0, 1.001, 0.001)``. ``tol`` (in cells) absorbs summation-order noise of a
    mean that should sit exactly on a grid point."""
    i = F.floor(score * F.lit(float(steps)) + F.lit(tol)).cast("int")
    return F.least(F.greatest(i, F.lit(-1)), F.lit(steps))


def threshold_sweep(df: DataFrame, group: list[str], score: str, label: str = "label",
                    steps: int = 1000) -> DataFrame:
    """Metrics at thresholds +inf, 0, 1/steps, ..., 1 (``steps + 2`` rows per group).

    Rows are reduced to a histogram over the grid cells (partial aggregation), the grid
    is generated per group with ``sequence`` (no join to a range table), and the counts
    at each threshold are descending cumulative sums over <= steps+1 rows per group."""
    return sweep_of_histogram(df.select(*group, score, F.col(label).alias("pos"), (1 - F.col(label)).alias("neg")), group, score, steps)


def sweep_of_histogram(hist: DataFrame, group: list[str], score: str, steps: int = 1000) -> DataFrame:
    """``threshold_sweep`` of what ``score_histogram`` gives."""
    d = hist.select(*group, grid_cell(F.col(score), steps).alias("cell"), "pos", "neg")
    h = d.groupBy(*group, "cell").agg(F.sum("pos").cast("bigint").alias("_pos"), F.sum("neg").cast("bigint").alias("_neg"))
    tot = h.groupBy(*group).agg(F.sum("_pos").alias("P"), F.sum("_neg").alias("N"))
    grid = tot.select(*group, "P", "N", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("cell"))
    g = grid.join(h.filter(F.col("cell") >= 0), [*group, "cell"], "left").fillna(0, ["_pos", "_neg"])
    w = Window.partitionBy(*group).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.select(*group, "cell", (F.col("cell") * F.lit(1.0 / steps)).alias("threshold"),
                 F.sum("_pos").over(w).alias("tp"), F.sum("_neg").over(w).alias("fp"), "P", "N")
    inf = tot.select(*group, F.lit(-1).alias("cell"), F.lit(float("inf")).alias("threshold"),
                     F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), "P", "N")
    g = g.unionByName(inf)
    g = g.select(*group, "cell", "threshold", "tp", "fp", (F.col("N") - F.col("fp")).alias("tn"),
                 (F.col("P") - F.col("tp")).alias("fn"))
    return metric_columns(g, "macro")


def best_threshold(sweep: DataFrame, group: list[str], metrics=METRICS, last_cell: int = 1000) -> DataFrame:
    """Per group and metric, the best value and the first threshold (in sweep order:
    +inf, then ascending) reaching it. TNR takes the smallest threshold reaching its
    maximum and, when that is +inf, the largest finite threshold and its value."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    long = sweep.select(*group, "cell", "threshold", F.inline(rows))
    is_tnr = F.col("metric") == "TNR"
    # Sweep order key: +inf (cell -1) first for ordinary metrics, last for TNR.
    order = F.when(is_tnr & (F.col("cell") == -1), F.lit(last_cell + 1)).otherwise(F.col("cell"))
    best = long.groupBy(*group, "metric").agg(
        F.min(F.struct((-F.col("value")).alias("nv"), order.alias("o"), F.col("threshold").alias("t"))).alias("b"),
        F.max(F.when(F.col("cell") == last_cell, F.col("value"))).alias("_v_last"),
        F.max(F.when(F.col("cell") == last_cell, F.col("threshold"))).alias("_t_last"))
    use_last = is_tnr & (F.col("b.o") == last_cell + 1)
    return best.select(*group, "metric",
                       F.when(use_last, F.col("_v_last")).otherwise(-F.col("b.nv")).alias("best_value"),
                       F.when(use_last, F.col("_t_last")).otherwise(F.col("b.t")).alias("threshold"))


def best_of_model(metrics: DataFrame, keys=("model", "test_on"), cols=("accuracy", "f1", "precision", "recall", "TNR", "auc")) -> DataFrame:
    """Max of each metric by (model, test_on)."""
    return metrics.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols])
