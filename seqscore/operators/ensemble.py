"""Ensembles over long prediction tables (P8-P10, J10-J11, ML5, ML7, ML9, ML10, U4).

Predictions are one long table keyed (test_on, row key, model, train_on); every
per-test-set loop of the reference becomes a ``groupBy('test_on', ...)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqscore.operators import metrics as M
from seqscore.operators.scores import hard_vote_expr
from seqscore.session import cut_lineage

KEY = "seq_index"


def align_labels(pred: DataFrame, labels: DataFrame, key: str = KEY, offset: int = 0) -> DataFrame:
    """Attach the true label by explicit row key; ``offset=1`` reproduces the
    reference's "labels shifted by one" alignment (label of row key + 1)."""
    lab = labels if offset == 0 else labels.withColumn(key, F.col(key) - offset)
    return pred.join(lab, key)


def vote_table(ev: DataFrame, exclude_train_on: str | None = "cao2021", tie: str | int = "label",
               key: str = KEY) -> DataFrame:
    """P10 per (test_on, row): votes, model count and the hard vote. ``tie='label'`` is the
    reference behaviour (Q1: label leakage); 0 or 1 are the leak-free choices."""
    e = ev if exclude_train_on is None else ev.filter(F.col("train_on") != exclude_train_on)
    agg = e.groupBy("test_on", key).agg(F.sum("pred").cast("int").alias("votes"),
                                        F.count(F.lit(1)).cast("int").alias("n_models"),
                                        F.min("label").alias("label"))
    tie_c = F.col(tie) if isinstance(tie, str) else F.lit(tie)
    return agg.withColumn("vote", hard_vote_expr(F.col("votes"), F.col("n_models"), tie_c))


def vote_metrics(ev: DataFrame, tie: str | int = "label", swap_args: bool = False,
                 exclude_train_on: str | None = "cao2021") -> DataFrame:
    """Majority-vote metrics per test set (macro average, auc 0.0 as in the reference).

    ``swap_args=True`` reproduces Q2 (votes passed as labels): the confusion is transposed."""
    v = vote_table(ev, exclude_train_on, tie)
    if swap_args:
        v = v.select("test_on", F.col("vote").alias("label"), F.col("label").alias("vote"))
    conf = M.confusion(v, ["test_on"], pred="vote", label="label")
    out = M.metric_columns(conf, "macro")
    return out.select(F.lit("Major_vote").alias("model"), F.lit("-").alias("train_on"), "test_on",
                      *M.METRICS, F.lit(0.0).alias("auc"))


def model_metrics(ev: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per (model, train_on, test_on): macro metrics of proba >= threshold, plus AUC, both from one
    histogram of the probabilities."""
    g = ["model", "train_on", "test_on"]
    h = cut_lineage(M.score_histogram(ev, g, "proba"))
    m = M.metric_columns(M.confusion_of_histogram(h, g, (F.col("proba") >= threshold).cast("int")), "macro")
    auc = M.auc_of_histogram(h, g, "proba")
    return m.join(auc, g).select(*g, *M.METRICS, "auc")


def mean_proba(ev: DataFrame, exclude_train_on: str | None = None, key: str = KEY) -> DataFrame:
    """P8 per (test_on, row): mean of every model's probability (Q9: 27 columns by default).

    Rounded to 12 digits so that the summation order of a shuffle cannot split ties."""
    e = ev if exclude_train_on is None else ev.filter(F.col("train_on") != exclude_train_on)
    return e.groupBy("test_on", key).agg(F.round(F.avg("proba"), 12).alias("mean_proba"),
                                         F.min("label").alias("label"))


def threshold_metrics(ev: DataFrame, steps: int = 1000) -> DataFrame:
    """The THRESHOLD rows: best value of each metric over the sweep of the mean
    probability, plus the AUC of the mean probability, one row per test set, both from one
    histogram of the means."""
    h = cut_lineage(M.score_histogram(mean_proba(ev), ["test_on"], "mean_proba"))
    sweep = M.sweep_of_histogram(h, ["test_on"], "mean_proba", steps=steps)
    best = M.best_threshold(sweep, ["test_on"], last_cell=steps)
    wide = best.groupBy("test_on").pivot("metric", M.METRICS).agg(F.first("best_value"))
    auc = M.auc_of_histogram(h, ["test_on"], "mean_proba")
    return wide.join(auc, "test_on").select(F.lit("THRESHOLD").alias("model"), F.lit("-").alias("train_on"),
                                           "test_on", *M.METRICS, "auc")


def blend_split(df: DataFrame, key: str = KEY, seed: str = "43", train: float = 0.7,
                test: float = 0.201) -> Column:
    """ML5: repeatable hash split: 'train' (70 %), 'test' (20.1 %), 'validation' (9.9 %).

    u = first 8 hex digits of md5(seed || key) / 2^32, so DuckDB computes the same split."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return F.when(u < train, "train").when(u < train + test, "test").otherwise("validation")


def blend_dataset(ev: DataFrame, models: list[tuple[str, str]], key: str = KEY) -> DataFrame:
    """ML10: one wide row per (test_on, row): a vote column per (model, train_on) and the
    true label last. A pivot by conditional aggregation: one shuffle on the row key."""
    names = [f"{m}_{t}" for m, t in models]
    aggs = [F.max(F.when((F.col("model") == m) & (F.col("train_on") == t), F.col("pred"))).alias(f"{m}_{t}")
            for m, t in models]
    w = ev.groupBy("test_on", key).agg(*aggs, F.min("label").alias("true_lable"))
    return w.select("test_on", key, *names, "true_lable")


def best_blend(metrics: DataFrame, score: str = "auc", group: str = "test_on") -> DataFrame:
    """ML7/W1: rows reaching the best ``score`` per test set (ties kept, Q18), relabelled BLEND."""
    w = Window.partitionBy(group).orderBy(F.desc(score))
    best = metrics.withColumn("_r", F.rank().over(w)).filter(F.col("_r") == 1).drop("_r")
    return best.withColumn("model", F.lit("BLEND"))


def metric_union(*tables: DataFrame) -> DataFrame:
    """U4: vertical concatenation by column name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
