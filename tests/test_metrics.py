import math

import numpy as np
from pyspark.sql import functions as F

from seqscore.operators import metrics as M


def _brute_auc(s, y):
    pos = [a for a, l in zip(s, y) if l == 1]
    neg = [a for a, l in zip(s, y) if l == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_and_trapezoid(spark):
    rng = np.random.default_rng(3)
    s = rng.integers(0, 6, 300) / 5.0
    y = (rng.uniform(size=300) < 0.3 + 0.1 * s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int").withColumn("g", F.lit("x"))
    auc = M.roc_auc(df, ["g"], "score").first()["auc"]
    assert math.isclose(auc, _brute_auc(s, y), rel_tol=1e-12)
    curve = M.roc_curve(df, ["g"], "score")
    start = spark.createDataFrame([("x", float("inf"), 0.0, 0.0)], "g string, threshold double, fpr double, tpr double")
    trap = M.trapezoid_auc(curve.unionByName(start), ["g"]).first()["trapezoid_auc"]
    assert math.isclose(trap, auc, rel_tol=1e-12)


def test_one_class_auc_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.5, 1)], "score double, label int").withColumn("g", F.lit(1))
    assert M.roc_auc(df, ["g"], "score").first()["auc"] is None


def test_sweep_equals_direct_metrics(spark):
    rng = np.random.default_rng(4)
    s = np.round(rng.uniform(size=400), 3)
    y = (rng.uniform(size=400) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int").withColumn("g", F.lit(1))
    sweep = {round(r.threshold, 3) if math.isfinite(r.threshold) else r.threshold: r
             for r in M.threshold_sweep(df, ["g"], "score").collect()}
    assert len(sweep) == 1002
    for t in (0.0, 0.25, 0.5, 0.731, 1.0):
        p = (s >= t - 1e-12).astype(int)
        tp = int(((p == 1) & (y == 1)).sum()); tn = int(((p == 0) & (y == 0)).sum())
        direct = M.metric_columns(spark.createDataFrame([(tp, int(((p == 1) & (y == 0)).sum()), tn,
                                                          int(((p == 0) & (y == 1)).sum()))],
                                                        "tp long, fp long, tn long, fn long"), "macro").first()
        r = sweep[t]
        for m in ("accuracy", "f1", "precision", "recall", "TNR", "FPR", "TPR"):
            assert math.isclose(r[m], direct[m], rel_tol=1e-12, abs_tol=1e-15), (t, m)
    inf = sweep[float("inf")]
    assert inf.TPR == 0.0 and inf.TNR == 1.0


def test_macro_binary_zero_division(spark):
    c = spark.createDataFrame([(0, 0, 5, 5)], "tp long, fp long, tn long, fn long")
    b = M.metric_columns(c, "binary").first()
    assert b.precision == 0.0 and b.f1 == 0.0 and b.recall == 0.0 and b.accuracy == 0.5
    m = M.mcc(c).first()
    assert m.mcc == 0.0


def test_hard_vote_rules(spark):
    from seqscore.operators.scores import hard_vote_expr
    rows = [(13, 24, 0), (12, 24, 1), (12, 24, 0), (11, 24, 1), (12, 25, 1)]
    df = spark.createDataFrame(rows, "v int, n int, label int")
    got = [r.vote for r in df.select(hard_vote_expr(F.col("v"), F.col("n"), F.col("label")).alias("vote")).collect()]
    assert got == [1, 1, 0, 0, 0]
