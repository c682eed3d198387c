"""Metrics of the report come from one histogram."""

from pyspark.sql import functions as F

from seqscore.operators import ensemble as E
from seqscore.operators import metrics as M


def test_report_reads_its_rows_twice(spark, monkeypatch):
    """The long table is reduced to one histogram for metrics and AUC, and one for sweep and AUC."""
    rows = [(i, "s", "m", t, int(i * k % 5 > 2), (i * k % 16) / 15.0, i % 3 % 2) for i in range(60) for k, t in ((1, "x"), (3, "y"), (7, "z"))]
    ev = spark.createDataFrame(rows, "seq_index long, test_on string, model string, train_on string, pred int, proba double, label int")
    g = ["model", "train_on", "test_on"]
    plain = M.metric_columns(M.confusion(ev.withColumn("_p", (F.col("proba") >= 0.5).cast("int")), g, pred="_p"), "macro").join(M.roc_auc(ev, g, "proba"), g)
    mean = E.mean_proba(ev)
    best = M.best_threshold(M.threshold_sweep(mean, ["test_on"], "mean_proba"), ["test_on"])
    best, auc = {r.metric: r.best_value for r in best.collect()}, M.roc_auc(mean, ["test_on"], "mean_proba").first().auc
    made, histogram = [], M.score_histogram
    monkeypatch.setattr(M, "score_histogram", lambda *a: made.append(1) or histogram(*a))
    got = E.model_metrics(ev)
    assert sorted(got.collect()) == sorted(plain.select(got.columns).collect())
    row = E.threshold_metrics(ev).first()
    assert {m: row[m] for m in M.METRICS} == best and row.auc == auc
    assert len(made) == 2


def test_nulls_count_as_in_confusion(spark):
    d = spark.createDataFrame([("a", 0.2, 1), ("a", 0.7, 0), ("a", None, 1), ("a", 0.9, None), (None, 0.6, 1)], "g string, proba double, label int")
    p = (F.col("proba") >= 0.5).cast("int")
    got = M.confusion_of_histogram(M.score_histogram(d, ["g"], "proba"), ["g"], p).collect()
    assert sorted(got, key=str) == sorted(M.confusion(d.withColumn("pred", p), ["g"]).collect(), key=str)
