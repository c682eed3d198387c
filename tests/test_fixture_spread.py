"""Fixture tables: keys are dealt to all cores, and a member's score is the sum of its predictions."""

from functools import reduce

from pyspark.sql import functions as F

from seqscore.sources import fixtures as X


def _orders(spark, tmp_path, keys):
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_one_file_becomes_many_tasks(spark, tmp_path):
    d = _orders(spark, tmp_path, range(200000))
    parts = X.library(spark, d).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 3 * spark.sparkContext.defaultParallelism


def test_keys_that_repeat_or_are_null_stay(spark, tmp_path):
    d = _orders(spark, tmp_path, [1, 1, 2, None, None, 7])
    assert sorted((r[0] is None, r[0]) for r in X.library(spark, d).select("seq_index").collect() if r[0] is not None) == [(False, 1), (False, 1), (False, 2), (False, 7)]
    assert X.library(spark, d).where("seq_index is null").count() == 2


def test_score_in_the_id_is_the_sum_of_predictions(spark, tmp_path):
    d = _orders(spark, tmp_path, [None, *range(0, 3000, 3)])
    total = reduce(lambda a, b: a + b, [X._pred(p) for p, _, t in X.MODELS if t != X.BASELINE_SET])
    k = X.keys(spark, d)
    want = [r[0] for r in k.select(F.concat(F.lit(">gi|"), (F.col("seq_index") + 1).cast("string"), F.lit("|"), total.cast("string"))).collect()]
    got = [r[0] for r in X.membership(spark, d).select("SeqID").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and got.count(None) == 1
