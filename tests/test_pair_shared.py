"""Pairs are tested once for all trials, and members of equal histograms share their tests."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqscore.operators import bands as BD
from seqscore.operators import pair_tests as PT
from seqscore.operators import stats as ST


def _members(spark):
    """Twelve clusters of one histogram, eight others, in two trials; two clusters come twice."""
    rows = [(i, v) for i in range(12) for v in (3, 9, 9, 20)] + [(20 + i, (5 * i + j * j) % 25) for i in range(8) for j in range(4 + i)]
    h = BD.cluster_histograms(spark.createDataFrame(rows, "ClsID long, prediction_score int"))
    trials = F.explode(F.array(F.lit(1), F.lit(2)))
    m = h.withColumn("trial", trials).withColumn("side", F.when((F.col("ClsID") + F.col("trial")) % 2 == 0, "A").otherwise("B"))
    m = m.withColumn("band_a", F.lit("low")).withColumn("band_b", F.lit("high"))
    return m.unionByName(m.where("ClsID in (4, 23) and trial = 1")).cache()


def test_equal_histograms_in_crowded_blocks(spark):
    m, cols = _members(spark), ["inter", "n1", "n2", "t_stat", "p_ttest", "u_stat", "p_mw", "fk_stat", "p_fligner"]
    key = lambda r: (r.trial, r.c1, r.c2)
    want = sorted(ST.pair_tests(BD.cluster_pairs(m, carry=ST.HIST_COLS)).collect(), key=key)
    for target in (3, 600):
        got = sorted(PT.pair_tests_by_block(m, target=target, tile=2).collect(), key=key)
        assert [key(r) for r in got] == [key(r) for r in want]
        numbers = lambda x: np.array([[np.nan if r[c] is None else r[c] for c in cols] for r in x], float)
        assert np.allclose(numbers(got), numbers(want), equal_nan=True, rtol=1e-9, atol=1e-12)
        sure = [key(r) for r in got if all(p is not None and p < 0.05 for p in (r.p_ttest, r.p_mw, r.p_fligner))]
        assert sorted(map(key, PT.pair_tests_by_block(m, keep=PT.consensus, target=target).collect())) == sure
        n = {r.trial: (r.n_pairs, r.n_inter, r.n) for r in PT.pair_tests_by_block(m, counts={"n": PT.consensus}, target=target).collect()}
        assert n == {t: (sum(r.trial == t for r in got), sum(r.trial == t and r.inter for r in got), sum(k[0] == t for k in sure)) for t in (1, 2)}


def test_kinds_are_distinct_histograms():
    table = pa.table({"id": [5, 6, 7], "n": [2, 2, 3], "s": [3.0, 3.0, 3.0], "q": [5.0, 5.0, 3.0], "h0": [0, 0, 0], "h1": [1, 1, 3], "h2": [1, 1, 0]})
    _, head, kind = PT.Side(table, 3).kinds()
    assert len(head) == 2 and kind[0] == kind[1] != kind[2]
    assert len(PT.Side(table, 3).kinds(own=True)[1]) == 3


def test_deviations_from_the_median(spark):
    values = {1: [0, 24], 2: [3, 3, 4], 3: [0, 1, 2, 24], 4: [24, 24], 5: [0], 6: [7, 8]}
    h = BD.cluster_histograms(spark.createDataFrame([(k, v) for k, x in values.items() for v in x], "ClsID long, prediction_score int"))
    for r in h.collect():
        d = np.abs(2 * np.array(values[r.ClsID]) - 2 * np.median(values[r.ClsID])).astype(int)
        assert r.dev == np.bincount(d, minlength=49).tolist()
