"""The pair queries test the clusters of all eleven trials."""

import pytest
from pyspark.sql import functions as F

from seqscore.operators import bands as BD
from seqscore.plans import all_queries
from seqscore.plans import q_stats as Q

SF = "/root/testdata/sf0.01"
QUERIES, _ = all_queries()
TRIALS = [t[0] for t in BD.DEFAULT_TRIALS]


@pytest.fixture(scope="module")
def pairs(spark):
    """Pairs of each trial, from the members of its two bands."""
    n = BD.trial_members(Q.hist(spark, SF), Q.LOW, Q.HIGH, Q.NMID).groupBy("trial").count().collect()
    return {r[0]: r[1] * (r[1] - 1) // 2 for r in n}


@pytest.mark.parametrize("name", ["pair_trials", "pair_fligner", "fdr_bh", "pair_wilcoxon"])
def test_every_pair_of_every_trial(spark, pairs, name):
    assert sorted(pairs) == TRIALS
    got = QUERIES[name](spark, SF).groupBy("trial").agg(F.count(F.lit(1)), F.countDistinct("c1", "c2")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {t: (n, n) for t, n in pairs.items()}


def test_consensus_is_that_of_significant_pairs(spark):
    show = lambda d: sorted(map(tuple, d.select("trial", "c1", "c2").collect()))
    want = show(QUERIES["significant_pairs"](spark, SF))
    assert show(QUERIES["consensus_pairs"](spark, SF)) == want


def test_one_pass_gives_what_single_tests_give(spark):
    show = lambda d, *c: sorted(tuple(map(str, r)) for r in d.select(*c).collect())
    both = QUERIES["pair_trials"](spark, SF).cache()
    for name, columns in (("pair_ttest", ("trial", "c1", "c2", "inter", "n1", "n2", "t_stat", "dof")), ("pair_mannwhitney", ("trial", "c1", "c2", "u_stat", "z_mw"))):
        assert show(both, *columns) == show(QUERIES[name](spark, SF), *columns)
