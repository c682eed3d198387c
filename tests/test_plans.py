"""Plan-shape checks: relational queries stay JVM-side, never form a
Cartesian product or nested-loop join, and filters reach the Parquet scan."""
import pytest
from pyspark.sql import functions as F

from seqscore.operators import clusters as C
from seqscore.plans import all_queries
from seqscore.sources import readers as R
from seqscore.sources import fixtures as X

SF = "/root/testdata/sf0.001"
QUERIES, _ = all_queries()
RELATIONAL = ["cluster_stats", "cluster_profile", "in_out_std", "join_library", "join_composite", "semi_top_clusters",
              "left_fill_counts", "gc_by_score", "hard_vote", "confusion", "roc_auc", "threshold_sweep",
              "best_threshold", "jaccard", "identity_pairs", "pair_ttest", "pair_mannwhitney", "motif_counts",
              "kmer_distances"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_python_or_cartesian(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    for bad in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, (name, bad)


@pytest.mark.parametrize("name", ["pair_ttest", "pair_mannwhitney", "pair_fligner", "pair_wilcoxon", "significant_pairs"])
def test_pairs_meet_in_blocks(spark, name):
    """Pair tests are array operations on two blocks of members: no pair is joined, no row goes
    through Python on its own."""
    plan = _plan(QUERIES[name](spark, SF))
    assert "FlatMapCoGroupsInArrow" in plan and "EvalPython" not in plan and "SortMergeJoin [trial" not in plan


def test_status_filter_pushed_to_parquet(spark, tmpdir_fresh):
    path = f"{tmpdir_fresh}/membership.parquet"
    X.membership(spark, SF).write.parquet(path)
    m = C.status_filter(C.parse_membership(spark.read.parquet(path))).select("ClsID", "seq_index")
    plan = _plan(m)
    assert "PushedFilters: [In(Status, [C,M])" in plan or "PushedFilters: [IsNotNull(Status), In(Status" in plan, plan
    assert "ReadSchema: struct<ClsID:bigint,SeqID:string,Status:string>" in plan, plan


def test_membership_tsv_reader_prunes(spark, tmpdir_fresh):
    path = f"{tmpdir_fresh}/m.tsv"
    with open(path, "w") as f:
        f.write("0\t>gi|1|12\t0.9\tC\n")
    plan = _plan(R.read_membership(spark, path).filter(F.col("Status") == "C").select("ClsID"))
    assert "PushedFilters" in plan
