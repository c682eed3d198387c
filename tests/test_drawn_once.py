"""What several branches of a plan read is made once, not once a branch."""

from seqscore.operators import distance as D
from seqscore.plans import q_motifs as Q

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_kmer_distances_draw_once(spark):
    rows = spark.createDataFrame([(c, 10 * c + i, "ACGTAC"[i:] + "GGTA") for c in range(3) for i in range(5)], "ClsID long, seq_index long, sequence string")
    sample = D.sample_members(rows, D.sample_sizes(spark, 2))
    assert "Window" in _plan(sample) and "Window" not in _plan(D.kmer_distances(sample, 2))


def test_motif_sets_are_read_once(spark):
    assert "parquet" not in _plan(Q.q_seed_matrices(spark, SF)).lower()
