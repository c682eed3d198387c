"""What must hold beyond the size of the fixtures: many partitions, millions of values,
chains, large samples, empty and one-row inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqscore.operators import bands, clusters, components, distance, metrics, models, ordered, similarity, stats
from seqscore.sources import readers

N = 2_000_000


@pytest.fixture(scope="module")
def many(spark):
    """2M rows with distinct scores, a payload, in 16 partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    bits = F.xxhash64("id")
    yield spark.range(0, N, 1, 16).select(
        F.col("id").alias("key"), ((F.pmod(bits, F.lit(1 << 40)) * (1 << 21) + F.col("id")) / float(1 << 61)).alias("score"),
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) == 0).cast("int").alias("label"),
        F.concat(F.lit("payload-"), F.col("id")).alias("payload"), F.lit(1).alias("g"))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def arrays(many):
    pdf = many.select("score", "label").toPandas()
    return pdf["score"].to_numpy(), pdf["label"].to_numpy()


def test_auc(many, arrays):
    score, label = arrays
    rank = np.empty(N)
    rank[np.argsort(score)] = np.arange(1, N + 1)
    n1 = label.sum()
    want = (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (N - n1))
    assert metrics.roc_auc(many, ["g"], "score").first()["auc"] == pytest.approx(want, abs=1e-12)


def test_row_numbers_carry_their_rows(many):
    r = models.row_numbers(many, "score", "rn").agg(
        F.countDistinct("rn"), F.min("rn"), F.max("rn"), F.sum((F.col("payload") == F.concat(F.lit("payload-"), F.col("key"))).cast("int"))).first()
    assert tuple(r) == (N, 0, N - 1, N)


def test_row_numbers_follow_the_order(many):
    from pyspark.sql import Window
    d = models.row_numbers(many, "score", "rn").select("rn", "score", F.floor(F.col("rn") / 50_000).alias("b"))
    inside = d.withColumn("p", F.lag("score").over(Window.partitionBy("b").orderBy("rn")))
    assert inside.filter(F.col("p") >= F.col("score")).count() == 0
    ends = sorted((r.b, r.lo, r.hi) for r in d.groupBy("b").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect())
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:]))


def test_permutation_keeps_all_rows(many):
    p = models.permute_column(many, "score", "key", 5)
    a, b = (d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("score").cast("decimal(38,0)")), F.countDistinct("key")).first() for d in (many, p))
    assert tuple(a) == tuple(b)
    assert p.join(many.withColumnRenamed("score", "old").select("key", "old"), "key").filter(F.col("old") == F.col("score")).count() < 10


def test_benjamini_hochberg(many, arrays):
    p = np.sort(arrays[0] + 1e-9)
    q = np.minimum.accumulate((p * N / np.arange(1, N + 1))[::-1])[::-1].clip(max=1)
    got = stats.fdr_bh(many.withColumn("p", F.col("score") + 1e-9), "p", ["g"], "q", "global", ["key"]).select("p", "q").toPandas().sort_values("p")
    assert len(got) == N and np.allclose(got["q"].to_numpy(), q, rtol=1e-9, atol=0)


def test_dense_index_and_quantiles(many, arrays):
    r = clusters.dense_index(many, "score", "r").agg(F.countDistinct("r"), F.min("r"), F.max("r")).first()
    assert tuple(r) == (N, 1, N)
    q = ordered.global_quantiles(many, "score", {"a": 0.1, "b": 0.5}).first()
    assert [q.a, q.b] == pytest.approx(np.quantile(arrays[0], [0.1, 0.5]).tolist(), abs=1e-12)


def test_long_chains_are_one_component(spark):
    n = 500
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7), (None, 3)], "a int, b int")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}
    with pytest.raises(RuntimeError):
        components.connected_components(edges, safety=2)
    star = spark.createDataFrame([(5000, i) for i in range(3000)], "a int, b int")
    assert {r.root for r in components.connected_components(star).collect()} == {0}
    nodes = spark.createDataFrame([(c,) for c in "abcdefghij"], "s string")
    chain = spark.createDataFrame(list(zip("abcdefgh", "bcdefghi")), "seq_a string, seq_b string")
    assert {r.label for r in similarity.connected_components(chain, nodes).collect()} == {"a", "j"}


def test_identity_of_unequal_lengths(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("ACGT"), n)) for n in (8, 12, 25, 25, 60)]
    seqs = set(base)
    for s in base:
        for _ in range(6):
            t = list(s)
            for _ in range(rng.integers(1, 4)):
                k = rng.integers(len(t))
                t[k:k + 1] = rng.choice(["", "A", "CG"])
            seqs.add("".join(t))
    seqs = sorted(seqs)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diag, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
        return row[-1]
    for t in (0.75, 0.9):
        want = {(a, b, lev(a, b)) for i, a in enumerate(seqs) for b in seqs[i + 1:] if 1 - lev(a, b) / max(len(a), len(b)) >= t - 1e-12}
        got = similarity.identity_pairs(spark.createDataFrame([(s,) for s in seqs], "sequence string"), t)
        assert {(r.seq_a, r.seq_b, r.edits) for r in got.collect()} == want


def test_samples_over_a_hundred(spark):
    df = spark.range(400).select(F.lit(1).alias("ClsID"), F.col("id").alias("seq_index"))
    sizes = spark.createDataFrame([(1, 150), (2, 194), (3, 20)], "rep int, n_sample int")
    assert {r.rep: r["count"] for r in distance.sample_members(df, sizes).groupBy("rep").count().collect()} == {1: 150, 2: 194, 3: 20}


def test_scores_outside_the_bound_raise(spark):
    df = spark.createDataFrame([(1, 3), (1, 27), (1, 27)], "ClsID int, prediction_score int")
    with pytest.raises(Exception, match="score outside"):
        bands.cluster_histograms(df).collect()
    r = bands.cluster_histograms(df, max_score=27).first()
    assert (r.n, r.med, sum(r[f"h{v}"] for v in range(28))) == (3, 27.0, 3)
    assert bands._triangle_buckets(10 ** 6) > 256


def test_blocks_equal_the_join_of_pairs(spark):
    rows = [(c, int(v)) for c, m in enumerate(np.random.default_rng(2).integers(1, 9, 60)) for v in np.random.default_rng(c).integers(0, 25, m)]
    h = bands.cluster_histograms(spark.createDataFrame(rows, "ClsID long, prediction_score int"))
    m = bands.trial_members(h, 12, 14, 10, bands.DEFAULT_TRIALS[:2])
    plain = stats.pair_statistics(bands.cluster_pairs(m, carry=stats.STAT_COLS))
    cols = ["trial", "c1", "c2", "inter", "n1", "n2", "t_stat", "dof", "u_stat", "z_mw"]
    show = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())
    assert [list(map(str, r)) for r in show(stats.pair_statistics_by_block(m, target=7))] == [list(map(str, r)) for r in show(plain)]


def test_two_single_member_clusters(spark):
    h = bands.cluster_histograms(spark.createDataFrame([(1, 3), (2, 24)], "ClsID int, prediction_score int"))
    pairs = bands.cluster_pairs(bands.trial_members(h), carry=stats.HIST_COLS)
    r = stats.pair_tests(pairs).first()
    assert r.t_stat is None and r.u_stat == 0.0
    with pytest.raises(ValueError):
        stats.pair_tests(pairs, method="best")


def test_empty_and_bad_arguments(spark):
    none = spark.createDataFrame([], "x double, Perc int, ClsID int, seq_index int")
    assert clusters.binned_histogram(none, "x", 5).collect() == []
    with pytest.raises(ValueError):
        clusters.identity_sweep(none, lim=1)


def test_existence_by_file_system(spark, tmpdir_fresh):
    assert readers.path_exists(spark, "file:" + tmpdir_fresh) and not readers.path_exists(spark, tmpdir_fresh + "/none")


def test_row_index_is_file_order(spark, tmpdir_fresh):
    spark.range(0, 5000, 1, 7).select(F.format_string("%05d", "id").alias("value")).write.text(tmpdir_fresh + "/t")
    raw = spark.read.text(tmpdir_fresh + "/t").select("value", *readers.FILE_PLACE)
    got = readers.with_row_index(raw, "i").orderBy("i").collect()
    assert [(r.value, r.i) for r in got] == [(f"{k:05d}", k) for k in range(5000)]
    each = readers.with_row_index(raw, "i", per_file=True).groupBy("i").count()
    assert each.agg(F.sum("count")).first()[0] == 5000 and each.filter("i = 0").first()["count"] == 7
