"""k-mer counts from sorted suffixes against a plain count, with batches that cut through groups."""
import random
from collections import Counter

import pytest

from seqscore.operators import motifs as MO


def _plain(rows, wmin, wmax):
    seen = {(g, r, k): s for g, r, k, s in rows}
    fg, bg = Counter(), Counter()
    for (g, r, _), s in seen.items():
        for x in {s[i:i + w] for w in range(wmin, wmax + 1) for i in range(len(s) - w + 1)}:
            (fg if r == "fg" else bg)[g, x] += 1
    return {k: (fg[k], bg[k]) for k in {*fg, *bg}}


def _rows(rng):
    rows = []
    for i in range(120):
        s = rng.choice(["ACGT" * 5, "A" * 18, "".join(rng.choice("ACGT") for _ in range(rng.randint(3, 22)))])
        rows.append((rng.choice("xy"), rng.choice(["fg", "bg"]), i, s))
    return rows + rows[:10]


@pytest.mark.parametrize("batch", [7, 10000])
def test_counts_of_all_widths(spark, batch):
    rows = _rows(random.Random(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "grp string, role string, seq_index long, sequence string")
        want = _plain(rows, 4, 9)
        got = MO.motif_counts_tagged(df, "role", 4, 9, ["grp"]).collect()
        assert len(got) == len(want)
        assert {(r.grp, r.kmer): (r.fg_n, r.bg_n) for r in got} == want
        few = MO.motif_counts_tagged(df, "role", 4, 9, ["grp"], least=2).collect()
        assert {(r.grp, r.kmer): (r.fg_n, r.bg_n) for r in few} == {k: v for k, v in want.items() if v[0] >= 2}
        tested = Counter(g for g, _ in want)
        assert {(r.grp, r.tested) for r in few} == set(tested.items())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_sequence_shuffles_suffixes_not_kmers(spark):
    df = spark.createDataFrame([("g", "fg", 1, "ACGTTGCAACGGTTCAAGCTTGCAT")], "grp string, role string, seq_index long, sequence string")
    assert MO.suffixes(df, 8, 25, ["grp"], "role").count() == 18  # 171 k-mers


def _overlap(a, b):
    return a in b or b in a or len(a) == len(b) and (a[1:] == b[:-1] or b[1:] == a[:-1])


def test_short_list_gives_the_picks_of_the_whole(spark):
    rng = random.Random(2)
    kmers = sorted({"".join(rng.choice("AC") for _ in range(6)) for _ in range(60)})
    rows = [("g", k, 5, 1, 1.0, round(rng.random(), 1), 1.0) for k in kmers]
    df = spark.createDataFrame(rows, "grp string, kmer string, fg_n long, bg_n long, log_odds double, p_value double, E_value double")
    want = []
    for r in sorted(rows, key=lambda r: (r[5], r[1])):
        if len(want) < 4 and not any(_overlap(r[1], x) for x in want):
            want.append(r[1])
    got = MO.select_motifs(df, 4, ["grp"], 3).orderBy("rank").collect()
    assert [r.motif for r in got] == want


def test_best_rows_are_not_ranked_in_one_task(spark):
    rows = [("W1", 1, 3), ("W1", 2, 3), ("W1", 2, 3), ("W1", 3, None), ("W2", 4, None), ("W2", 5, None), (None, 6, 1), (None, 7, 2)]
    best = MO._best_rows(spark.createDataFrame(rows, "motif string, seq_ID long, seq_Score int"), "motif", "seq_Score")
    assert {r.seq_ID for r in best.collect()} == {1, 2, 4, 5, 7} and best.count() == 5
    assert "Window" not in best._jdf.queryExecution().toString()
