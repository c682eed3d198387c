import random

from seqscore.operators import motifs as MO


def test_every_sequence_with_a_motif_is_found(spark):
    """First place of each motif of a group in each sequence, whatever its width and place."""
    rng = random.Random(4)
    motifs = [("x", 1, "ACGTACGT", 2.0, 8), ("x", 2, "GGGTTTCCCA", 1.5, 10), ("y", 1, "TTTTTTTT", 1.0, 8)]
    seqs = []
    for i in range(120):
        s = "".join(rng.choice("ACGT") for _ in range(rng.choice([5, 8, 25, 30])))
        if len(s) >= 20 and rng.random() < 0.7:
            m = rng.choice(motifs)[2]
            at = rng.randrange(len(s) - len(m) + 1)
            s = s[:at] + m + s[at + len(m):]
        seqs.append((rng.choice("xy"), i, s))
    m = spark.createDataFrame(motifs, "grp string, rank int, motif string, log_odds double, width int")
    got = MO.motif_hits(spark.createDataFrame(seqs, "grp string, seq_index long, sequence string"), m, ["grp"])
    want = sorted((g, w, i, s.index(w) + 1, s.index(w) + len(w)) for g, i, s in seqs for h, _, w, _, _ in motifs if g == h and w in s)
    assert sorted((r.grp, r.motif, r.seq_index, r.site_start, r.site_end) for r in got.collect()) == want and len(want) > 20
