import itertools
import random

import numpy as np

from seqscore.operators import matrices as MX


def test_best_sites_against_all_starts():
    rng = np.random.default_rng(2)
    for w in (1, 2, 5, 8, 13):
        weights = rng.integers(-4000, 2000, (w, 4))
        seqs = ["".join(rng.choice(list("ACGTN"), rng.integers(0, 40))) for _ in range(80)] + ["A" * 30, ""]
        numbers, sizes = MX.letter_numbers(seqs)
        got = dict(zip(*[x.tolist() for x in (lambda r, s, v: (r, np.stack((s, v), 1)))(*MX.best_sites(numbers, sizes, weights))]))
        for i, s in enumerate(seqs):
            score = [sum(int(weights[k]["ACGT".index(c)]) if c in "ACGT" else 0 for k, c in enumerate(s[j:j + w])) for j in range(len(s) - w + 1)]
            assert got.get(i) == ([score.index(max(score)), max(score)] if score else None)


def test_score_law_counts_all_words():
    rng = np.random.default_rng(3)
    weights = rng.integers(-3, 3, (6, 4))
    scores, chance = MX.score_law(weights)
    words = [sum(weights[k][x] for k, x in enumerate(word)) for word in itertools.product(range(4), repeat=6)]
    assert chance.tolist() == [sum(v >= s for v in words) / 4 ** 6 for s in scores.tolist()]


def planted(rng, motif, n, mutated=0.2, length=30):
    out = []
    for _ in range(n):
        s = [rng.choice("ACGT") for _ in range(length)]
        site = [rng.choice("ACGT") if rng.random() < mutated else c for c in motif]
        at = rng.randrange(length - len(motif) + 1)
        s[at:at + len(motif)] = site
        out.append("".join(s))
    return out


def brute_em(seqs, counts, rounds):
    """The same fit, one start at a time."""
    gamma = 0.5
    for _ in range(rounds):
        p = (counts + 0.25) / (counts.sum(1, keepdims=True) + 1)
        new, sites = np.zeros_like(counts), 0.0
        for s in seqs:
            n = len(s) - len(p) + 1
            odds = [gamma / n * np.prod([4 * p[k]["ACGT".index(c)] for k, c in enumerate(s[j:j + len(p)])]) for j in range(n)]
            for j, o in enumerate(odds):
                z = o / (1 - gamma + sum(odds))
                sites += z
                for k, c in enumerate(s[j:j + len(p)]):
                    new[k]["ACGT".index(c)] += z
        counts, gamma = new, min(0.999, max(0.001, sites / len(seqs)))
    return counts


def test_planted_motifs_are_refined_and_found(spark):
    rng = random.Random(7)
    motif = "ACGTTGCAAC"
    fg, bg = planted(rng, motif, 120), ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(120)]
    rows = [("x", "fg", i, s) for i, s in enumerate(fg)] + [("x", "bg", 1000 + i, s) for i, s in enumerate(bg)]
    df = spark.createDataFrame(rows, "grp string, role string, seq_index long, sequence string").repartition(3)
    seeds = spark.createDataFrame([("x", 1, motif[:8])], "grp string, rank int, motif string")
    first = MX.seed_matrices(df.where("role = 'fg'"), seeds, 1, ["grp"])
    counts = np.zeros((8, 4))
    for s in fg:
        for j in range(len(s) - 7):
            if sum(a != b for a, b in zip(s[j:j + 8], motif)) <= 1:
                for k, c in enumerate(s[j:j + 8]):
                    counts[k]["ACGT".index(c)] += 1
    _, got, weights = MX.held(first, ["grp"])["x", 1]
    assert (got == counts).all() and (weights == MX.whole_weights(counts)).all()
    fitted = MX.refine(df.where("role = 'fg'"), first, 4, ["grp"])
    _, got, weights = MX.held(fitted, ["grp"])["x", 1]
    assert np.allclose(got, brute_em(fg, counts, 4))
    assert "".join("ACGT"[x] for x in got.argmax(1)) == motif[:8]
    sites = MX.motif_sites(df, fitted, ["grp"]).join(df.select("seq_index", "role"), "seq_index")
    sizes = spark.createDataFrame([("x", 120, 120)], "grp string, N_fg long, N_bg long")
    row = MX.matrix_enrichment(sites, sizes, chance=1e-3, group=["grp"]).first()
    assert row.fg_n > 4 * max(row.bg_n, 1) and row.E_value < 1e-8


def test_many_cells_raise(spark, monkeypatch):
    monkeypatch.setattr(MX, "MOST_CELLS", 3)
    cells = spark.createDataFrame([(1, "A", 1, x, 1.0, 0) for x in "ACGT"], "rank int, motif string, pos int, letter string, n double, weight long")
    try:
        MX.held(cells, [])
    except ValueError:
        return
    raise AssertionError("more cells than the bound were taken")
