import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqscore.llm import neighbours


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 10 ** 6), st.integers(1, 60))
def test_cells_come_in_falling_order(n, m, seed, enough):
    rng = np.random.default_rng(seed)
    first, second, counts = rng.normal(size=n), rng.normal(size=m), rng.integers(0, 4, (n, m))
    got = neighbours.visit(first, second, counts, enough)
    want = [c for c in np.argsort(-(first[:, None] + second[None, :]).ravel(), kind="stable").tolist() if counts.ravel()[c]]
    reach = np.cumsum(counts.ravel()[want])
    assert got == want[:int(np.searchsorted(reach, enough)) + 1]


def brute(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    good = [(i, v) for i, v in good if len(v) == 8]
    out = {}
    for q, v in good:
        if q % every == 0:
            out[q] = sorted(((float(v @ w), i) for i, w in good if i != q), key=lambda x: (-round(x[0], 9), x[1]))[:k]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, entry string")


@pytest.mark.parametrize("chunk", [4096, 30])
def test_all_cells_give_brute_force(spark, chunk):
    rng = np.random.default_rng(4)
    rows = [(i, np.float32(rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # equal vectors, more than k
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [None] * 8), (2080, [float("nan")] * 8), (2100, [1.0]), (None, rows[1][1]), (2120, [float("inf")] + [1.0] * 7)]
    got = {}
    for r in neighbours.search(vectors(spark, rows), 20, share=1.0, chunk=chunk).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute(rows, 20, 20)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [got[q][k + 1][0] for k in range(20)] == [i for _, i in best]
        assert np.allclose([got[q][k + 1][1] for k in range(20)], [s for s, _ in best])


def test_recall_of_a_part(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(30, 8))
    rows = [(i, np.float32(middle[i % 30] + 0.5 * rng.normal(size=8)).tolist()) for i in range(3000)]
    want, hit, total = brute(rows, 20, 20), 0, 0
    got = {}
    for r in neighbours.search(vectors(spark, rows), 20, share=0.3, least=300, chunk=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q, best in want.items():
        hit += len(got[q] & {i for _, i in best})
        total += len(best)
    assert hit >= 0.9 * total


def test_small_tables(spark):
    assert neighbours.search(vectors(spark, [])).count() == 0
    assert neighbours.search(vectors(spark, [(0, [1.0, 2.0])])).count() == 0
    assert [tuple(r) for r in neighbours.search(vectors(spark, [(0, [1.0]), (0, [1.0]), (7, [2.0])])).collect()] == [(0, 1, 7, 2.0)]


def test_lengths_are_searched_on_their_own(spark):
    rng = np.random.default_rng(8)
    rows = [(i, np.float32(rng.normal(size=8 if i % 3 else 5)).tolist()) for i in range(240)] + [(1000, [2.0]), (1001, [3.0])]
    got = {}
    for r in neighbours.search(vectors(spark, rows), 5, share=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = {}
    for n in (8, 5, 1):
        good = [(i, np.array(v)) for i, v in rows if len(v) == n]
        for q, v in good:
            if q % 20 == 0:
                best = sorted(((-float(v @ w), i) for i, w in good if i != q))[:5]
                want[q] = [(k + 1, i) for k, (_, i) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == want


def test_more_wanted_than_least(spark):
    rng = np.random.default_rng(9)
    rows = [(i, np.float32(rng.normal(size=6)).tolist()) for i in range(300)]
    found = neighbours.search(vectors(spark, rows), 120, share=0.0, least=10).groupBy("query_id").count().collect()
    assert len(found) == 15 and all(r["count"] == 120 for r in found)


def test_recall_at_the_registered_defaults(spark):
    """On the table's own vectors: all of sf0.01's queries against brute force."""
    import pyarrow.parquet as pq
    path = "/root/testdata/sf0.01/embeddings.parquet"
    table = pq.read_table(path, columns=["vec_id", "embedding"])
    ids, m = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), float)
    hit = total = 0
    got = {}
    for r in neighbours.search(spark.read.parquet(path), 20, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in ids[ids % 20 == 0].tolist():
        score = m @ m[np.flatnonzero(ids == q)[0]]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hit += len(got[q] & set(best.tolist()))
        total += 20
    assert hit >= 0.9 * total
