import random
import zlib
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from seqscore.llm.sharding import minimax_cuts, shard_documents, smallest_capacity


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9), st.integers(1, 4))
def test_capacity_equals_brute_force(sizes, shards):
    n = len(sizes)
    best = min(max(sum(sizes[a:b]) for a, b in zip((0, *cut), (*cut, n)))
               for k in range(min(shards, n)) for cut in combinations(range(1, n), k))
    assert smallest_capacity(sizes, shards) == best


def test_zoom_finds_the_exact_capacity(spark):
    rng = random.Random(5)
    rows = [(rng.getrandbits(64) - (1 << 63), rng.choice([1, 5, 900])) for _ in range(4000)]
    rows += [((7 << 50) + i, 300) for i in range(500)]  # many neighbours in one coarse interval
    groups = spark.createDataFrame(rows, "key long, size long")
    cuts, capacity = minimax_cuts(groups, 7, bits=4)
    total = {}
    for k, s in rows:
        total[k] = total.get(k, 0) + s
    sizes = [total[k] for k in sorted(total)]
    assert capacity == smallest_capacity(sizes, 7)
    loads = [0] * 7
    for k, s in rows:
        loads[sum(k >= c for c in cuts)] += s
    assert max(loads) == capacity


def test_whole_law(docs_of):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(1, 300) + str(i)) for i in range(600)]
    rows += [(1000 + i, "the same text " * 4) for i in range(120)]  # one group over an even share
    rows += [(2000, None), (2001, ""), (2002, None), (2003, "é" * 5000), (5, rows[5][1]), (None, "no id")]
    out = shard_documents(docs_of(rows, extra=True), 8, rows_per_cell=10).collect()
    assert len(out) == len(rows)
    text = {}
    for i, t in rows:
        text.setdefault((i, zlib.crc32((t or "").encode())), t)
    shard_of, slots, loads = {}, {}, [0] * 8
    for r in out:
        t = text[(r.doc_id, r.text_crc32)] or ""
        assert r["size"] == len(t.encode()) + 8
        assert shard_of.setdefault(t, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(8))
    assert max(loads) < 1.15 * sum(loads) / 8


def test_empty_and_single(docs_of):
    assert shard_documents(docs_of([]), 4).count() == 0
    assert [(r.slot, r["size"]) for r in shard_documents(docs_of([(1, None)]), 4).collect()] == [(0, 8)]
