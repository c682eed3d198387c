import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from seqscore.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, siblings of each node level by level)."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, place in enumerate(at):
            a = place - place % 3
            proofs[i].append((level[a:place], level[place + 1:a + 3]))
            at[i] = place // 3
        level = [h("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], proofs


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    roots, below = [], []
    for s in order:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, proofs = tree([leaf(r) for r in mine])
        roots.append(root)
        below.append((mine, proofs))
    top, above = tree(roots)
    out = []
    for (mine, proofs), root, more in zip(below, roots, above):
        for r, proof in zip(mine, proofs):
            path = proof + more
            bad = r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].replace("\n", ""))) if bad else leaf(r)
            for a, b in path:
                node = h("".join([*a, node, *b]))
            out.append((r[0], leaf(r), root, top, h("".join(x for a, b in path for x in (*a, *b))), node, node == top))
    return sorted(out, key=repr)


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def proofs(df, every):
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    return sorted(map(tuple, merkle.manifest(df, 3, every, odd == 0).collect()), key=repr)


@pytest.mark.parametrize("every", [1, 2, 6])
def test_proofs(spark, every):
    rng = random.Random(every)
    sources = ["hot"] * 6 + ["a", "b", "ä", "", None, "z|"]
    rows = [(i, rng.choice(sources), rng.choice(["en", None, ""]), rng.choice([None, 5]), rng.choice([None, "", "x\ny", "ü" * rng.randrange(9), "a|b" * 2_000])) for i in range(230)]
    rows += [rows[3]] * 2 + [(4, "hot", None, 1, "other"), (None, "hot", None, None, None), (None, None, "en", 2, "\n"), (-5, "one", "-", 1, "-"), (10 ** 12, "two", None, 0, "q\nr")]
    df = made(spark, rows)
    for c in ("key", "pos", "hash", "n", "block", "path", "root", "other", "part", "tie"):
        df = df.withColumn(c, F.lit("clash"))
    got = proofs(df, every)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_one_row_and_none(spark):
    rows = [(1, None, None, None, None)]
    assert proofs(made(spark, rows), 6) == brute(rows)
    assert proofs(made(spark, []), 6) == []


def test_many_groups(spark):
    rows = [(i, f"s{i}", "en", 1, "t\n") for i in range(40)]
    assert proofs(made(spark, rows), 2) == brute(rows)


def test_lone_nodes_are_hashed_on():
    a = [h(str(i)) for i in range(4)]
    assert merkle.levels_above(a, 3, 2)[-1] == [h(h("".join(a[:3])) + h(a[3]))]
    assert [merkle.height(n, 3) for n in (0, 1, 2, 3, 4, 9, 10)] == [0, 0, 1, 1, 2, 2, 3]
