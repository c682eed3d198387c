import random

import pytest

from seqscore.operators import clusters as C


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_groups_over_partition_borders(spark, partitions):
    rng = random.Random(2)
    values = [rng.randrange(0, 60) * 3 + rng.randrange(2) for _ in range(200)] + [5000] * 30 + [7000]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.v: (r.n, r.group) for r in C.density_groups(spark.createDataFrame([(v,) for v in values], "v long"), "v", 4, 20).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    group, groups, last = 0, {}, None
    for v in sorted(set(values)):
        group += last is not None and v - last > 4
        groups.setdefault(group, []).append(v)
        last = v
    want = {v: (values.count(v), g if sum(values.count(x) for x in vs) >= 20 else -1) for g, vs in groups.items() for v in vs}
    assert got == want and len(groups) > 2
