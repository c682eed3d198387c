"""Minimax contiguous partition into shards, with DataFrame operations only.

Rows with equal text form one atomic group. Groups are ordered by a 64-bit hash of the
text, and the ordered sequence is cut into contiguous shards so that the largest shard is
as small as any such cut allows: the smallest feasible capacity is found by binary search,
each candidate checked by greedy filling, and the greedy cuts at that capacity are used.

The driver never holds the groups. It holds sizes of at most a few ten thousand intervals
of the hash order; intervals in which some cut may still fall are split further, until all
such intervals are single groups. What the driver holds is bounded by ``bits`` and the
number of shards, not by the input.

A group larger than an even share makes the minimax bound loose for all other shards, so
such groups (fewer than ``n_shards``) get a shard each, and the rest is cut contiguously.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqscore.llm.common import cut_lineage

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def greedy_cuts(prefix: list[int], capacity: int, most: int) -> list[int] | None:
    """Ends (indices into ``prefix``) of greedily filled shards, None if over ``most`` are
    needed. ``prefix[i]`` is the size of the first i groups."""
    ends, at, n = [], 0, len(prefix) - 1
    while at < n:
        end = bisect_right(prefix, prefix[at] + capacity) - 1
        if end == at or len(ends) == most:
            return None
        ends.append(end)
        at = end
    return ends


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the smallest capacity at which the greedy check needs at most
    ``shards`` shards."""
    prefix = [0, *accumulate(sizes)]
    low, high = max([0, *sizes, -(-prefix[-1] // max(shards, 1))]), prefix[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(prefix, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _unsettled(items: list[tuple], shards: int) -> tuple[list[int], list[int]]:
    """(indices of intervals that still have to be split, greedy ends at the capacity found).

    ``items``: (lowest key, highest key, size), in order. The true capacity lies between the
    one for freely divisible intervals and the one for indivisible ones; cut j then lies
    between the cuts that these two give."""
    sizes = [s for _, _, s in items]
    prefix = [0, *accumulate(sizes)]
    coarse = smallest_capacity(sizes, shards)
    fluid = max([0, -(-prefix[-1] // max(shards, 1)), *(s for a, b, s in items if a == b)])
    ends = greedy_cuts(prefix, coarse, shards)
    first, last, split = 0, 0, set()
    for _ in range(shards):
        first = max(first, bisect_right(prefix, prefix[first] + fluid) - 1)
        last = min(last + coarse, prefix[-1])
        for i in range(first, len(items)):
            if prefix[i] >= last:
                break
            if items[i][0] != items[i][1]:
                split.add(i)
    return sorted(split), ends


def minimax_cuts(groups: DataFrame, shards: int, bits: int = 12) -> tuple[list[int], int]:
    """Keys at which shards 1, 2, ... start, and the capacity. ``groups``: ``key`` long,
    ``size`` long, rows of equal key in any number (they are summed)."""
    def summed(df: DataFrame, cell: Column) -> list[tuple]:
        rows = (df.groupBy(cell.alias("cell")).agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("size").alias("s"))
                .collect())
        return [(r.a, r.b, r.s) for r in sorted(rows, key=lambda r: r.a)]

    width = 64 - bits
    items = summed(groups, F.shiftright("key", width))
    while True:
        split, ends = _unsettled(items, shards)
        if not split or width == 0:
            break
        step = min(width, 6)
        width -= step
        # one filter for all intervals that are split: neighbours are joined to ranges
        ranges: list[list[int]] = []
        for k, i in enumerate(split):
            if k and split[k - 1] == i - 1:
                ranges[-1][1] = items[i][1]
            else:
                ranges.append([*items[i][:2]])
        chosen = set(split)
        inside = F.lit(False)
        for a, b in ranges:
            inside = inside | F.col("key").between(a, b)
        finer = summed(groups.where(inside), F.shiftright("key", width))
        items = sorted([x for i, x in enumerate(items) if i not in chosen] + finer)
    capacity = max([0, *(sum(s for _, _, s in items[a:b]) for a, b in zip([0, *ends], ends))])
    return [items[end][0] for end in ends[:-1]], capacity


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text", overhead: int = 8,
                    rows_per_cell: int = 4096) -> DataFrame:
    """Every row of ``docs`` with its shard: doc_id, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text plus ``overhead`` (a null text has no bytes). Rows with
    equal text go to the same shard; null and empty text count as one group. slot numbers a
    shard's rows from 0 without a gap, in the order of (cell, doc_id); a cell is a hash class
    of rows, so no task numbers more than about ``rows_per_cell`` rows, however large a shard
    or a group is. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col("doc_id"),
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("key")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    large = [(r.key, r["size"]) for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect()]
    alone: list[int] = []
    left = total
    for key, size in large:
        if len(alone) + 1 >= shards or size * (shards - len(alone)) <= left:
            break
        alone.append(key)
        left -= size
    rest = rows.where(~F.col("key").isin(alone)) if alone else rows
    cuts, _ = minimax_cuts(rest.select("key", "size"), shards - len(alone))
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") >= F.lit(cut)).cast("int")
    for i, key in enumerate(alone):
        shard = F.when(F.col("key") == F.lit(key), F.lit(shards - 1 - i)).otherwise(shard)
    cells = max(1, -(-count // (shards * rows_per_cell)))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "key"), F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "key")
    return (placed.withColumn("at", F.row_number().over(inside) - 1)
            .join(starts, ["shard", "cell"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot")))
