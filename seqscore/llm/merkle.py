"""Merkle manifest of a dataset, with proofs from checkpoints.

A row is a leaf. Per group (source) the leaves, by id, form a tree of runs of ``fan`` nodes;
the groups' roots, by group, form another tree over them. Only every ``every``-th level is
stored ("checkpoint"). A proof is made from the top down: each aligned subtree between two
stored levels is built again from its stored lower level, gives each of its nodes the siblings
on the way up, followed by those of the subtree's root, and is thrown away. So no task holds
more than one subtree (``fan ** every`` nodes), and what is stored is a small share of the leaves.

Positions come from a frozen range partitioning and offsets per partition, so a group with
most of the rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqscore.llm.common import cut_lineage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value):
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**changed):
    """Hash of a row's fields; ``changed`` gives other expressions for some."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in COLUMNS]), 256)


def positions(rows: DataFrame, *order) -> DataFrame:
    """``rows`` (with a column key) with pos, the place from 0 in each key by ``order``, and n, the
    rows of the key. Rows that tie are placed in some fixed order."""
    tie = F.monotonically_increasing_id()
    spread = rows.withColumn("tie", tie).repartitionByRange("key", *order, "tie")
    frozen = cut_lineage(spread.withColumn("part", F.spark_partition_id()))
    counts = frozen.groupBy("key", "part").agg(F.count(F.lit(1)).alias("here"))
    by_key = Window.partitionBy("key")
    counts = counts.select("key", "part", F.sum("here").over(by_key).alias("n"),
                           (F.sum("here").over(by_key.orderBy("part")) - F.col("here")).alias("before"))
    local = F.row_number().over(Window.partitionBy("key", "part").orderBy(*order, "tie")) - 1
    return (frozen.withColumn("local", local).join(counts, ["key", "part"])
            .withColumn("pos", F.col("before") + F.col("local")).drop("tie", "part", "local", "before"))


def levels_above(nodes: list[str], fan: int, levels: int) -> list[list[str]]:
    """The nodes and ``levels`` levels over them; one node alone at the top of all stays as it is
    by asking for no level."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i:i + fan])) for i in range(0, len(below), fan)])
    return out


def height(n: int, fan: int) -> int:
    """Levels over ``n`` nodes until one is left."""
    up = 0
    while n > 1:
        n, up = -(-n // fan), up + 1
    return up


def _blocks(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Rows that follow one another with equal ``keys``."""
    block: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if block and any(row[k] != block[0][k] for k in keys):
                yield block
                block = []
            block.append(row)
    if block:
        yield block


def _gathered(rows: DataFrame, size: int) -> DataFrame:
    """Rows of one aligned subtree in one partition, one after another, by place."""
    return (rows.withColumn("block", F.floor(F.col("pos") / size).cast("long")).repartition("key", "block")
            .sortWithinPartitions("key", "block", "pos"))


def checkpoints(nodes: DataFrame, fan: int, every: int) -> list[DataFrame]:
    """Stored levels of the trees over ``nodes`` (key, pos, hash, n), from the nodes on to the
    one that holds the roots alone."""
    size = fan ** every

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, "key", "block"):
            n = block[0]["n"]
            top = levels_above([r["hash"] for r in block], fan, min(every, height(n, fan)))[-1][0]
            yield pa.RecordBatch.from_pylist([{"key": block[0]["key"], "pos": block[0]["block"], "hash": top, "n": -(-n // size)}],
                                             pa.schema([("key", pa.string()), ("pos", pa.int64()), ("hash", pa.string()), ("n", pa.int64())]))

    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(cut_lineage(_gathered(out[-1], size).mapInArrow(up, "key string, pos long, hash string, n long")))
    return out


def _pairs(level: list[str], i: int, fan: int) -> tuple[str, str]:
    """Siblings before and after node ``i``."""
    a = i - i % fan
    return "".join(level[a:i]), "".join(level[i + 1:a + fan])


def _paths(block: list[dict], fan: int, every: int):
    """(row, its path) of the nodes of one subtree, whose first row tells of its root."""
    root, nodes = block[0], block[1:]
    rebuilt = levels_above([r["hash"] for r in nodes], fan, min(every, height(nodes[0]["n"], fan)))
    above = [root["path"]]  # of the nodes of the level over the present one
    for level in reversed(rebuilt[1:-1]):
        above = [["|".join(_pairs(level, i, fan)), *above[i // fan]] for i in range(len(level))]
    for i, row in enumerate(nodes):
        yield row, ["|".join(_pairs(rebuilt[0], i, fan)), *above[i // fan]] if len(rebuilt) > 1 else root["path"]


TOLD = "path array<string>, subroot string, root string"


def _with_roots(nodes: DataFrame, above: DataFrame, size: int) -> DataFrame:
    """Subtrees in partitions of their own, the row of each one's root first."""
    mine = nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    roots = above.select("key", F.col("pos").alias("block"), "path", "subroot", "root", F.lit(-1).cast("long").alias("pos"))
    return (mine.unionByName(roots, allowMissingColumns=True).repartition("key", "block").sortWithinPartitions("key", "block", "pos"))


def paths(stored: list[DataFrame], tops: DataFrame, fan: int, every: int) -> DataFrame:
    """Rows (key, pos, path, subroot, root) of the lowest stored level but the leaves, from
    ``tops``: the same of the trees' roots. A path has an entry a level, the siblings before and
    after a node with a bar between."""
    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
        for block in _blocks(batches, "key", "block"):
            told = {k: block[0][k] for k in ("subroot", "root")}
            yield pa.RecordBatch.from_pylist([{"key": row["key"], "pos": row["pos"], "path": path, **told} for row, path in _paths(block, fan, every)], schema)

    above = tops
    for nodes in reversed(stored[1:-1]):
        above = _with_roots(nodes, above, fan ** every).mapInArrow(down, "key string, pos long, " + TOLD)
    return above


def manifest(docs: DataFrame, fan: int = 3, every: int = 6, tampered=None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``.

    A leaf is the hash of the row's fields (``COLUMNS``); a group is a source, null first, then
    by bytes; leaves of a group go by doc_id, null first, and by their hash where ids repeat.
    ``tampered``: condition under which the line feeds of the text are gone when the proof is
    checked (a null id is not tampered with). proof_sha256 is the hash of all siblings up to the
    root; folded_root is what the leaf at hand and these siblings fold to. Rows that repeat give
    a leaf each. Null and empty values differ. An empty table gives no rows; other columns are
    not read.
    """
    gone = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaves = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("key"), leaf_of().alias("hash"),
        F.when(gone, leaf_of(text=F.translate("text", "\n", ""))).alias("other")))
    placed = cut_lineage(positions(leaves, F.col("doc_id").asc_nulls_first(), F.col("hash")))
    stored = checkpoints(placed.select("key", "pos", "hash", "n"), fan, every)
    # the tree over the groups
    groups = positions(stored[-1].select(F.lit("").alias("key"), F.col("key").alias("of"), "hash"), F.col("of"))
    groups = cut_lineage(groups)
    upper = checkpoints(groups.select("key", "pos", "hash", "n"), fan, every)
    size = fan ** every

    def last_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
        for block in _blocks(batches, "key", "block"):
            yield pa.RecordBatch.from_pylist([{"key": row["of"], "pos": 0, "path": path, "subroot": row["hash"], "root": block[0]["root"]}
                                              for row, path in _paths(block, fan, every)], schema)

    top = upper[-1].select("key", "pos", F.expr("cast(array() as array<string>)").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    tops = _with_roots(groups.select("key", "of", "pos", "hash", "n"), paths(upper, top, fan, every), size).mapInArrow(last_paths, "key string, pos long, " + TOLD)
    above = paths(stored, tops, fan, every)
    out = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                     ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for block in _blocks(batches, "key", "block"):
            subroot, root = block[0]["subroot"], block[0]["root"]
            for row, path in _paths(block, fan, every):
                proof, node = sha256(), row["other"] or row["hash"]
                for siblings in path:
                    before, after = siblings.split("|")
                    proof.update((before + after).encode())
                    node = digest(before + node + after)
                rows.append({"doc_id": row["doc_id"], "leaf": row["hash"], "subroot": subroot, "root": root,
                             "proof_sha256": proof.hexdigest(), "folded_root": node, "verified": node == root})
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, out)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, out)

    return _with_roots(placed, above, size).mapInArrow(
        proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
