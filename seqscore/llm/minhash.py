"""Near duplicates by an inverted join on MinHash signatures, confirmed on full shingle sets.

1. Documents with equal sets of word shingles are one class. A class has a signature of
   ``COORDINATES`` minima; coordinate and value make a token.
2. Classes are posted under their tokens. At the threshold of 0.8 a pair agrees in 51 of 64
   coordinates on average; pairs with ``MATCHES`` = 32 or more are candidates (a pair of
   similarity 0.8 has fewer with a chance of about 1e-7, one of 0.85 of about 1e-11). Two
   classes with 32 equal tokens of 64 share one of the first 33 in any common order, so only a
   class's 33 rarest tokens are posted; those nobody else has count among them. A class with
   more than 32 such tokens has no partner.
3. In each posting the members' signatures are counted against each other, from one member on
   to those that are not reached yet, so a group of near copies costs a pass, not all pairs.
   Only a spanning forest of the candidates leaves; its components are clusters.
4. In each cluster candidates are confirmed on the sets of their whole texts, again from member
   to members not reached yet; only a spanning forest of the links leaves.

Postings and clusters beyond a task's share are cut into blocks, and each pair of blocks is a
task of its own: no pair is lost, and no task grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqscore.llm.common import cut_lineage, slices
from seqscore.llm.components import connected_components

COORDINATES, MATCHES = 64, 32
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(bodies: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words of each text; of all words
    if there are fewer; none without words. A-Z are lowered, ASCII white space splits."""
    known = WordHashes()
    out = []
    for body in bodies:
        words = body.lower().split()  # bytes: only A-Z change, only ASCII white space splits
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(width, len(h))
        if not size:
            out.append(h)
            continue
        n = len(h) - size + 1
        total = mix(h[:n] + np.uint64(size))
        for k in range(1, size):
            total = mix(total * ODD + h[k:k + n])
        out.append(np.unique(total))
    return out


def _coordinates(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32),
            rng.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))


def signature(shingles: np.ndarray, salt: np.ndarray, odd: np.ndarray, block: int = 512) -> np.ndarray:
    """The least of the shingles' hashes under each of the coordinates' functions."""
    out = np.full(len(odd), 0xFFFFFFFF, np.uint32)
    words = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(words), block):
        np.minimum(out, ((words[at:at + block, None] ^ salt) * odd).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """doc_id, hash (of the text), n_shingles, class (16 bytes, equal for equal sets), signature
    (little-endian 32-bit minima) of every row; no class and signature without words."""
    salt, odd = _coordinates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sets = shingle_sets([t.as_py() or b"" for t in batch.column(2)], width)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s, salt, odd).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "hash", "n_shingles", "class", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, hash long, n_shingles long, class binary, signature binary")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        if batch.num_rows:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, COORDINATES)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(values)), COORDINATES))),
                                              pa.array((values + place).ravel())], ["class", "token"])


def _brief(signature: bytes) -> bytes:
    """One byte a coordinate: equal minima stay equal."""
    return (np.frombuffer(signature, "<u4") >> np.uint32(8)).astype(np.uint8).tobytes()


def in_block_pairs(rows: DataFrame, key: str, parts) -> DataFrame:
    """``rows`` with columns i <= j: a row of a key of several parts goes to each pair of parts
    that its own part (by class) is in, so that any two rows of the key meet."""
    own = F.pmod(F.xxhash64("class"), parts)
    every = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    return rows.withColumn("pair", F.explode(every)).select("*", "pair.i", "pair.j").drop("pair")


def reach(n: int, near) -> list[tuple[int, int]]:
    """A spanning forest of 0 to n - 1: ``near(one, others)`` tells which others link to one.
    Each is compared with those not reached before only."""
    rest, edges = np.arange(n), []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            one = front.pop()
            hit = near(one, rest)
            edges += [(one, int(x)) for x in rest[hit]]
            front += rest[hit].tolist()
            rest = rest[~hit]
    return edges


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links from rows (token, i, j, class, brief) in this order of groups: all pairs
    of a posting of few members at once, and a forest of the larger ones."""
    def links(table: pa.Table) -> pa.RecordBatch:
        names = np.array(table.column("class").to_pylist(), dtype=object)
        brief = np.frombuffer(b"".join(table.column("brief").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        keys = np.stack([table.column(c).to_numpy() for c in ("token", "i", "j")])
        head = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
        size = np.diff(np.append(head, len(names)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in range(2, 9):
            at = head[size == m]
            for x in range(m):
                for y in range(x + 1, m):
                    a.append(at + x)
                    b.append(at + y)
        a, b = np.concatenate(a), np.concatenate(b)
        near = (brief[a] == brief[b]).sum(axis=1) >= MATCHES
        a, b = [a[near]], [b[near]]
        for at, m in zip(head[size > 8].tolist(), size[size > 8].tolist()):
            mine = brief[at:at + m]
            edges = np.array(reach(m, lambda one, others: (mine[others] == mine[one]).sum(axis=1) >= MATCHES), np.int64).reshape(-1, 2)
            a.append(at + edges[:, 0])
            b.append(at + edges[:, 1])
        pairs = {(min(x, y), max(x, y)) for x, y in zip(names[np.concatenate(a)], names[np.concatenate(b)])}
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        keys = np.stack([table.column(c).to_numpy() for c in ("token", "i", "j")])
        last = int(np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))[-1])
        if last:
            yield links(table.slice(0, last))
        kept = table.slice(last).combine_chunks()
    if kept is not None:
        yield links(kept)


def candidates(classes: DataFrame, most: int) -> DataFrame:
    """(a, b): a spanning forest, posting by posting, of the classes with ``MATCHES`` or more
    equal coordinates. ``most``: members of a posting that a task takes."""
    tokens = classes.select("class", "signature").mapInArrow(_tokens, "class binary, token long").repartition("token")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = tokens.join(counts, "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("members", "token"))).alias("tokens"))
    # rarest first; those that no other class has come before them all
    rare = shared.where(F.size("tokens") >= MATCHES).select("class", F.slice("tokens", 1, F.size("tokens") - (MATCHES - 1)).alias("tokens"))

    def brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_brief(s) for s in batch.column(1).to_pylist()], pa.binary())], ["class", "brief"])

    marks = classes.select("class", "signature").mapInArrow(brief, "class binary, brief binary")
    posts = rare.join(marks, "class").select("class", "brief", F.explode("tokens").alias("t")).select("class", "brief", "t.token", "t.members")
    dealt = in_block_pairs(posts, "token", F.ceil(F.col("members") / F.lit(most)).cast("long"))
    return (dealt.select("token", "i", "j", "class", "brief").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
            .mapInArrow(_posted, "a binary, b binary"))


def confirmed(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the sets with 100 * intersection >= percent * union."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(values), bool)

    def near(one: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        fit = np.flatnonzero((100 * np.minimum(sizes[others], sizes[one]) >= percent * np.maximum(sizes[others], sizes[one])))
        if not len(fit):
            return out
        mine = flat[starts[one]:starts[one] + sizes[one]]
        mark[mine] = True
        n = sizes[others[fit]]
        first = np.cumsum(n) - n
        places = np.repeat(starts[others[fit]] - first, n) + np.arange(n.sum())
        both = np.add.reduceat(mark[flat[places]], first, dtype=np.int64)
        mark[mine] = False
        out[fit] = 100 * both >= percent * (n + sizes[one] - both)
        return out

    return reach(len(sets), near)


def near_documents(docs: DataFrame, width: int = 4, percent: int = 80, text: str = "text", posting_rows: int = 8192,
                   cluster_shingles: int = 2 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Rows link if 100 * intersection >= ``percent`` * union of their sets of ``width``-word
    shingles (``percent`` of 80 or more: the candidates are made for it); component_id is the
    smallest doc_id that links reach, kept is doc_id = component_id. A null or wordless text has
    an empty set, no links and itself as component. Rows of equal id and text are equal in all;
    of a null id, component_id is the smallest other id of its component, null if there is
    none, and kept is false. An empty table gives no rows; other columns are not read.
    """
    if percent < 80:
        raise ValueError("candidates are complete from 80 percent on")
    rows = cut_lineage(signatures(docs, width, text))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")  # null ids come last
    classes = cut_lineage(rows.where("class is not null").groupBy("class").agg(
        F.min("signature").alias("signature"), F.min("n_shingles").alias("n_shingles"), F.min(first).alias("first")))
    clusters = connected_components(candidates(classes, posting_rows))
    member = cut_lineage(clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
                         .select(F.col("node").alias("class"), F.col("root").alias("cluster"))
                         .join(classes.select("class", "n_shingles", "first"), "class"))
    parts = member.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / F.lit(cluster_shingles)).cast("long").alias("parts"))
    named = member.join(parts, "cluster").select("class", "cluster", "parts", F.col("first.doc_id").alias("_id"), F.col("first.hash").alias("_hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_own"), F.xxhash64(text).alias("_hash"), F.col(text).cast("binary").alias("text"))
    found = (texts.join(named, texts["_own"].eqNullSafe(named["_id"]) & (texts["_hash"] == named["_hash"]))
             .select("class", "cluster", "parts", "_own", texts["_hash"], "text").dropDuplicates(["_own", "_hash"]))

    def verify(table: pa.Table) -> pa.Table:
        names = table.column("class").to_pylist()
        sets = shingle_sets([t.as_py() or b"" for t in table.column("text")], width)
        edges = confirmed(sets, percent)
        return pa.table({"a": pa.array([names[x] for x, _ in edges], pa.binary()), "b": pa.array([names[y] for _, y in edges], pa.binary())})

    links = in_block_pairs(found, "cluster", F.col("parts")).select("cluster", "i", "j", "class", "text").groupBy("cluster", "i", "j").applyInArrow(verify, "a binary, b binary")
    roots = connected_components(links).withColumnRenamed("node", "class")
    whole = classes.select("class", "first").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    ids = whole.groupBy("root").agg(F.min("first").alias("least")).select("root", F.col("least.doc_id").alias("component_id"))
    of = whole.join(ids, "root").select("class", "component_id", F.lit(True).alias("known"))
    out = rows.select("doc_id", "n_shingles", "class").join(of, "class", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
