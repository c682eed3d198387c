"""Column expressions over sequences and ids (C1-C9). All JVM-side, codegen friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def gc_content(col: str | Column) -> Column:
    """(count of G + count of C) / length; 0 for the empty sequence."""
    s = _c(col)
    n = F.length(s)
    gc = n - F.length(F.translate(s, "GC", ""))
    return F.when(n > 0, gc.cast("double") / n.cast("double")).otherwise(F.lit(0.0))


def kmers(col: str | Column, k: int) -> Column:
    """Overlapping k-mers as ``array<string>``; empty when length < k."""
    s = _c(col)
    n = F.length(s)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1),
                                      lambda i: s.substr(i, F.lit(k)))) \
        .otherwise(F.array().cast("array<string>"))


def explode_kmers(df, col: str, k: int, keys: list[str], with_pos: bool = False):
    """Rows (keys..., [pos,] kmer) for every k-mer occurrence: an exploded position range
    and ``substr`` (generated code, no array lambdas); nothing for sequences shorter than k."""
    e = df.filter(F.length(col) >= k).select(*keys, col, F.explode(F.sequence(F.lit(1), F.length(col) - k + 1)).alias("pos"))
    e = e.withColumn("kmer", F.expr(f"substr({col}, pos, {k})"))
    return e.select(*keys, *(["pos"] if with_pos else []), "kmer")


def kmer_positions(col: str | Column, k: int) -> Column:
    """``array<struct<pos:int, kmer:string>>`` of every k-mer with its 1-based start."""
    s = _c(col)
    n = F.length(s)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1),
                                      lambda i: F.struct(i.alias("pos"), s.substr(i, F.lit(k)).alias("kmer")))) \
        .otherwise(F.array().cast("array<struct<pos:int,kmer:string>>"))


def kmer_sentence(col: str | Column, k: int) -> Column:
    """Overlapping k-mers joined by single blanks."""
    return F.array_join(kmers(col, k), " ")


def complement(col: str | Column, reverse: bool = False) -> Column:
    """C4: A<->T, C<->G; other letters pass through. ``reverse`` gives the true
    reverse complement (the reference's helper does not reverse)."""
    c = F.translate(_c(col), "ACGT", "TGCA")
    return F.reverse(c) if reverse else c


def seqid_index(col: str | Column = "SeqID", shift: int = 1) -> Column:
    """The index field of ``>gi|index|score`` minus ``shift``."""
    return (F.split_part(_c(col), F.lit("|"), F.lit(2)).cast("bigint") - F.lit(shift)).cast("bigint")


def seqid_score(col: str | Column = "SeqID") -> Column:
    """The score field of ``>gi|index|score``."""
    return F.split_part(_c(col), F.lit("|"), F.lit(3)).cast("int")


def motif_rank(col: str | Column = "motif_ID") -> Column:
    """Rank part of ``n-MOTIF`` (split on '-', valid for ranks >= 10)."""
    return F.split_part(_c(col), F.lit("-"), F.lit(1)).cast("int")


def motif_word(col: str | Column = "motif_ID") -> Column:
    """Motif part of ``n-MOTIF``."""
    return F.split_part(_c(col), F.lit("-"), F.lit(2))


def align_distance(score: str | Column) -> Column:
    """1 / (1 + 2^score)."""
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(2.0), _c(score)))


def source_fields(path: str | Column, pattern: str = r"([A-Za-z0-9]+)_([A-Za-z0-9_]+)\.[a-z]+$"):
    """(model, train set) parsed out of a file name."""
    p = _c(path)
    return F.regexp_extract(p, pattern, 1), F.regexp_extract(p, pattern, 2)


def mean_pool(col: str | Column) -> Column:
    """Mean of an ``array<array<float>>`` of token vectors -> one ``array<double>``."""
    a = _c(col)
    n = F.size(a)
    dim = F.size(a.getItem(0))
    return F.transform(F.sequence(F.lit(0), dim - 1),
                       lambda j: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.getItem(j).cast("double")) / n)
