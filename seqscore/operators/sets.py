"""Set operations and corpus-level counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqscore.functions.sequence import explode_kmers


def split_union(splits: DataFrame, dataset: str) -> DataFrame:
    """Distinct sequences of train + test + dev of one dataset."""
    s = splits.filter(F.col("dataset") == dataset)
    parts = [s.filter(F.col("split") == x).select("sequence") for x in ("train", "test", "dev")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def jaccard(splits: DataFrame, base: str) -> DataFrame:
    """For every other dataset: |base ∩ d|, |base ∪ d| and their ratio.

    One shuffle on ``sequence`` tags each distinct sequence with base membership; the
    per-dataset counts are then a second partial aggregation. |base| is a scalar
    (one-row aggregate) that enters the final projection as a literal."""
    d = splits.select("dataset", "sequence").distinct()
    per_seq = d.groupBy("sequence").agg(
        F.max((F.col("dataset") == base).cast("int")).alias("in_base"),
        F.collect_set(F.when(F.col("dataset") != base, F.col("dataset"))).alias("others"))
    n_base = d.filter(F.col("dataset") == base).count()
    per_ds = per_seq.select("in_base", F.explode("others").alias("dataset")).groupBy("dataset").agg(
        F.sum("in_base").cast("bigint").alias("intersection"),
        F.sum(1 - F.col("in_base")).cast("bigint").alias("_only"))
    union = (F.lit(n_base) + F.col("_only")).cast("bigint")
    return per_ds.select("dataset", "intersection", union.alias("union_size"),
                         F.when(union > 0, F.col("intersection") / union.cast("double")).otherwise(0.0).alias("jaccard"))


def abs_diff_columns(wide: DataFrame, models, baseline_set: str) -> DataFrame:
    """Sum over rows of |model column - its family's baseline column|.

    One global partial aggregation over the wide table, then unpivoted to
    (model, train_on, abs_diff): no join of the long table to itself."""
    aggs = []
    for _, m, t in models:
        base = F.col(f"{m}_{baseline_set}")
        aggs.append(F.sum(F.abs(F.col(f"{m}_{t}") - base)).cast("bigint").alias(f"{m}__{t}"))
    one = wide.agg(*aggs)
    names = [f"{m}__{t}" for _, m, t in models]
    stacked = one.select(F.explode(F.array(*[F.struct(F.lit(n.split("__")[0]).alias("model"),
                                                      F.lit(n.split("__")[1]).alias("train_on"),
                                                      F.col(n).alias("abs_diff")) for n in names])).alias("r"))
    return stacked.select("r.model", "r.train_on", "r.abs_diff")


def split_sizes(splits: DataFrame, splits_order=("dev", "test", "train")) -> DataFrame:
    """Rows per dataset and split, one column per split."""
    return splits.groupBy("dataset").pivot("split", list(splits_order)).count().fillna(0, list(splits_order))


def kmer_counts(df: DataFrame, k: int, col: str = "sequence", by: list[str] | None = None) -> DataFrame:
    """K-mer frequencies, corpus-wide (or per ``by`` key): explode + partial aggregation."""
    keys = by or []
    e = explode_kmers(df, col, k, keys)
    return e.groupBy(*keys, "kmer").agg(F.count(F.lit(1)).alias("n"))


def intersect_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in both inputs."""
    return a.intersect(b)


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct ids of either input."""
    return a.union(b).distinct()
