"""Row-level score operators over wide and long prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "seq_index"


def _pred_cols(df: DataFrame, keys=(KEY,), exclude_suffix: str | None = None,
               suffix_filter: str | None = None) -> list[str]:
    out = []
    for c in df.columns:
        if c in keys or c == "sequence" or c.endswith("_proba"):
            continue
        if exclude_suffix and c.endswith("_" + exclude_suffix):
            continue
        out.append(c)
    return out


def row_sum(cols: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols])


def prediction_score(wide: DataFrame, exclude_suffix: str | None = "cao2021",
                     keys=(KEY,)) -> DataFrame:
    """Row sum of every prediction column except keys, ``sequence`` and the
    ``*_{exclude_suffix}`` columns. A projection: no shuffle."""
    cols = _pred_cols(wide, keys, exclude_suffix)
    return wide.withColumn("prediction_score", row_sum(cols).cast("int"))


def prediction_score_long(long: DataFrame, exclude_train_on: str | None = "cao2021",
                          key: str = KEY) -> DataFrame:
    """P1 over the long form: one partial aggregation on the row key."""
    p = F.col("pred") if exclude_train_on is None else \
        F.when(F.col("train_on") != exclude_train_on, F.col("pred")).otherwise(0)
    return long.groupBy(key).agg(F.sum(p).cast("int").alias("prediction_score"))


def model_total(wide: DataFrame, families: list[str], keys=(KEY,)) -> DataFrame:
    """Per-family row sums (every column of the family) and their total."""
    cols = [F.col(k) for k in keys]
    fam_cols = []
    for fam in families:
        members = [c for c in _pred_cols(wide, keys) if c.startswith(fam + "_")]
        fam_cols.append(fam)
        cols.append(row_sum(members).cast("int").alias(fam))
    out = wide.select(*cols)
    return out.withColumn("total", row_sum(fam_cols).cast("int"))


def cast_score(df: DataFrame, col: str = "prediction_score") -> DataFrame:
    """Truncating cast to int."""
    return df.withColumn(col, F.col(col).cast("int"))


def row_mean_proba(long: DataFrame, keys=(KEY,), exclude_train_on: str | None = None) -> DataFrame:
    """Mean of the probability columns of a row (long form -> avg by key).

    ``exclude_train_on=None`` keeps every model (reference parity, Q9)."""
    if exclude_train_on is not None:
        long = long.filter(F.col("train_on") != exclude_train_on)
    return long.groupBy(*keys).agg(F.round(F.avg("proba"), 12).alias("mean_proba"))


def binarize(col: str | Column, threshold: float) -> Column:
    """Proba >= t -> 1 else 0."""
    c = F.col(col) if isinstance(col, str) else col
    return (c >= F.lit(threshold)).cast("int")


def hard_vote_expr(votes: Column, n: Column, tie: Column | int = 0) -> Column:
    """P10: votes > n//2 -> 1; votes == n//2 with even n -> ``tie``; else 0.

    ``tie`` may be a label column (reference behaviour, Q1) or a constant."""
    half = F.floor(n / 2)
    tie_c = tie if isinstance(tie, Column) else F.lit(tie)
    return (F.when(votes > half, 1)
            .when((votes == half) & (n % 2 == 0), tie_c)
            .otherwise(0)).cast("int")


def hard_vote(long: DataFrame, keys=(KEY,), exclude_train_on: str | None = "cao2021",
              tie: str | int = 0) -> DataFrame:
    """P10 over long predictions: per row key, sum and count of votes -> vote.

    ``tie`` is 0, 1 or the name of a label column carried in ``keys``."""
    if exclude_train_on is not None:
        long = long.filter(F.col("train_on") != exclude_train_on)
    agg = long.groupBy(*keys).agg(F.sum("pred").cast("int").alias("votes"),
                                  F.count(F.lit(1)).cast("int").alias("n_models"))
    tie_c = F.col(tie) if isinstance(tie, str) else tie
    return agg.withColumn("vote", hard_vote_expr(F.col("votes"), F.col("n_models"), tie_c))


def logit_head(logits: str | Column) -> tuple[Column, Column]:
    """(positive-class probability, predicted class) from an ``array<double>`` of logits.

    Two logits: softmax + argmax (first maximum wins). One logit: sigmoid, class = p >= 0.5."""
    a = F.col(logits) if isinstance(logits, str) else logits
    two = F.size(a) == 2
    l0, l1 = a.getItem(0), a.getItem(1)
    p_two = F.lit(1.0) / (F.lit(1.0) + F.exp(l0 - l1))
    p_one = F.lit(1.0) / (F.lit(1.0) + F.exp(-l0))
    proba = F.when(two, p_two).otherwise(p_one)
    pred = F.when(two, (F.array_position(a, F.array_max(a)) - 1).cast("int")) \
        .otherwise((p_one >= 0.5).cast("int"))
    return proba, pred


def truncate(col: str | Column, max_len: int) -> Column:
    """Clip a sequence to ``max_len`` letters before scoring."""
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(c, 1, max_len)
