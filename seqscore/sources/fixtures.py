"""Fixture tables derived from the driver's parquet tables (see FIXTURES.md part B).

All derivations are per-row projections of ``orders`` (one row per order key), so they
scale with the input; only the keys are shuffled, to all cores. The model grid is exploded from a fixed
27-entry literal array (no join). Spark and the DuckDB oracle compute identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqscore.session import spread, table_path

HEX = "0123456789abcdef"
ACGT4 = "ACGTACGTACGTACGT"

# The model grid of the fixture (position in the hash, family, training set).
FAMILIES = ["DNABERT2", "UTRLM", "GROVER"]
TRAIN_SETS = ["mpra_data", "cao2021", "hek", "hek_muscle", "hek_muscle_pc3",
              "hek_pc3", "muscle", "muscle_pc3", "pc3"]
MODELS = [(i * len(TRAIN_SETS) + j + 1, fam, ts)
          for i, fam in enumerate(FAMILIES) for j, ts in enumerate(TRAIN_SETS)]
BASELINE_SET = "cao2021"


def model_column(model: str, train_on: str) -> str:
    return f"{model}_{train_on}"


PRED_COLUMNS = [model_column(m, t) for _, m, t in MODELS]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys, dealt to all cores: a file of one row group is one scan task, and what is derived
    from a key (hashes, 27 predictions) costs far more than to read it."""
    return spread(spark.read.parquet(table_path(sf_dir, "orders")).select("o_orderkey"), "o_orderkey")


def _key_columns() -> list[Column]:
    k = F.col("o_orderkey")
    blk = F.floor(k / 40).cast("bigint")
    cls = (F.when(k % 7 == 0, F.lit(1000000) + k)
           .otherwise(blk * 2 + F.when(k % 40 < 5, 1).otherwise(0))).cast("bigint")
    return [k.alias("seq_index"), cls.alias("ClsID"), (blk % 3).alias("fam"),
            F.md5(F.concat(F.lit("p"), k.cast("string"))).alias("ph"),
            F.md5(F.concat(F.lit("y"), k.cast("string"))).alias("yh")]


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_index, ClsID, fam, ph, yh, thr (the family's prediction threshold digit).

    ``thr`` is computed once per row so that each of the 27 predictions is a single
    comparison; inlining the CASE into every prediction makes one generated method too
    large for the JIT."""
    k = _orders(spark, sf_dir).select(*_key_columns())
    return k.withColumn("thr", F.when(F.col("fam") == 0, "6").when(F.col("fam") == 1, "3").otherwise("1"))


def _sequence_expr() -> Column:
    head = F.substring(F.translate(F.md5(F.concat(F.lit("f"), F.col("ClsID").cast("string"))), HEX, ACGT4), 1, 20)
    tail = F.substring(F.translate(F.md5(F.concat(F.lit("s"), F.col("seq_index").cast("string"))), HEX, ACGT4), 1, 5)
    return F.concat(head, tail)


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_index, ClsID, sequence (25 letters)."""
    return keys(spark, sf_dir).select("seq_index", "ClsID", _sequence_expr().alias("sequence"))


def _pred(pos) -> Column:
    ch = F.substring(F.col("ph"), pos, 1) if isinstance(pos, int) else F.expr(f"substr(ph, {pos}, 1)")
    return (ch >= F.col("thr")).cast("int")


def _digits_reaching(places: list[int]) -> Column:
    """How many of the hash digits at ``places`` reach ``thr``: the sum of their ``_pred``, as one short
    expression (the sum of 24 comparisons is a method that the JIT leaves alone)."""
    runs: list[list[int]] = []
    for p in places:
        if runs and p == runs[-1][-1] + 1:
            runs[-1].append(p)
        else:
            runs.append([p])
    digits = F.concat(*[F.substring("ph", r[0], len(r)) for r in runs])
    below = lambda t: F.length(F.translate(digits, HEX[:HEX.index(t)], ""))
    return F.when(F.col("thr") == "6", below("6")).when(F.col("thr") == "3", below("3")).otherwise(below("1"))


def _proba(pos) -> Column:
    ch = F.substring(F.col("ph"), pos, 1) if isinstance(pos, int) else F.expr(f"substr(ph, {pos}, 1)")
    return F.conv(ch, 16, 10).cast("double") / F.lit(15.0)


def pred_wide(spark: SparkSession, sf_dir: str, with_proba: bool = False) -> DataFrame:
    """The ``combined_results`` table: seq_index + one 0/1 column per model (+ ``*_proba``)."""
    cols = [F.col("seq_index")]
    for pos, m, t in MODELS:
        cols.append(_pred(pos).alias(model_column(m, t)))
        if with_proba:
            cols.append(_proba(pos).alias(model_column(m, t) + "_proba"))
    return keys(spark, sf_dir).select(*cols)


def pred_long(spark: SparkSession, sf_dir: str, beside: DataFrame | None = None) -> DataFrame:
    """Canonical long predictions: seq_index, model, train_on, pred, proba, and the columns of
    ``beside`` (joined on seq_index while there is one row per key).

    The 27-model grid is a literal array exploded per key row (a generator, no join)."""
    grid = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(m).alias("model"), F.lit(t).alias("train_on"))
                     for p, m, t in MODELS])
    k = keys(spark, sf_dir).select("seq_index", "thr", "ph")
    extra = []
    if beside is not None:
        extra = [c for c in beside.columns if c != "seq_index"]
        k = k.join(beside, "seq_index")
    return k.select("*", F.inline(grid)).select("seq_index", "model", "train_on", _pred("pos").alias("pred"),
                                                _proba("pos").alias("proba"), *extra)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_index, prediction_score (sum of the 24 non-baseline predictions)."""
    from seqscore.operators.scores import prediction_score
    return prediction_score(pred_wide(spark, sf_dir), exclude_suffix=BASELINE_SET).select(
        "seq_index", "prediction_score")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster membership in the clustering tool's format: ClsID, SeqID, Score, Status.

    The score is summed on the key row itself (same value as ``scores``), so no join."""
    k = keys(spark, sf_dir)
    score = _digits_reaching([p for p, _, t in MODELS if t != BASELINE_SET])
    return k.select(
        "ClsID",
        F.concat(F.lit(">gi|"), (F.col("seq_index") + 1).cast("string"), F.lit("|"),
                 score.cast("string")).alias("SeqID"),
        (F.lit(0.8) + F.conv(F.substring("yh", 2, 1), 16, 10).cast("double") / F.lit(80.0)).alias("Score"),
        F.when(F.col("seq_index") % 40 == 8, "C").when(F.col("seq_index") % 11 == 0, "E")
         .otherwise("M").alias("Status"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_index, test_on, label."""
    thr = F.when(F.col("fam") == 0, "b").when(F.col("fam") == 1, "8").otherwise("4")
    return keys(spark, sf_dir).select(
        "seq_index",
        F.concat(F.lit("set"), (F.col("seq_index") % 8).cast("string")).alias("test_on"),
        F.when(F.substring("yh", 1, 1) >= thr, 1).otherwise(0).alias("label"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, split, sequence: a base set and 16 hash-assigned subsets."""
    lib = library(spark, sf_dir)
    split = (F.when(F.col("seq_index") % 10 == 0, "test")
             .when(F.col("seq_index") % 10 == 1, "dev").otherwise("train"))
    sub = F.concat(F.lit("sub"), F.substring(F.md5(F.concat(F.lit("d"), F.col("seq_index").cast("string"))), 1, 1))
    both = F.array(F.lit("base"), sub)
    return lib.select(F.explode(both).alias("dataset"), split.alias("split"),
                      F.substring("sequence", 14, 12).alias("sequence"))
