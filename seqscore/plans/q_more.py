"""Registered queries: rank metrics and adjusted p-values over many distinct values, two-limit
sweeps, Q-Q and density tables, ordered reports, and the column functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqscore.functions import sequence as S
from seqscore.functions import stats_math as SM
from seqscore.operators import clusters as C
from seqscore.operators import curves as CV
from seqscore.operators import ensemble as E
from seqscore.operators import metrics as M
from seqscore.operators import scores as SC
from seqscore.operators import sets as ST
from seqscore.operators import stats as T
from seqscore.plans import base as B
from seqscore.plans.registry import query
from seqscore.session import table_path
from seqscore.sources import fixtures as X


def lineitem(spark, d):
    """One row a line: a price with hundreds of thousands of distinct values, a label, a group."""
    return spark.read.parquet(table_path(d, "lineitem")).select(
        "l_linestatus", F.col("l_extendedprice").cast("double").alias("price"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        "l_orderkey", "l_linenumber",
        (F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(1000003)) / F.lit(1000003.0)).alias("p"))


_LINES = """
v_lines as (
  select l_linestatus, cast(l_extendedprice as double) as price, case when l_returnflag = 'R' then 1 else 0 end as label,
         l_orderkey, l_linenumber, ((l_orderkey * 7919 + l_linenumber * 104729) % 1000003) / cast(1000003 as double) as p
  from lineitem),
v_h as (
  select l_linestatus, price, sum(label) as pos, sum(1 - label) as neg from v_lines group by l_linestatus, price)"""


@query("roc_auc_many", """
select l_linestatus, sum(pos * (below + neg / 2.0)) / (sum(pos) * cast(sum(neg) as double)) as auc
from (select *, coalesce(sum(neg) over (partition by l_linestatus order by price rows between unbounded preceding and 1 preceding), 0) as below
      from v_h) t group by l_linestatus""", _LINES)
def q_roc_auc_many(spark, d):
    """A20 / W5 / W6 over a column with as many scores as rows."""
    return M.roc_auc(lineitem(spark, d), ["l_linestatus"], "price")


@query("roc_curve_many", """
select l_linestatus, price as threshold,
       sum(neg) over w / cast(sum(neg) over (partition by l_linestatus) as double) as fpr,
       sum(pos) over w / cast(sum(pos) over (partition by l_linestatus) as double) as tpr
from v_h window w as (partition by l_linestatus order by price desc rows between unbounded preceding and current row)""", _LINES)
def q_roc_curve_many(spark, d):
    """Every distinct score of every group."""
    return M.roc_curve(lineitem(spark, d), ["l_linestatus"], "price")


@query("fdr_bh_many", """
select l_linestatus, l_orderkey, l_linenumber, round(least(1.0, min(p * m / r) over (
         partition by l_linestatus order by r desc rows between unbounded preceding and current row)), 9) as q
from (select *, row_number() over (partition by l_linestatus order by p, l_orderkey, l_linenumber) as r,
             count(*) over (partition by l_linestatus) as m from v_lines) t""", _LINES)
def q_fdr_bh_many(spark, d):
    """Adjusted p-values over all rows of each group."""
    t = T.fdr_bh(lineitem(spark, d), "p", ["l_linestatus"], "q", "global", order_keys=["l_orderkey", "l_linenumber"])
    return t.select("l_linestatus", "l_orderkey", "l_linenumber", F.round("q", 9).alias("q"))


@query("label_slice_many", """
select price, cast(dense_rank() over (order by price) as bigint) as rank from (select distinct price from v_lines) t""", _LINES)
def q_label_slice_many(spark, d):
    """Dense ranks of all distinct values."""
    return C.dense_index(lineitem(spark, d), "price", "rank")


@query("sweep_two_limits", """
select Perc, count(*) as total_clusters, cast(sum(case when n < 2 then 1 else 0 end) as bigint) as below_2,
       cast(sum(case when n < 10 then 1 else 0 end) as bigint) as below_10
from (select p as Perc, cast(floor(ClsID / div) as bigint) as c, count(distinct seq_index) as n
      from v_cm, (values (80, 1), (70, 2), (60, 4)) as g(p, div) group by 1, 2) t group by Perc""")
def q_sweep_two_limits(spark, d):
    """Both size limits of the sweep on one row per threshold, in one pass."""
    per = B.sweep_membership(spark, d).groupBy("Perc", "ClsID").agg(F.countDistinct("seq_index").alias("n"))
    below = [F.sum((F.col("n") < lim).cast("int")).cast("bigint").alias(f"below_{lim}") for lim in (2, 10)]
    return per.groupBy("Perc").agg(F.count(F.lit(1)).alias("total_clusters"), *below)


def _poly(x: str, coefficients: list[float]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _tail(v: str) -> str:
    return f"{_poly(v, SM._C)} / {_poly(v, [*SM._D, 1.0])}"


def _middle() -> str:
    return f"{_poly('r', SM._A)} * q / {_poly('r', [*SM._B, 1.0])}"


@query("qq_table", """
select ClsID, predictions_mean as value, (r - 0.5) / n as position
from (select ClsID, predictions_mean, row_number() over (order by predictions_mean, ClsID) as r, count(*) over () as n from v_stats) t""")
def q_qq_table(spark, d):
    """Every ordered value with its plotting position (r - 0.5) / n."""
    from seqscore.operators.models import row_numbers
    st = B.stats(spark, d).select("ClsID", F.col("predictions_mean").alias("value"))
    n = st.count()
    ranked = row_numbers(st.withColumn("o", F.struct("value", "ClsID")), "o", "r").drop("o")
    return ranked.select("ClsID", "value", ((F.col("r") + 0.5) / F.lit(n)).alias("position"))


@query("density_table", """
select prediction_score, count(*) as n, count(*) / cast(sum(count(*)) over () as double) as density
from v_cs group by prediction_score""")
def q_density_table(spark, d):
    """Share of rows per integer score (bin width 1)."""
    h = C.score_histogram(B.cluster_scores(spark, d)).withColumnRenamed("frequency", "n")
    total = h.agg(F.sum("n")).first()[0]
    return h.select("prediction_score", "n", (F.col("n") / F.lit(total)).alias("density"))


_KERNEL = """
select x, sum(exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) / (n * bw * sqrt(2 * pi())) as density
from (select lo + i * (hi - lo) / 199.0 as x, n, bw from (
        select count(*) as n, min(v) as lo, max(v) as hi, stddev_samp(v) * pow(count(*), -0.2) as bw from v_v) s, (select unnest(range(200)) as i) t) g, v_v
group by x, n, bw"""


@query("smoothed_density", f"select round(x, 6) as x, round(density, 6) as density from ({_KERNEL}) k", "v_v as (select cast(prediction_score as double) as v from v_cs)")
def q_smoothed_density(spark, d):
    """Kernel density of the scores; the oracle sums the kernel over the rows."""
    return CV.smoothed_density(C.score_histogram(B.cluster_scores(spark, d)), "prediction_score", "frequency")


@query("smoothed_gc", """
select prediction_score, round(x, 6) as x, round(sum(exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) / (n * bw * sqrt(2 * pi())), 6) as density
from (select prediction_score, lo - 2 * bw + i * (hi - lo + 4 * bw) / 99.0 as x, n, bw from (
        select prediction_score, count(*) as n, min(gc_content) as lo, max(gc_content) as hi, stddev_samp(gc_content) * 0.3 as bw from v_cs group by 1) s,
        (select unnest(range(100)) as i) t where bw > 0 and hi > lo) g
join (select prediction_score as p, gc_content as v from v_cs) c on c.p = g.prediction_score
group by prediction_score, x, n, bw""")
def q_smoothed_gc(spark, d):
    """A29 by group: the curve of GC content at each score, at 0.3 of the deviation."""
    h = B.cluster_scores(spark, d).groupBy("prediction_score", "gc_content").agg(F.count(F.lit(1)).alias("n"))
    return CV.smoothed_density(h, "gc_content", "n", ["prediction_score"], points=100, cut=2.0, factor=0.3)


@query("normal_qq", f"""
select ClsID, round(value, 6) as value, round(p, 6) as position, round(z, 6) as theoretical, round((value - mean) / nullif(std, 0), 6) as standardised, round(mean + std * z, 6) as line
from (select *, case when p <= 0.02425 then {{low}} when p >= 1 - 0.02425 then -({{high}}) else {{mid}} end as z
      from (select *, p - 0.5 as q, (p - 0.5) * (p - 0.5) as r, sqrt(-2 * ln(p)) as lv, sqrt(-2 * ln(1 - p)) as hv
            from (select ClsID, predictions_mean as value, avg(predictions_mean) over () as mean, stddev_pop(predictions_mean) over () as std,
                         row_number() over (order by predictions_mean, ClsID) / (count(*) over () + 1.0) as p from v_stats) a) b) c""".format(
    **{k: v for k, v in (("low", _tail("lv")), ("high", _tail("hv")), ("mid", _middle()))}))
def q_normal_qq(spark, d):
    """Cluster means against the normal law."""
    return CV.normal_quantiles(B.stats(spark, d), "predictions_mean", "ClsID")


@query("point_lookup", """
select v.* from v_cs v where v.seq_index in (select max(o_orderkey) from orders where o_orderkey % 2 = 0)""")
def q_point_lookup(spark, d):
    """the rows of one key, found by a filter that reaches the scan."""
    key = spark.read.parquet(table_path(d, "orders")).where("o_orderkey % 2 = 0").agg(F.max("o_orderkey")).first()[0]
    return B.cluster_scores(spark, d).where(F.col("seq_index") == F.lit(key))


@query("padding_mask", """
select item_id, pos, substr(text, cast(pos as bigint), 1) as letter, (pos <= length(text)) as kept
from (select item_id, text, unnest(range(1, cast(m as bigint) + 1)) as pos
      from (select item_id, text, max(length(text)) over () as m from benchmark) t) u""")
def q_padding_mask(spark, d):
    """whole texts padded to the longest of all, with the mask of real letters."""
    t = spark.read.parquet(table_path(d, "benchmark")).select("item_id", "text")
    longest = t.agg(F.max(F.length("text"))).first()[0] or 0
    rows = t.select("item_id", "text", F.explode(F.expr(f"sequence(1L, {max(longest, 1)}L)")).alias("pos"))
    return rows.select("item_id", "pos", F.expr("substr(text, cast(pos as int), 1)").alias("letter"), (F.col("pos") <= F.length("text")).alias("kept"))


@query("padding_batches", """
select item_id, batch, pos, substr(text, cast(pos as bigint), 1) as letter, (pos <= length(text)) as kept
from (select item_id, batch, text, unnest(range(1, cast(m as bigint) + 1)) as pos
      from (select item_id, batch, text, max(length(text)) over (partition by batch) as m
            from (select item_id, coalesce(text, '') as text,
                         (row_number() over (order by length(coalesce(text, '')), item_id) - 1) // 64 as batch from benchmark) t) u) v""")
def q_padding_batches(spark, d):
    """whole texts padded to the longest of 64 of similar length, with the mask of real
    letters, so what is padded does not follow the longest text of all."""
    from seqscore.operators.models import row_numbers
    t = spark.read.parquet(table_path(d, "benchmark")).select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    ranked = row_numbers(t.withColumn("o", F.struct(F.length("text").alias("n"), "item_id")), "o", "r")
    batch = ranked.select("item_id", F.floor(F.col("r") / 64).cast("bigint").alias("batch"), "text")
    m = F.max(F.length("text")).over(Window.partitionBy("batch"))  # 64 rows a batch
    rows = batch.withColumn("m", m).where("m > 0").select("item_id", "batch", "text", F.explode(F.expr("sequence(1L, cast(m as bigint))")).alias("pos"))
    return rows.select("item_id", "batch", "pos", F.expr("substr(text, cast(pos as int), 1)").alias("letter"), (F.col("pos") <= F.length("text")).alias("kept"))


@query("metric_order", """
select test_on, cast(row_number() over (partition by test_on order by n desc, model, train_on) as integer) as place, model, train_on, n
from (select test_on, model, train_on, cast(sum(case when pred = label then 1 else 0 end) as bigint) as n from v_eval group by all) t""")
def q_metric_order(spark, d):
    """Models of each test set by falling number of right predictions (27 rows a group)."""
    hits = B.eval_table(spark, d).groupBy("test_on", "model", "train_on").agg(F.sum((F.col("pred") == F.col("label")).cast("int")).cast("bigint").alias("n"))
    w = Window.partitionBy("test_on").orderBy(F.desc("n"), "model", "train_on")
    return hits.select("test_on", F.row_number().over(w).alias("place"), "model", "train_on", "n")


@query("big_clusters", """
select ClsID, count(*) as n_rows from v_cs group by ClsID having count(*) > 10""")
def q_big_clusters(spark, d):
    """O3: clusters above a size, largest first."""
    sizes = C.cluster_sizes(B.cluster_scores(spark, d))
    return sizes.where("n_rows > 10").orderBy(F.desc("n_rows"), "ClsID")


@query("minmax_profile", """
select min(prediction_score) as prediction_score_min, max(prediction_score) as prediction_score_max,
       min(gc_content) as gc_content_min, max(gc_content) as gc_content_max from v_cs""")
def q_minmax_profile(spark, d):
    return C.minmax_profile(B.cluster_scores(spark, d), ["prediction_score", "gc_content"])


@query("union_ids", """
select o_custkey as id from orders union select c_custkey from customer""")
def q_union_ids(spark, d):
    a = spark.read.parquet(table_path(d, "orders")).select(F.col("o_custkey").alias("id"))
    return ST.union_ids(a, spark.read.parquet(table_path(d, "customer")).select(F.col("c_custkey").alias("id")))


@query("align_labels", """
select s.seq_index, s.prediction_score, l.label, n.label as next_label
from v_scores s join v_labels l on s.seq_index = l.seq_index join v_labels n on n.seq_index - 1 = s.seq_index""")
def q_align_labels(spark, d):
    """Labels of the row itself and, shifted by one, of the row after it."""
    lab = X.labels(spark, d).select("seq_index", "label")
    own = E.align_labels(X.scores(spark, d).select("seq_index", "prediction_score"), lab)
    return E.align_labels(own, lab.withColumnRenamed("label", "next_label"), offset=1)


@query("truncate_cast", """
select doc_id, substr(text, 1, 40) as clipped, cast(trunc(n_chars / 7.0) as integer) as score from documents""")
def q_truncate_cast(spark, d):
    """Texts clipped before scoring, a score cut to an integer."""
    t = spark.read.parquet(table_path(d, "documents")).select("doc_id", SC.truncate("text", 40).alias("clipped"), (F.col("n_chars") / 7.0).alias("score"))
    return SC.cast_score(t, "score")


@query("motif_names", """
select ps_partkey, cast(split_part(m, '-', 1) as integer) as motif_rank, split_part(m, '-', 2) as motif_word,
       regexp_extract(path, '([A-Za-z0-9]+)_([A-Za-z0-9_]+)\\.[a-z]+$', 1) as model,
       regexp_extract(path, '([A-Za-z0-9]+)_([A-Za-z0-9_]+)\\.[a-z]+$', 2) as train_set,
       cast(1 as double) / (1 + pow(2.0, p_size)) as distance
from (select p_partkey as ps_partkey, p_size, concat(cast(p_size as varchar), '-', upper(substr(md5(cast(p_partkey as varchar)), 1, 8))) as m,
             concat('runs/M', cast(p_partkey % 7 as varchar), '_set_', cast(p_size as varchar), '.csv') as path from part) t""")
def q_motif_names(spark, d):
    """Fields of motif ids and file names, and the distance of a score."""
    t = spark.read.parquet(table_path(d, "part")).select(
        F.col("p_partkey").alias("ps_partkey"), "p_size",
        F.concat(F.col("p_size").cast("string"), F.lit("-"), F.upper(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 8))).alias("m"),
        F.concat(F.lit("runs/M"), (F.col("p_partkey") % 7).cast("string"), F.lit("_set_"), F.col("p_size").cast("string"), F.lit(".csv")).alias("path"))
    model, train_set = S.source_fields("path")
    return t.select("ps_partkey", S.motif_rank("m").alias("motif_rank"), S.motif_word("m").alias("motif_word"),
                    model.alias("model"), train_set.alias("train_set"), S.align_distance("p_size").alias("distance"))


@query("mean_pool", """
select vec_id, cast(embedding[1] as double) * 0.5 + cast(embedding[3] as double) * 0.5 as first_of_two, cast(len(embedding) / 2 as integer) as dim
from embeddings where embedding is not null""")
def q_mean_pool(spark, d):
    """The mean of two token vectors (even and odd components of an embedding)."""
    e = spark.read.parquet(table_path(d, "embeddings")).where(F.col("embedding").isNotNull())
    half = F.size("embedding") / 2
    tokens = F.array(F.slice("embedding", 1, half.cast("int")), F.concat(F.slice("embedding", 3, 1), F.slice("embedding", 2, half.cast("int") - 1)))
    pooled = e.select("vec_id", S.mean_pool(tokens).alias("v"))
    return pooled.select("vec_id", F.col("v")[0].alias("first_of_two"), F.size("v").alias("dim"))
