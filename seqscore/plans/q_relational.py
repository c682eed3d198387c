"""Registered queries: scores, filters, joins, cluster aggregations, ordering, sets, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqscore.functions import sequence as S
from seqscore.operators import clusters as C
from seqscore.operators import scores as P
from seqscore.operators import sets as U
from seqscore.plans import base as B
from seqscore.plans.registry import query
from seqscore.sources import fixtures as X
from seqscore.sources.sinks import fasta_record

# ------------------------------------------------------------------ P: projections


@query("prediction_score", """
select seq_index, prediction_score from v_scores""")
def q_prediction_score(spark, d):
    return P.prediction_score(X.pred_wide(spark, d)).select("seq_index", "prediction_score")


@query("model_total", """
select seq_index,
       cast(sum(case when model = 'DNABERT2' then pred else 0 end) as integer) as DNABERT2,
       cast(sum(case when model = 'UTRLM' then pred else 0 end) as integer) as UTRLM,
       cast(sum(case when model = 'GROVER' then pred else 0 end) as integer) as GROVER,
       cast(sum(pred) as integer) as total
from v_pred_long group by seq_index""")
def q_model_total(spark, d):
    return P.model_total(X.pred_wide(spark, d), X.FAMILIES)


@query("dedup_scores", """
select sequence, gc_content, prediction_score from v_dedup""")
def q_dedup_scores(spark, d):
    return B.dedup_scores(spark, d)


@query("score_range", """
select seq_index, prediction_score from v_scores where prediction_score between 23 and 24""")
def q_score_range(spark, d):
    return C.score_range(X.scores(spark, d), 23, 24)


@query("status_filter", """
select ClsID, seq_index, Status from v_cm where Status in ('C', 'M')""")
def q_status_filter(spark, d):
    return C.status_filter(C.parse_membership(X.membership(spark, d))).select("ClsID", "seq_index", "Status")


@query("seqid_fields", """
select ClsID, cast(split_part(SeqID, '|', 2) as bigint) - 1 as seq_index,
       cast(split_part(SeqID, '|', 3) as integer) as seqid_score from v_membership""")
def q_seqid_fields(spark, d):
    m = X.membership(spark, d)
    return m.select("ClsID", S.seqid_index("SeqID", 1).alias("seq_index"), S.seqid_score("SeqID").alias("seqid_score"))


@query("size_filter", """
select ClsID, seq_index from v_cs where ClsID in (select ClsID from v_big)""")
def q_size_filter(spark, d):
    return B.big_cluster_scores(spark, d).select("ClsID", "seq_index")


@query("label_slice", """
select c.ClsID, c.seq_index from v_cs c
join (select ClsID, dense_rank() over (order by ClsID) as r from (select distinct ClsID from v_cs) t) r
  on c.ClsID = r.ClsID
where r.r > 100 and r.r <= 300""")
def q_label_slice(spark, d):
    return C.label_slice(B.cluster_scores(spark, d), 100, 300).select("ClsID", "seq_index")


# ------------------------------------------------------------------ J: joins


@query("join_membership", """
select cm.ClsID, cm.seq_index, cm.Status, cm.Score, s.prediction_score
from v_cm cm join v_scores s on cm.seq_index = s.seq_index""")
def q_join_membership(spark, d):
    m = C.parse_membership(X.membership(spark, d))
    return C.join_membership(m, X.scores(spark, d)).select("ClsID", "seq_index", "Status", "Score", "prediction_score")


@query("join_library", """
select l.seq_index, l.sequence, s.gc_content, s.prediction_score
from v_library l join v_dedup s on l.sequence = s.sequence""")
def q_join_library(spark, d):
    lib = X.library(spark, d).select("seq_index", "sequence")
    return lib.join(B.dedup_scores(spark, d), "sequence").select("seq_index", "sequence", "gc_content", "prediction_score")


@query("join_composite", """
select c.ClsID, c.seq_index, c.sequence, s.gc_content, s.prediction_score
from v_cs c join v_dedup s on c.sequence = s.sequence and c.prediction_score = s.prediction_score""")
def q_join_composite(spark, d):
    cs = B.cluster_scores(spark, d).select("ClsID", "seq_index", "sequence", "prediction_score")
    return cs.join(B.dedup_scores(spark, d), ["sequence", "prediction_score"]).select(
        "ClsID", "seq_index", "sequence", "gc_content", "prediction_score")


@query("semi_top_clusters", """
select c.ClsID, c.seq_index, c.sequence, c.prediction_score from v_cs c
where c.ClsID in (
  select ClsID from (select ClsID, count(distinct sequence) as n from v_cs group by ClsID) t
  where n >= 10 order by n desc, ClsID limit 20)""")
def q_semi_top_clusters(spark, d):
    return C.top_clusters(B.cluster_scores(spark, d), 20, 10).select("ClsID", "seq_index", "sequence", "prediction_score")


@query("left_fill_counts", """
select c.prediction_score,
       count(distinct c.ClsID) as clusters_ge1,
       case when count(distinct case when z.n >= 10 then c.ClsID end) > 0
            then count(distinct case when z.n >= 10 then c.ClsID end) end as clusters_ge_lim,
       count(distinct case when z.n < 10 then c.ClsID end) as clusters_lt_lim
from v_cs c join (select ClsID, count(distinct sequence) as n from v_cs group by ClsID) z on c.ClsID = z.ClsID
group by c.prediction_score""")
def q_left_fill_counts(spark, d):
    return C.clusters_per_score(B.cluster_scores(spark, d), 10)


# ------------------------------------------------------------------ A: aggregations


@query("cluster_size", """
select ClsID, count(*) as n_rows, count(distinct sequence) as n_distinct from v_cs group by ClsID""")
def q_cluster_size(spark, d):
    return C.cluster_sizes(B.cluster_scores(spark, d), distinct_col="sequence")


@query("cluster_stats", """
select ClsID, predictions_mean, predictions_std, Count from v_stats""")
def q_cluster_stats(spark, d):
    return B.stats(spark, d)


@query("cluster_profile", """
select ClsID,
       cast(min(prediction_score) as double) as predictions_min, avg(prediction_score) as predictions_mean,
       median(prediction_score) as predictions_median, stddev_samp(prediction_score) as predictions_std,
       cast(max(prediction_score) as double) as predictions_max,
       min(gc_content) as gc_content_min, avg(gc_content) as gc_content_mean, median(gc_content) as gc_content_median,
       stddev_samp(gc_content) as gc_content_std, max(gc_content) as gc_content_max, count(*) as Count
from v_cs group by ClsID""")
def q_cluster_profile(spark, d):
    return C.cluster_profile(B.cluster_scores(spark, d))


_SWEEP_CTES = """
v_sweep as (
  select 80 as Perc, ClsID, seq_index from v_cm
  union all select 70, cast(floor(ClsID / 2) as bigint), seq_index from v_cm
  union all select 60, cast(floor(ClsID / 4) as bigint), seq_index from v_cm),
v_sweep_n as (select Perc, ClsID, count(distinct seq_index) as n from v_sweep group by Perc, ClsID)"""


def _sweep_sql(lim: int) -> str:
    return f"""
select Perc, total_clusters, n_small, n_large, pct_small, 100.0 - pct_small as pct_large from (
  select Perc, count(*) as total_clusters,
         cast(sum(case when n < {lim} then 1 else 0 end) as bigint) as n_small,
         cast(sum(case when n >= {lim} then 1 else 0 end) as bigint) as n_large,
         round(sum(case when n < {lim} then 1 else 0 end) * 100.0 / count(*), 3) as pct_small
  from v_sweep_n group by Perc) t"""


@query("identity_sweep", _sweep_sql(2), _SWEEP_CTES)
def q_identity_sweep(spark, d):
    return C.identity_sweep(B.sweep_membership(spark, d), lim=2).select(
        "Perc", "total_clusters", "n_small", "n_large", "pct_small", "pct_large")


@query("pct_columns", _sweep_sql(10), _SWEEP_CTES)
def q_pct_columns(spark, d):
    return C.identity_sweep(B.sweep_membership(spark, d), lim=10).select(
        "Perc", "total_clusters", "n_small", "n_large", "pct_small", "pct_large")


@query("singleton_report", """
select count(*) as total_clusters,
       cast(sum(case when n = 1 then 1 else 0 end) as bigint) as singletons,
       cast(sum(case when n > 1 then 1 else 0 end) as bigint) as non_singletons,
       max(n) as largest_size,
       arg_min(ClsID, -n * 1000000000000 + ClsID) as largest_cluster
from (select ClsID, count(*) as n from v_cs group by ClsID) t""")
def q_singleton_report(spark, d):
    return C.singleton_report(B.cluster_scores(spark, d))


@query("in_out_std", """
select p.ClsID,
       sqrt(greatest(p.q1 / p.n - (p.s1 / p.n) * (p.s1 / p.n), 0)) as predictions_std,
       sqrt(greatest((t.Q1 - p.q1) / (t.N - p.n) - ((t.S1 - p.s1) / (t.N - p.n)) * ((t.S1 - p.s1) / (t.N - p.n)), 0)) as predictions_std_out,
       sqrt(greatest(p.q2 / p.n - (p.s2 / p.n) * (p.s2 / p.n), 0)) as gc_content_std,
       sqrt(greatest((t.Q2 - p.q2) / (t.N - p.n) - ((t.S2 - p.s2) / (t.N - p.n)) * ((t.S2 - p.s2) / (t.N - p.n)), 0)) as gc_content_std_out,
       p.n as Count
from (select ClsID, count(*) as n,
             sum(prediction_score - m.m1) as s1, sum((prediction_score - m.m1) * (prediction_score - m.m1)) as q1,
             sum(gc_content - m.m2) as s2, sum((gc_content - m.m2) * (gc_content - m.m2)) as q2
      from v_cs, (select avg(prediction_score) as m1, avg(gc_content) as m2 from v_cs) m group by ClsID) p,
     (select count(*) as N,
             sum(prediction_score - m.m1) as S1, sum((prediction_score - m.m1) * (prediction_score - m.m1)) as Q1,
             sum(gc_content - m.m2) as S2, sum((gc_content - m.m2) * (gc_content - m.m2)) as Q2
      from v_cs, (select avg(prediction_score) as m1, avg(gc_content) as m2 from v_cs) m) t
where p.n >= 2""")
def q_in_out_std(spark, d):
    return C.in_out_std(B.cluster_scores(spark, d))


@query("score_histogram", """
select prediction_score, count(*) as frequency from v_scores group by prediction_score""")
def q_score_histogram(spark, d):
    return C.score_histogram(X.scores(spark, d))


@query("binned_histogram", """
select bin, lo + bin * ((hi - lo) / 10.0) as bin_start, lo + (bin + 1) * ((hi - lo) / 10.0) as bin_end, count(*) as frequency
from (select cast(least(floor((cast(s.prediction_score as double) - m.lo) * 10.0 / (m.hi - m.lo)), 9) as integer) as bin, m.lo, m.hi
      from v_scores s, (select cast(min(prediction_score) as double) as lo, cast(max(prediction_score) as double) as hi from v_scores) m) t
group by bin, lo, hi""")
def q_binned_histogram(spark, d):
    return C.binned_histogram(X.scores(spark, d), "prediction_score", 10)


@query("clusters_per_score", """
select prediction_score, count(distinct ClsID) as n_clusters from v_cs
where ClsID in (select ClsID from v_cs group by ClsID having count(distinct sequence) >= 10)
group by prediction_score""")
def q_clusters_per_score(spark, d):
    kept = C.size_filter(B.cluster_scores(spark, d), 10, distinct_col="sequence")
    return kept.groupBy("prediction_score").agg(F.countDistinct("ClsID").alias("n_clusters"))


@query("sequences_per_score", """
select prediction_score, count(distinct sequence) as n_sequences from v_cs
where ClsID in (select ClsID from v_cs group by ClsID having count(distinct sequence) >= 10)
group by prediction_score""")
def q_sequences_per_score(spark, d):
    return C.sequences_per_score(B.cluster_scores(spark, d), 10)


@query("gc_by_score", """
select prediction_score, min(gc_content) as gc_min, quantile_cont(gc_content, 0.25) as gc_q1,
       quantile_cont(gc_content, 0.5) as gc_median, quantile_cont(gc_content, 0.75) as gc_q3,
       max(gc_content) as gc_max, count(*) as n
from v_dedup group by prediction_score""")
def q_gc_by_score(spark, d):
    return C.gc_by_score(B.dedup_scores(spark, d))


@query("quantile_cuts", """
select q_low, q_high, cast(floor(q_low) as integer) as low, cast(ceil(q_high) as integer) as high
from (select quantile_cont(predictions_mean, 0.09) as q_low, quantile_cont(predictions_mean, 0.9) as q_high from v_stats) t""")
def q_quantile_cuts(spark, d):
    return C.quantile_cuts(B.stats(spark, d))


@query("multi_membership", """
select min(c) as min_clusters, max(c) as max_clusters
from (select seq_index, count(distinct ClsID) as c from v_cs group by seq_index) t""")
def q_multi_membership(spark, d):
    return C.multi_membership(B.cluster_scores(spark, d))


@query("abs_diff_columns", """
select p.model, p.train_on, cast(sum(abs(p.pred - b.pred)) as bigint) as abs_diff
from v_pred_long p join v_pred_long b
  on p.seq_index = b.seq_index and p.model = b.model and b.train_on = 'cao2021'
group by p.model, p.train_on""")
def q_abs_diff_columns(spark, d):
    return U.abs_diff_columns(X.pred_wide(spark, d), X.MODELS, X.BASELINE_SET)


@query("split_sizes", """
select dataset, count(case when split = 'dev' then 1 end) as dev, count(case when split = 'test' then 1 end) as test,
       count(case when split = 'train' then 1 end) as train
from v_splits group by dataset""")
def q_split_sizes(spark, d):
    return U.split_sizes(X.splits(spark, d))


# ------------------------------------------------------------------ O: ordering


@query("top_clusters", """
select ClsID, predictions_mean, Count from v_stats where predictions_mean < 17
order by Count desc, ClsID limit 20""")
def q_top_clusters(spark, d):
    st = B.stats(spark, d)
    low = st.filter(C.band_column("predictions_mean") == "low")
    return low.orderBy(F.desc("Count"), F.asc("ClsID")).limit(20).select("ClsID", "predictions_mean", "Count")


@query("overlapping_chunks", """
select r.chunk, k.ClsID from
  (select ClsID, dense_rank() over (order by ClsID) - 1 as pos from (select distinct ClsID from v_stats) t) k
  join (select cast(i + 1 as integer) as chunk, i * (sz - ov) as start,
               case when i = 3 then n else (i + 1) * sz end + 1 as "end"
        from range(4) r(i),
             (select n, sz, cast(floor(sz * 0.3) as bigint) as ov
              from (select count(*) as n, count(*) // 4 as sz from v_stats) a) b) r
  on k.pos >= r.start and k.pos < r."end" """)
def q_overlapping_chunks(spark, d):
    st = B.stats(spark, d).select("ClsID")
    n = st.count()  # scalar action: number of cluster ids
    chunks = C.overlapping_chunks(spark, n, 4, 0.3)
    return C.chunk_labels(st, chunks).select("chunk", "ClsID")


@query("density_groups", """
select prediction_score, n, cast(case when gn >= 20 then g else -1 end as integer) as "group" from (
  select prediction_score, n, g, sum(n) over (partition by g) as gn from (
    select prediction_score, n, sum(gap) over (order by prediction_score rows between unbounded preceding and current row) as g from (
      select prediction_score, n,
             case when prediction_score - lag(prediction_score) over (order by prediction_score) > 10 then 1 else 0 end as gap
      from (select prediction_score, count(*) as n from v_scores group by prediction_score) h) a) b) c""")
def q_density_groups(spark, d):
    return C.density_groups(X.scores(spark, d), "prediction_score", 10, 20)


# ------------------------------------------------------------------ U: sets


@query("split_union", """
select sequence from v_splits where dataset = 'base' and split = 'train'
union select sequence from v_splits where dataset = 'base' and split = 'test'
union select sequence from v_splits where dataset = 'base' and split = 'dev'""")
def q_split_union(spark, d):
    return U.split_union(X.splits(spark, d), "base")


@query("jaccard", """
select s.dataset, cast(count(b.sequence) as bigint) as intersection,
       cast((select count(distinct sequence) from v_splits where dataset = 'base') + count(*) - count(b.sequence) as bigint) as union_size,
       count(b.sequence) / cast((select count(distinct sequence) from v_splits where dataset = 'base') + count(*) - count(b.sequence) as double) as jaccard
from (select distinct dataset, sequence from v_splits where dataset <> 'base') s
left join (select distinct sequence from v_splits where dataset = 'base') b on s.sequence = b.sequence
group by s.dataset""")
def q_jaccard(spark, d):
    return U.jaccard(X.splits(spark, d), "base")


# ------------------------------------------------------------------ C: scalar columns


@query("gc_content", """
select seq_index, gc_content from v_gc""")
def q_gc_content(spark, d):
    return B.gc_table(spark, d).select("seq_index", "gc_content")


@query("kmer_sentence", """
select seq_index, array_to_string(list_transform(generate_series(1, length(sequence) - 2), lambda i: substr(sequence, i, 3)), ' ') as sentence
from v_library""")
def q_kmer_sentence(spark, d):
    return X.library(spark, d).select("seq_index", S.kmer_sentence("sequence", 3).alias("sentence"))


@query("kmer_counts", """
select kmer, count(*) as n from (
  select unnest(list_transform(generate_series(1, length(sequence) - 2), lambda i: substr(sequence, i, 3))) as kmer from v_library) t
group by kmer""")
def q_kmer_counts(spark, d):
    return U.kmer_counts(X.library(spark, d), 3)


@query("complement", """
select seq_index, translate(sequence, 'ACGT', 'TGCA') as complement, reverse(translate(sequence, 'ACGT', 'TGCA')) as reverse_complement
from v_library""")
def q_complement(spark, d):
    return X.library(spark, d).select("seq_index", S.complement("sequence").alias("complement"),
                                      S.complement("sequence", reverse=True).alias("reverse_complement"))


@query("fasta_records", """
select g.seq_index, concat('>gi|', cast(g.seq_index + 1 as varchar), '|', cast(s.prediction_score as varchar), chr(10), g.sequence) as record
from v_library g join v_scores s on g.seq_index = s.seq_index""")
def q_fasta_records(spark, d):
    j = X.library(spark, d).join(X.scores(spark, d), "seq_index")
    return j.select("seq_index", fasta_record("seq_index", "prediction_score", "sequence").alias("record"))
