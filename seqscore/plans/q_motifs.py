"""Registered queries: motif counts, enriched motifs, hits, best motif per group, pivots,
best-scoring motif pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqscore.operators import bands as BD
from seqscore.operators import distance as D
from seqscore.operators import matrices as MX
from seqscore.operators import motifs as MO
from seqscore.plans import base as B
from seqscore.plans.registry import query
from seqscore.session import cut_lineage, spread_evenly

WMIN, WMAX, NMOT, LOW, HIGH, NMID = 8, 25, 10, 17, 21, 100
G = ["grp"]


def motif_sets(spark, d):
    """(grp, role, seq_index, sequence): low band vs mid draw 1, high band vs mid draw 2."""
    cs = B.big_cluster_scores(spark, d).select("ClsID", "seq_index", "sequence")
    st = B.stats(spark, d)
    b1 = BD.cluster_bands(st, LOW, HIGH, NMID, 1, mean="predictions_mean")
    b2 = BD.cluster_bands(st, LOW, HIGH, NMID, 2, mean="predictions_mean")
    tag = lambda b, grp, band, role: b.filter((F.col("band") == band) & F.col("drawn")).select(
        "ClsID", F.lit(grp).alias("grp"), F.lit(role).alias("role"))
    roles = tag(b1, "L_vs_M", "low", "fg").unionByName(tag(b1, "L_vs_M", "mid", "bg")) \
        .unionByName(tag(b2, "H_vs_M", "high", "fg")).unionByName(tag(b2, "H_vs_M", "mid", "bg"))
    return cs.join(roles, "ClsID").select("grp", "role", "seq_index", "sequence")


def motifs(spark, d):
    return MO.enriched_motifs_tagged(motif_sets(spark, d), "role", WMIN, WMAX, NMOT, G)


_SETS = f"""
v_band as (select ClsID, case when predictions_mean < {LOW} then 'low' when predictions_mean > {HIGH} then 'high' else 'mid' end as band
           from v_stats),
v_draw as (select ClsID, seed from (
             select m.ClsID, s.seed, row_number() over (partition by s.seed order by md5(concat(cast(m.ClsID as varchar), '|', cast(s.seed as varchar))), m.ClsID) as rn
             from v_band m, (select 1 as seed union all select 2) s where m.band = 'mid') t where rn <= {NMID}),
v_roles as (
  select ClsID, 'L_vs_M' as grp, 'fg' as role from v_band where band = 'low'
  union all select ClsID, 'L_vs_M', 'bg' from v_draw where seed = 1
  union all select ClsID, 'H_vs_M', 'fg' from v_band where band = 'high'
  union all select ClsID, 'H_vs_M', 'bg' from v_draw where seed = 2),
v_sets as (select r.grp, r.role, c.seq_index, c.sequence from v_cs c join v_roles r on c.ClsID = r.ClsID
           where c.ClsID in (select ClsID from v_big)),
v_km as (select grp, role, seq_index, unnest(list_distinct(flatten(list_transform(
            generate_series({WMIN}, least({WMAX}, length(sequence))),
            lambda w: list_transform(generate_series(1, length(sequence) - w + 1), lambda i: substr(sequence, i, w)))))) as kmer
         from v_sets where length(sequence) >= {WMIN})"""


@query("motif_counts", """
select f.grp, f.kmer, f.fg_n, coalesce(b.bg_n, 0) as bg_n, n.N_fg, n.N_bg
from (select grp, kmer, count(distinct seq_index) as fg_n from v_km where role = 'fg' group by grp, kmer) f
left join (select grp, kmer, count(distinct seq_index) as bg_n from v_km where role = 'bg' group by grp, kmer) b
  on f.grp = b.grp and f.kmer = b.kmer
join (select grp, count(distinct case when role = 'fg' then seq_index end) as N_fg,
             count(distinct case when role = 'bg' then seq_index end) as N_bg from v_sets group by grp) n on n.grp = f.grp
where f.fg_n >= 2""", _SETS)
def q_motif_counts(spark, d):
    c = MO.motif_counts_tagged(motif_sets(spark, d), "role", WMIN, WMAX, G, least=2)
    return c.filter(F.col("fg_n") >= 2).select("grp", "kmer", "fg_n", "bg_n", "N_fg", "N_bg")


@query("enriched_motifs")
def q_enriched_motifs(spark, d):
    return motifs(spark, d).select("grp", "rank", "motif", "width", "fg_n", "bg_n", "log_odds", "p_value", "E_value")


@query("motif_hits")
def q_motif_hits(spark, d):
    s = motif_sets(spark, d).filter(F.col("role") == "fg")
    return MO.motif_hits(s, motifs(spark, d), G)


@query("min_eval_motif")
def q_min_eval_motif(spark, d):
    return MO.min_eval_motif(motifs(spark, d), G).select("grp", "motif", "E_value")


@query("motif_pivot")
def q_motif_pivot(spark, d):
    return MO.motif_pivot(motifs(spark, d), G, 5)


@query("best_motif_pairs")
def q_best_motif_pairs(spark, d):
    m = motifs(spark, d)
    hi = m.filter(F.col("grp") == "H_vs_M").select(F.col("motif").alias("motif_a"))
    lo = m.filter(F.col("grp") == "L_vs_M").select(F.col("motif").alias("motif_b"))
    return D.best_pairs(hi, lo, "motif_a", "motif_b", scoring="set3").select("motif_a", "motif_b", "align_score")


SEED_WIDTH, SEEDS = 8, 5

_SEEDS = _SETS + f""",
v_seed as (
  select grp, motif, cast(rn as integer) as rank from (
    select grp, kmer as motif, row_number() over (partition by grp order by diff desc, kmer) as rn from (
      select grp, kmer, count(distinct case when role = 'fg' then seq_index end) - count(distinct case when role = 'bg' then seq_index end) as diff
      from v_km where length(kmer) = {SEED_WIDTH} group by grp, kmer) x where diff > 0) y where rn <= {SEEDS}),
v_fg as (select distinct grp, seq_index, sequence from v_sets where role = 'fg' and length(sequence) >= {SEED_WIDTH}),
v_sub as (select grp, seq_index, i, substr(sequence, cast(i as bigint), {SEED_WIDTH}) as site
          from (select *, unnest(generate_series(1, length(sequence) - {SEED_WIDTH - 1})) as i from v_fg) t),
v_count as (
  select s.grp, s.rank, s.motif, p.pos, l.letter, cast(count(*) filter (substr(site, cast(p.pos as bigint), 1) = l.letter) as double) as n, count(*) as total
  from v_sub b join v_seed s on s.grp = b.grp and hamming(b.site, s.motif) <= 1,
       (select cast(unnest(generate_series(1, {SEED_WIDTH})) as integer) as pos) p, (select unnest(['A', 'C', 'G', 'T']) as letter) l
  group by all),
v_weight as (select *, cast(round(log2((n + 0.25) / ((total + 1.0) * 0.25)) * 1000.0) as bigint) as weight from v_count),
v_scored as (
  select b.grp, w.rank, w.motif, b.seq_index, b.i, sum(w.weight) as score
  from v_sub b join v_weight w on w.grp = b.grp and w.letter = substr(b.site, cast(w.pos as bigint), 1) group by all),
v_law as (
  with recursive law(grp, rank, pos, score, words) as (
    select distinct grp, rank, 0, cast(0 as bigint), cast(1 as bigint) from v_weight
    union all
    select l.grp, l.rank, l.pos + 1, l.score + w.weight, cast(sum(l.words) as bigint)
    from law l join v_weight w on w.grp = l.grp and w.rank = l.rank and w.pos = l.pos + 1 group by l.grp, l.rank, l.pos, l.score + w.weight)
  select grp, rank, score, sum(words) over (partition by grp, rank order by score desc) / pow(4.0, {SEED_WIDTH}) as p_site from law where pos = {SEED_WIDTH})"""


def seed_motifs(sets):
    """The ``SEEDS`` words of a group that are in most more foreground than background sequences."""
    c = MO.motif_counts_tagged(sets, "role", SEED_WIDTH, SEED_WIDTH, G).withColumn("diff", F.col("fg_n") - F.col("bg_n")).where("diff > 0")
    best = BD.top_k_per_group(c, G, -F.col("diff"), SEEDS, tiebreak="kmer")
    w = Window.partitionBy(*G).orderBy(F.desc("diff"), "kmer")
    return best.select(*G, F.col("kmer").alias("motif"), F.row_number().over(w).alias("rank"))


def foreground(sets):
    return sets.where("role = 'fg'").dropDuplicates([*G, "seq_index"])


@query("seed_matrices", "select grp, rank, motif, pos, letter, n, weight from v_weight", _SEEDS)
def q_seed_matrices(spark, d):
    sets = cut_lineage(motif_sets(spark, d))  # read by the seeds and by their matrices
    return MX.seed_matrices(foreground(sets), seed_motifs(sets), 1, G).select("grp", "rank", "motif", "pos", "letter", "n", "weight")


@query("motif_sites", f"""
select s.grp, s.rank, s.motif, s.seq_index, s.i as site_start, s.i + {SEED_WIDTH - 1} as site_end, cast(s.score as bigint) as site_score, l.p_site
from v_scored s join v_law l on l.grp = s.grp and l.rank = s.rank and l.score = s.score
qualify row_number() over (partition by s.grp, s.rank, s.seq_index order by s.score desc, s.i) = 1""", _SEEDS)
def q_motif_sites(spark, d):
    """The best site of every sequence under every seed matrix, and the exact chance of it."""
    sets = cut_lineage(motif_sets(spark, d))
    fg = cut_lineage(foreground(sets))
    return MX.motif_sites(spread_evenly(fg), MX.seed_matrices(fg, seed_motifs(sets), 1, G), G).select(
        "grp", "rank", "motif", "seq_index", "site_start", "site_end", "site_score", "p_site")


@query("refined_motifs")
def q_refined_motifs(spark, d):
    """Seed matrices refined by expectation-maximisation, with their enrichment."""
    sets = cut_lineage(motif_sets(spark, d))
    rows = cut_lineage(spread_evenly(sets.dropDuplicates([*G, "role", "seq_index"])))  # every round and scan reads it
    fg = rows.where("role = 'fg'")
    fitted = cut_lineage(MX.refine(fg, MX.seed_matrices(fg, seed_motifs(sets), 1, G), 8, G))
    found = MX.motif_sites(rows.where("role = 'fg'"), fitted, G).withColumn("role", F.lit("fg")).unionByName(
        MX.motif_sites(rows.where("role = 'bg'"), fitted, G).withColumn("role", F.lit("bg")))
    sizes = rows.groupBy(*G).agg(*[F.sum((F.col("role") == r).cast("long")).alias(f"N_{r}") for r in ("fg", "bg")])
    w = F.max(F.struct("n", "letter"))
    consensus = fitted.groupBy(*G, "rank", "pos").agg(w.alias("top")).groupBy(*G, "rank").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "top.letter"))), lambda x: x["letter"]), "").alias("consensus"))
    return MX.matrix_enrichment(found, sizes, group=G).join(consensus, [*G, "rank"]).select(
        "grp", "rank", "motif", "consensus", "fg_n", "bg_n", "N_fg", "N_bg", "p_value", "E_value")
