"""DuckDB oracle SQL: the fixture views of FIXTURES.md as CTEs plus the shared derived views.

Each registered query's oracle is ``WITH <FIXTURE_CTES>, <its own CTEs> SELECT ...``.
Types are pinned with casts so that both engines report the same schema.
"""

FIXTURE_CTES = """
v_keys as (
  select o_orderkey as seq_index,
         case when o_orderkey % 7 = 0 then 1000000 + o_orderkey
              else cast(floor(o_orderkey / 40) as bigint) * 2 + case when o_orderkey % 40 < 5 then 1 else 0 end end as ClsID,
         cast(floor(o_orderkey / 40) as bigint) % 3 as fam,
         md5(concat('p', cast(o_orderkey as varchar))) as ph,
         md5(concat('y', cast(o_orderkey as varchar))) as yh
  from orders),
v_library as (
  select seq_index, ClsID,
         concat(substr(translate(md5(concat('f', cast(ClsID as varchar))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 20),
                substr(translate(md5(concat('s', cast(seq_index as varchar))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 5)) as sequence
  from v_keys),
v_models as (
  select * from (values
   (1,'DNABERT2','mpra_data'),(2,'DNABERT2','cao2021'),(3,'DNABERT2','hek'),(4,'DNABERT2','hek_muscle'),(5,'DNABERT2','hek_muscle_pc3'),
   (6,'DNABERT2','hek_pc3'),(7,'DNABERT2','muscle'),(8,'DNABERT2','muscle_pc3'),(9,'DNABERT2','pc3'),
   (10,'UTRLM','mpra_data'),(11,'UTRLM','cao2021'),(12,'UTRLM','hek'),(13,'UTRLM','hek_muscle'),(14,'UTRLM','hek_muscle_pc3'),
   (15,'UTRLM','hek_pc3'),(16,'UTRLM','muscle'),(17,'UTRLM','muscle_pc3'),(18,'UTRLM','pc3'),
   (19,'GROVER','mpra_data'),(20,'GROVER','cao2021'),(21,'GROVER','hek'),(22,'GROVER','hek_muscle'),(23,'GROVER','hek_muscle_pc3'),
   (24,'GROVER','hek_pc3'),(25,'GROVER','muscle'),(26,'GROVER','muscle_pc3'),(27,'GROVER','pc3')) as t(pos, model, train_on)),
v_pred_long as (
  select k.seq_index, m.model, m.train_on,
         case when substr(k.ph, m.pos, 1) >= case k.fam when 0 then '6' when 1 then '3' else '1' end then 1 else 0 end as pred,
         (instr('0123456789abcdef', substr(k.ph, m.pos, 1)) - 1) / cast(15 as double) as proba
  from v_keys k cross join v_models m),
v_scores as (
  select p.seq_index, cast(sum(case when p.train_on <> 'cao2021' then p.pred else 0 end) as integer) as prediction_score
  from v_pred_long p group by p.seq_index),
v_membership as (
  select k.ClsID, concat('>gi|', cast(k.seq_index + 1 as varchar), '|', cast(s.prediction_score as varchar)) as SeqID,
         cast(0.8 as double) + (instr('0123456789abcdef', substr(k.yh, 2, 1)) - 1) / cast(80 as double) as Score,
         case when k.seq_index % 40 = 8 then 'C' when k.seq_index % 11 = 0 then 'E' else 'M' end as Status
  from v_keys k join v_scores s on k.seq_index = s.seq_index),
v_labels as (
  select seq_index, concat('set', cast(seq_index % 8 as varchar)) as test_on,
         cast(case when substr(yh, 1, 1) >= case fam when 0 then 'b' when 1 then '8' else '4' end then 1 else 0 end as integer) as label
  from v_keys),
v_splits as (
  select 'base' as dataset, case seq_index % 10 when 0 then 'test' when 1 then 'dev' else 'train' end as split,
         substr(sequence, 14, 12) as sequence from v_library
  union all
  select concat('sub', substr(md5(concat('d', cast(seq_index as varchar))), 1, 1)),
         case seq_index % 10 when 0 then 'test' when 1 then 'dev' else 'train' end,
         substr(sequence, 14, 12) from v_library),
v_gc as (
  select seq_index, sequence,
         case when length(sequence) > 0
              then (length(sequence) - length(translate(sequence, 'GC', ''))) / cast(length(sequence) as double)
              else cast(0 as double) end as gc_content
  from v_library),
v_cm as (
  select ClsID, SeqID, Score, Status, cast(split_part(SeqID, '|', 2) as bigint) - 1 as seq_index from v_membership),
v_cs as (
  select cm.ClsID, cm.seq_index, cm.Status, cm.Score, s.prediction_score, g.sequence, g.gc_content
  from v_cm cm join v_scores s on cm.seq_index = s.seq_index join v_gc g on cm.seq_index = g.seq_index
  where cm.Status in ('C', 'M')),
v_dedup as (
  select distinct g.sequence, g.gc_content, s.prediction_score
  from v_gc g join v_scores s on g.seq_index = s.seq_index),
v_big as (
  select ClsID from v_cs group by ClsID having count(*) >= 2),
v_stats as (
  select ClsID, avg(prediction_score) as predictions_mean, stddev_samp(prediction_score) as predictions_std,
         count(*) as Count
  from v_cs where ClsID in (select ClsID from v_big) group by ClsID),
v_eval as (
  select p.seq_index, p.model, p.train_on, l.test_on, p.pred, p.proba, l.label
  from v_pred_long p join v_labels l on p.seq_index = l.seq_index)
"""


def with_fixtures(body: str, extra_ctes: str = "") -> str:
    """Wrap a query body (and optional extra CTEs, comma separated) with the fixture CTEs."""
    ctes = FIXTURE_CTES.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    return f"with {ctes}\n{body.strip()}"
