"""Registered queries: confusion counts, metrics, AUC, ROC, threshold sweep, votes, ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqscore.operators import ensemble as E
from seqscore.operators import metrics as M
from seqscore.operators import scores as P
from seqscore.plans import base as B
from seqscore.plans.registry import query
from seqscore.sources import fixtures as X

G = ["model", "train_on", "test_on"]
GS = "model, train_on, test_on"


def _d(a: str, b: str) -> str:
    return f"(case when ({b}) > 0 then cast({a} as double) / cast({b} as double) else cast(0 as double) end)"


def _macro_sql() -> str:
    acc = _d("tp + tn", "tp + fp + tn + fn")
    f1 = f"(({_d('2 * tp', '2 * tp + fp + fn')} + {_d('2 * tn', '2 * tn + fn + fp')}) / 2)"
    prec = f"(({_d('tp', 'tp + fp')} + {_d('tn', 'tn + fn')}) / 2)"
    rec = f"(({_d('tp', 'tp + fn')} + {_d('tn', 'tn + fp')}) / 2)"
    return (f"{acc} as accuracy, {f1} as f1, {prec} as precision, {rec} as recall, {_d('tn', 'tn + fp')} as TNR, "
            f"{_d('fp', 'fp + tn')} as FPR, {_d('tp', 'tp + fn')} as TPR")


def _binary_sql() -> str:
    return (f"{_d('tp + tn', 'tp + fp + tn + fn')} as accuracy, {_d('2 * tp', '2 * tp + fp + fn')} as f1, "
            f"{_d('tp', 'tp + fp')} as precision, {_d('tp', 'tp + fn')} as recall, {_d('tn', 'tn + fp')} as TNR")


def _conf_sql(pred: str = "pred", src: str = "v_eval", group: str = GS) -> str:
    s = lambda c: f"cast(sum(case when {c} then 1 else 0 end) as bigint)"
    return (f"select {group}, {s(f'{pred} = 1 and label = 1')} as tp, {s(f'{pred} = 1 and label = 0')} as fp, "
            f"{s(f'{pred} = 0 and label = 0')} as tn, {s(f'{pred} = 0 and label = 1')} as fn from {src} group by {group}")


_CONF = f"v_conf as ({_conf_sql()})"
_MEAN = ("v_mean as (select test_on, seq_index, round(avg(proba), 12) as mean_proba, min(label) as label "
         "from v_eval group by test_on, seq_index)")


def _auc_sql(src: str, group: str, score: str) -> str:
    return f"""
select {group}, case when sum(pos) > 0 and sum(neg) > 0
                     then sum(pos * (nb + neg / 2.0)) / cast(sum(pos) * sum(neg) as double) end as auc
from (select *, coalesce(sum(neg) over (partition by {group} order by {score}
                                        rows between unbounded preceding and 1 preceding), 0) as nb
      from (select {group}, {score}, cast(sum(label) as bigint) as pos, cast(sum(1 - label) as bigint) as neg
            from {src} group by {group}, {score}) h) h2
group by {group}"""


_SWEEP = """
v_cells as (select test_on, least(greatest(cast(floor(mean_proba * 1000.0 + 1e-7) as integer), -1), 1000) as cell, label from v_mean),
v_h as (select test_on, cell, cast(sum(label) as bigint) as pos, cast(sum(1 - label) as bigint) as neg from v_cells group by test_on, cell),
v_tot as (select test_on, sum(pos) as P, sum(neg) as N from v_h group by test_on),
v_grid as (select t.test_on, t.P, t.N, cast(g.range as integer) as cell from v_tot t, range(0, 1001) g),
v_cum as (
  select gr.test_on, gr.cell, cast(gr.cell as double) * cast(0.001 as double) as threshold,
         sum(coalesce(h.pos, 0)) over w as tp, sum(coalesce(h.neg, 0)) over w as fp, gr.P, gr.N
  from v_grid gr left join v_h h on gr.test_on = h.test_on and gr.cell = h.cell
  window w as (partition by gr.test_on order by gr.cell desc rows between unbounded preceding and current row)
  union all
  select test_on, -1, cast('inf' as double), 0, 0, P, N from v_tot),
v_sweep as (select test_on, cell, threshold, tp, fp, N - fp as tn, P - tp as fn from v_cum)"""

_SWEEP_METRICS = f"v_sweep_m as (select test_on, cell, threshold, {_macro_sql()} from v_sweep)"

_BEST = """
v_best_long as (
  select test_on, cell, threshold, m.metric, m.value from v_sweep_m,
  (select unnest([
     {'metric': 'accuracy', 'value': accuracy}, {'metric': 'f1', 'value': f1},
     {'metric': 'precision', 'value': precision}, {'metric': 'recall', 'value': recall},
     {'metric': 'TNR', 'value': TNR}], recursive := true)) m),
v_best_o as (
  select test_on, metric, value, threshold, cell,
         case when metric = 'TNR' and cell = -1 then 1001 else cell end as o from v_best_long),
v_best as (
  select b.test_on, b.metric,
         case when b.metric = 'TNR' and b.o = 1001 then l.value else b.value end as best_value,
         case when b.metric = 'TNR' and b.o = 1001 then l.threshold else b.threshold end as threshold
  from (select test_on, metric, arg_min(value, [-value, o]) as value, arg_min(threshold, [-value, o]) as threshold,
               arg_min(o, [-value, o]) as o
        from v_best_o group by test_on, metric) b
  join v_best_o l on l.test_on = b.test_on and l.metric = b.metric and l.cell = 1000)"""


# ------------------------------------------------------------------ A16-A19


@query("confusion", f"select {GS}, tp, fp, tn, fn from v_conf", _CONF)
def q_confusion(spark, d):
    return M.confusion(B.eval_table(spark, d), G)


@query("binary_metrics", f"select {GS}, {_binary_sql()} from v_conf", _CONF)
def q_binary_metrics(spark, d):
    return M.metric_columns(M.confusion(B.eval_table(spark, d), G), "binary")


@query("macro_metrics", f"select {GS}, {_macro_sql()} from v_conf", _CONF)
def q_macro_metrics(spark, d):
    return M.metric_columns(M.confusion(B.eval_table(spark, d), G), "macro")


@query("mcc", f"""
select {GS}, case when sqrt(cast(tp + fp as double) * cast(tp + fn as double) * cast(tn + fp as double) * cast(tn + fn as double)) > 0
  then (cast(tp as double) * cast(tn as double) - cast(fp as double) * cast(fn as double))
       / sqrt(cast(tp + fp as double) * cast(tp + fn as double) * cast(tn + fp as double) * cast(tn + fn as double))
  else cast(0 as double) end as mcc
from v_conf""", _CONF)
def q_mcc(spark, d):
    return M.mcc(M.confusion(B.eval_table(spark, d), G)).select(*G, "mcc")


# ------------------------------------------------------------------ A20-A24


@query("roc_auc", _auc_sql("v_eval", GS, "proba"))
def q_roc_auc(spark, d):
    return M.roc_auc(B.eval_table(spark, d), G, "proba")


@query("roc_curve", """
select test_on, threshold, case when N > 0 then cast(fp as double) / cast(N as double) else 0.0 end as fpr,
       case when P > 0 then cast(tp as double) / cast(P as double) else 0.0 end as tpr
from (select test_on, mean_proba as threshold,
             sum(pos) over (partition by test_on order by mean_proba desc rows between unbounded preceding and current row) as tp,
             sum(neg) over (partition by test_on order by mean_proba desc rows between unbounded preceding and current row) as fp,
             sum(pos) over (partition by test_on) as P, sum(neg) over (partition by test_on) as N
      from (select test_on, mean_proba, sum(label) as pos, sum(1 - label) as neg from v_mean group by test_on, mean_proba) h) c""",
       _MEAN)
def q_roc_curve(spark, d):
    return M.roc_curve(E.mean_proba(B.eval_table(spark, d)), ["test_on"], "mean_proba")


@query("trapezoid_auc", """
select test_on, coalesce(sum((fpr - pf) * (tpr + pt) / 2.0), 0.0) as trapezoid_auc from (
  select test_on, FPR as fpr, TPR as tpr, lag(FPR) over w as pf, lag(TPR) over w as pt
  from v_sweep_m window w as (partition by test_on order by FPR, TPR)) t
group by test_on""", ",\n".join([_MEAN, _SWEEP, _SWEEP_METRICS]))
def q_trapezoid_auc(spark, d):
    """Trapezoid area under the (FPR, TPR) points of the 1002-threshold sweep."""
    sw = M.threshold_sweep(E.mean_proba(B.eval_table(spark, d)), ["test_on"], "mean_proba")
    return M.trapezoid_auc(sw.select("test_on", F.col("FPR").alias("fpr"), F.col("TPR").alias("tpr")), ["test_on"])


@query("threshold_sweep", """
select test_on, threshold, accuracy, f1, precision, recall, TNR, FPR, TPR from v_sweep_m""",
       ",\n".join([_MEAN, _SWEEP, _SWEEP_METRICS]))
def q_threshold_sweep(spark, d):
    sw = M.threshold_sweep(E.mean_proba(B.eval_table(spark, d)), ["test_on"], "mean_proba")
    return sw.select("test_on", "threshold", "accuracy", "f1", "precision", "recall", "TNR", "FPR", "TPR")


@query("best_threshold", "select test_on, metric, best_value, threshold from v_best",
       ",\n".join([_MEAN, _SWEEP, _SWEEP_METRICS, _BEST]))
def q_best_threshold(spark, d):
    sw = M.threshold_sweep(E.mean_proba(B.eval_table(spark, d)), ["test_on"], "mean_proba")
    return M.best_threshold(sw, ["test_on"])


# ------------------------------------------------------------------ P8-P11


@query("hard_vote", """
select test_on, seq_index, cast(sum(pred) as integer) as votes, cast(count(*) as integer) as n_models,
       cast(case when sum(pred) > floor(count(*) / 2) then 1
                 when sum(pred) = floor(count(*) / 2) and count(*) % 2 = 0 then min(label) else 0 end as integer) as vote
from v_eval where train_on <> 'cao2021' group by test_on, seq_index""")
def q_hard_vote(spark, d):
    return E.vote_table(B.eval_table(spark, d), "cao2021", tie="label").select(
        "test_on", "seq_index", "votes", "n_models", "vote")


@query("row_mean_proba", """
select seq_index, round(avg(proba), 12) as mean_proba from v_pred_long group by seq_index""")
def q_row_mean_proba(spark, d):
    return P.row_mean_proba(X.pred_long(spark, d))


@query("binarize", """
select seq_index, model, train_on, cast(proba >= 0.5 as integer) as pred_05 from v_pred_long""")
def q_binarize(spark, d):
    pl = X.pred_long(spark, d)
    return pl.select("seq_index", "model", "train_on", P.binarize("proba", 0.5).alias("pred_05"))


@query("logit_head", """
select seq_index, model, train_on, 1.0 / (1.0 + exp(0.0 - (4.0 * proba - 2.0))) as proba_head,
       cast(case when 4.0 * proba - 2.0 > 0.0 then 1 else 0 end as integer) as pred_head
from v_pred_long""")
def q_logit_head(spark, d):
    pl = X.pred_long(spark, d).withColumn("logits", F.array(F.lit(0.0), F.lit(4.0) * F.col("proba") - F.lit(2.0)))
    proba, pred = P.logit_head("logits")
    return pl.select("seq_index", "model", "train_on", proba.alias("proba_head"), pred.alias("pred_head"))


# ------------------------------------------------------------------ A25, ML5, ML7, ML9, ML10, U4

_MODEL_METRICS = f"""
v_model_m as (
  select c.model, c.train_on, c.test_on, c.accuracy, c.f1, c.precision, c.recall, c.TNR, a.auc
  from (select {GS}, {_macro_sql()} from ({_conf_sql('case when proba >= 0.5 then 1 else 0 end')}) x) c
  join ({_auc_sql('v_eval', GS, 'proba')}) a
  on c.model = a.model and c.train_on = a.train_on and c.test_on = a.test_on)"""

_VOTE = f"""
v_vote as (
  select test_on,
         cast(case when sum(pred) > floor(count(*) / 2) then 1
                   when sum(pred) = floor(count(*) / 2) and count(*) % 2 = 0 then min(label) else 0 end as integer) as vote,
         min(label) as label
  from v_eval where train_on <> 'cao2021' group by test_on, seq_index),
v_vote_m as (
  select 'Major_vote' as model, '-' as train_on, test_on, accuracy, f1, precision, recall, TNR, cast(0.0 as double) as auc
  from (select test_on, {_macro_sql()} from ({_conf_sql('vote', 'v_vote', 'test_on')}) x) y)"""

_THRESH = f"""
v_thr_m as (
  select 'THRESHOLD' as model, '-' as train_on, b.test_on,
         max(case when metric = 'accuracy' then best_value end) as accuracy,
         max(case when metric = 'f1' then best_value end) as f1,
         max(case when metric = 'precision' then best_value end) as precision,
         max(case when metric = 'recall' then best_value end) as recall,
         max(case when metric = 'TNR' then best_value end) as TNR,
         max(a.auc) as auc
  from v_best b join ({_auc_sql('v_mean', 'test_on', 'mean_proba')}) a on a.test_on = b.test_on
  group by b.test_on)"""


@query("best_of_model", """
select model, test_on, max(accuracy) as accuracy, max(f1) as f1, max(precision) as precision, max(recall) as recall,
       max(TNR) as TNR, max(auc) as auc
from (select * from v_model_m union all select * from v_vote_m) t group by model, test_on""",
       ",\n".join([_MODEL_METRICS, _VOTE]))
def q_best_of_model(spark, d):
    ev = B.eval_table(spark, d)
    allm = E.metric_union(E.model_metrics(ev), E.vote_metrics(ev, tie="label"))
    return M.best_of_model(allm)


@query("metric_union", """
select * from v_vote_m union all select * from v_thr_m""",
       ",\n".join([_MEAN, _SWEEP, _SWEEP_METRICS, _BEST, _VOTE, _THRESH]))
def q_metric_union(spark, d):
    ev = B.eval_table(spark, d)
    return E.metric_union(E.vote_metrics(ev, tie="label"), E.threshold_metrics(ev))


@query("ensemble_report", """
select * from v_vote_m union all select * from v_model_m union all select * from v_thr_m""",
       ",\n".join([_MEAN, _SWEEP, _SWEEP_METRICS, _BEST, _VOTE, _THRESH, _MODEL_METRICS]))
def q_ensemble_report(spark, d):
    ev = B.eval_table(spark, d)
    return E.metric_union(E.vote_metrics(ev, tie="label"), E.model_metrics(ev), E.threshold_metrics(ev))


@query("best_blend", """
select 'BLEND' as model, train_on, test_on, accuracy, f1, precision, recall, TNR, auc from (
  select *, rank() over (partition by test_on order by auc desc) as r from v_model_m) t where r = 1""",
       _MODEL_METRICS)
def q_best_blend(spark, d):
    return E.best_blend(E.model_metrics(B.eval_table(spark, d))).select(
        "model", "train_on", "test_on", "accuracy", "f1", "precision", "recall", "TNR", "auc")


@query("blend_split", """
select seq_index, test_on,
       case when u < 0.7 then 'train' when u < 0.7 + 0.201 then 'test' else 'validation' end as part
from (select seq_index, test_on,
             cast(('0x' || substr(md5(concat('43', cast(seq_index as varchar))), 1, 8)) as bigint) / 4294967296.0 as u
      from v_labels) t""")
def q_blend_split(spark, d):
    lab = X.labels(spark, d)
    return lab.select("seq_index", "test_on", E.blend_split(lab).alias("part"))


def _blend_cols():
    return [(m, t) for _, m, t in X.MODELS if t != X.BASELINE_SET]


@query("blend_dataset", "select test_on, seq_index, " + ", ".join(
    f"max(case when model = '{m}' and train_on = '{t}' then pred end) as {m}_{t}" for m, t in
    [(m, t) for _, m, t in X.MODELS if t != X.BASELINE_SET]) + ", min(label) as true_lable from v_eval group by test_on, seq_index")
def q_blend_dataset(spark, d):
    return E.blend_dataset(B.eval_table(spark, d), _blend_cols())
