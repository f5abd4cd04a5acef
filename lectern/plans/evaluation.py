"""Queries of calibration and of the parts of losses.

lineitem stands for segments with three class probabilities; its return flag, read as a class, for the label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import scores
from lectern.operators import calibration as cal
from lectern.operators import metrics
from lectern.plans.analytics import _EVAL, judged
from lectern.plans.registry import Tables, query, r6

_CLASSES = ("anti", "neutral", "pro")
# Rounded, so that equal probabilities are equal in any engine.
_SEGMENTS = """select key, w, y, round(exp(a) / (exp(a) + exp(n) + exp(p)), 6) as anti, round(exp(n) / (exp(a) + exp(n) + exp(p)), 6) as neutral, round(exp(p) / (exp(a) + exp(n) + exp(p)), 6) as pro
  from (select l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey as key, 1.0 + l_linenumber % 3 as w, case l_returnflag when 'A' then 'anti' when 'N' then 'neutral' else 'pro' end as y,
    l_discount * 10 as a, l_tax * 10 as n, l_quantity / 50 as p from lineitem)"""


def labelled(t: Tables) -> DataFrame:
    """Segments with key, weight, label and rounded probabilities."""
    flag = F.when(F.col("l_returnflag") == "A", "anti").when(F.col("l_returnflag") == "N", "neutral").otherwise("pro")
    probs = scores.softmax(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50)
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.select(key.alias("key"), (1.0 + F.col("l_linenumber") % 3).alias("w"), flag.alias("y"), *[r6(p).alias(c) for c, p in zip(_CLASSES, probs, strict=True)])


_MULTI_PREDICTED = "select *, case when anti >= neutral and anti >= pro then 'anti' when neutral >= pro then 'neutral' else 'pro' end as predicted, greatest(anti, neutral, pro) as own from s"
_SIZES = "select predicted, least(count(*), ceil(sum(w) / greatest((select count(*) // 50 from d), (select cast(floor(1.5 * count(distinct predicted)) as bigint) from d)))) as bins, count(*) as among from d group by 1"
_MULTI = f"""with s as ({_SEGMENTS}), d as ({_MULTI_PREDICTED}), z as ({_SIZES}),
b as (select d.*, cast(floor((row_number() over (partition by predicted order by own, key) * bins - 1) / among) as bigint) as bin from d join z using (predicted)),
e as (select predicted, bin, count(*) as n, sum(w) as weight,
  (abs(sum(w * (anti - (y = 'anti')::int)) / sum(w)) + abs(sum(w * (neutral - (y = 'neutral')::int)) / sum(w)) + abs(sum(w * (pro - (y = 'pro')::int)) / sum(w))) / 3 as error from b group by 1, 2)"""


def _multiclass(t: Tables) -> DataFrame:
    return cal.calibration_bins_multiclass(labelled(t), "y", {c: c for c in _CLASSES}, "key", "w")


@query("calibration_multiclass", f"{_MULTI} select predicted, bin, n, weight, round(error, 6) as error from e")
def calibration_multiclass(t: Tables) -> DataFrame:
    return _multiclass(t).select("predicted", "bin", "n", "weight", r6(F.col("error")).alias("error"))


@query("calibration_multiclass_score", f"{_MULTI} select count(*) as bins, round(avg(error), 6) as score from e")
def calibration_multiclass_score(t: Tables) -> DataFrame:
    return _multiclass(t).agg(F.count(F.lit(1)).alias("bins"), r6(F.avg("error")).alias("score"))


@query("calibration_weighted", f"""
with d as (select *, count(*) over () as among from ({_EVAL})), b as (select *, floor((row_number() over (order by p, doc_id) * least(among // 50 + 1, among) - 1) / among) as bin from d)
select cast(bin as bigint) as bin, count(*) as n, sum(w) as weight, round(sum(w * p) / sum(w), 6) as mean_p, round(sum(w * y) / sum(w), 6) as share, round(abs(sum(w * y) / sum(w) - sum(w * p) / sum(w)), 6) as error from b group by 1
""")  # fmt: skip
def calibration_weighted(t: Tables) -> DataFrame:
    b = cal.calibration_bins(judged(t), "y", "p", "doc_id", "w", more=1)
    return b.select("bin", "n", "weight", *[r6(F.col(c)).alias(c) for c in ("mean_p", "share", "error")])


@query("brier_parts", f"""
with d as (select *, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) over () as cuts from ({_EVAL})), b as (select *, len(list_filter(cuts, lambda c: c <= p)) as bin from d),
m as (select *, sum(w * p) over (partition by bin) / sum(w) over (partition by bin) as mp, sum(w * y) over (partition by bin) / sum(w) over (partition by bin) as my from b)
select round(sum(w * (p - y) * (p - y)) / sum(w), 6) as loss, round(sum(w * (mp - my) * (mp - my)) / sum(w), 6) as calibration, round(sum(w * (y - my) * (y - my)) / sum(w), 6) as refinement,
  round(sum(w * ((p - mp) * (p - mp) - 2 * (p - mp) * (y - my))) / sum(w), 6) as within, round(sum(w * p * (1 - p)) / sum(w), 6) as sharpness, round(sqrt(sum(w * (mp - my) * (mp - my)) / sum(w)), 6) as root from m
""")  # fmt: skip
def brier_parts(t: Tables) -> DataFrame:
    parts = cal.brier_parts(judged(t), "y", "p", "doc_id", "w")
    return parts.select(*[r6(F.col(c)).alias(c) for c in ("loss", "calibration", "refinement", "within", "sharpness", "root")])


_LOG = f"""with s as ({_SEGMENTS}),
r as (select key, w, 'anti' as class, (y = 'anti')::int as y, anti as p from s union all select key, w, 'neutral', (y = 'neutral')::int, neutral from s union all select key, w, 'pro', (y = 'pro')::int, pro from s),
c as (select class, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as cuts from r group by class), b as (select r.*, len(list_filter(cuts, lambda c: c <= p)) as bin from r join c using (class)),
m as (select class, bin, sum(w) as w, sum(w * p) / sum(w) as mp, sum(w * y) / sum(w) as my, sum(-w * y * ln(p)) / sum(w) as loss from b group by 1, 2),
l as (select class, sum(w * loss) / sum(w) as loss, sum(w * case when my > 0 then my * ln(my / mp) else 0 end) / sum(w) as calibration, sum(w * case when my > 0 then -my * ln(my) else 0 end) / sum(w) as refinement, sum(w * my) as mass from m group by 1)"""


def _log(t: Tables) -> DataFrame:
    return cal.log_parts(labelled(t), "y", {c: c for c in _CLASSES}, "key", "w")


@query("log_parts", f"{_LOG} select class, round(loss, 6) as loss, round(calibration, 6) as calibration, round(refinement, 6) as refinement, round(loss - calibration - refinement, 6) as within, mass from l")
def log_parts(t: Tables) -> DataFrame:
    return _log(t).select("class", *[r6(F.col(c)).alias(c) for c in ("loss", "calibration", "refinement", "within")], F.round("mass", 3).alias("mass"))


@query("log_calibration", f"{_LOG} select round(sum(loss), 6) as loss, round(sum(sqrt(greatest(calibration, 0)) * mass) / sum(mass), 6) as calibration from l")
def log_calibration(t: Tables) -> DataFrame:
    return cal.log_calibration(_log(t)).select(r6(F.col("loss")).alias("loss"), r6(F.col("calibration")).alias("calibration"))


@query("entropy_refinement", f"select round(-sum(w * (anti * ln(greatest(anti, 1e-6)) + neutral * ln(greatest(neutral, 1e-6)) + pro * ln(greatest(pro, 1e-6)))) / sum(w), 6) as refinement from ({_SEGMENTS})")
def entropy_refinement(t: Tables) -> DataFrame:
    return cal.entropy_refinement(labelled(t), list(_CLASSES), "w").select(r6(F.col("refinement")).alias("refinement"))


_GUESSED = f"select *, case when anti >= neutral and anti >= pro then 'anti' when neutral >= pro then 'neutral' else 'pro' end as y_hat from ({_SEGMENTS})"
_REPORT = f"""with d as ({_GUESSED}), k as (select unnest(['anti', 'neutral', 'pro']) as label),
c as (select label, sum(w) filter (where y = label) as t, coalesce(sum(w) filter (where y_hat = label), 0) as p, coalesce(sum(w) filter (where y = label and y_hat = label), 0) as h from k cross join d group by 1),
e as (select label, case when p > 0 then h / p else 0 end as precision, h / t as recall, 2 * h / (t + p) as f1, t as support from c), a as (select sum(h) / sum(t) as acc, sum(t) as support from c)"""


def guessed(t: Tables) -> DataFrame:
    return labelled(t).withColumn("y_hat", scores.argmax_label({c: F.col(c) for c in _CLASSES}))


@query("classification_report", f"""{_REPORT}, u as (select * from e union all select 'accuracy', acc, acc, acc, support from a union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from e
  union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from e)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from u""")  # fmt: skip
def classification_report(t: Tables) -> DataFrame:
    r = metrics.report(guessed(t), "y", "y_hat", "w")
    return r.select("label", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("task_metrics", f"""
with d as ({_GUESSED}), n as (select y, y_hat, count(*)::double as n from d group by 1, 2), t as (select y as label, sum(n) as t from n group by 1), p as (select y_hat as label, sum(n) as p from n group by 1),
h as (select t.label, t, coalesce(p, 0) as p, coalesce(n, 0) as h from t left join p using (label) left join n on y = t.label and y_hat = t.label),
m as (select sum(h) / sum(t) as acc, avg(2 * h / (t + p)) as macro, (sum(h) * sum(t) - sum(t * p)) / sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t))) as mcc from h),
r as (select l_discount as x, l_tax as y, rank() over (order by l_discount) + (count(*) over (partition by l_discount) - 1) / 2.0 as rx, rank() over (order by l_tax) + (count(*) over (partition by l_tax) - 1) / 2.0 as ry from lineitem),
k as (select corr(x, y) as pearson, corr(rx, ry) as spearman from r)
select 'mrpc' as task, 'acc' as metric, round(acc, 6) as value from m union all select 'mrpc', 'micro_f1', round(acc, 6) from m union all select 'mrpc', 'macro_f1', round(macro, 6) from m union all select 'mrpc', 'acc_and_macro_f1', round((acc + macro) / 2, 6) from m
union all select 'cola', 'mcc', round(mcc, 6) from m union all select 'sts-b', 'pearson', round(pearson, 6) from k union all select 'sts-b', 'spearmanr', round(spearman, 6) from k union all select 'sts-b', 'corr', round((pearson + spearman) / 2, 6) from k
""")  # fmt: skip
def task_metrics(t: Tables) -> DataFrame:
    g = guessed(t)
    parts = [metrics.task_metrics(df, task, y, x).withColumn("task", F.lit(task)) for task, df, y, x in (("mrpc", g, "y", "y_hat"), ("cola", g, "y", "y_hat"), ("sts-b", t.lineitem, "l_tax", "l_discount"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("task", "metric", r6(F.col("value")).alias("value"))
