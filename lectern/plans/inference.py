"""Queries of slopes with p-values, fixed effects and permutation tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import effects, models, permutation, stats
from lectern.plans.analytics import _DAYS, days
from lectern.plans.registry import Tables, query, r6

#: Tests among which a series must stand out: 14 frames in two corpora.
TESTS = 28


def sql_t_tail(t: str, df: str) -> str:
    """Student's two-sided tail for whole degrees of freedom, as the finite series in the angle atan(t / sqrt(df))."""
    angle, terms = f"atan(abs({t}) / sqrt({df}))", f"range(0, ({df}) // 2)"
    even = f"sin({angle}) * coalesce(list_sum(list_transform({terms}, lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos({angle}), 2 * k))), 0)"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform({terms}, lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(cos({angle}), 2 * k + 1))), 0))"
    return f"case when ({df}) % 2 = 0 then 1 - {even} else 1 - {odd} end"


def _sql_slope(y: str, x: str) -> str:
    """b, se and n of a group's least squares."""
    return f"count(*) as n, regr_slope({y}, {x}) as b, sqrt(greatest(regr_syy({y}, {x}) - regr_sxy({y}, {x}) * regr_sxy({y}, {x}) / regr_sxx({y}, {x}), 0) / (count(*) - 2) / regr_sxx({y}, {x})) as se"


@query("trend_star", f"""
with x as (select user_id, day / 30.0 as t, n from ({_DAYS})), s as (select user_id, {_sql_slope('n', 't')} from x group by 1 having count(*) > 10), p as (select *, {sql_t_tail('b / se', 'n - 2')} as p from s)
select user_id, n, round(b, 6) as slope, round(se, 6) as se, round(p, 6) as p, p < 0.05 / {TESTS} as star from p
""")  # fmt: skip
def trend_star(t: Tables) -> DataFrame:
    x = days(t).select("user_id", (F.col("day") / 30).alias("t"), "n")
    s = stats.starred(stats.slope_by(x, ["user_id"], "n", "t").where("n > 10"), TESTS)
    return s.select("user_id", "n", r6(F.col("slope")).alias("slope"), r6(F.col("se")).alias("se"), r6(F.col("p")).alias("p"), "star")


@query("trend_logged", f"""
with x as (select l_returnflag, cast(year(l_shipdate) - 1992 as double) as t, sum(l_extendedprice * l_discount) / sum(l_extendedprice) as share from lineitem group by 1, 2),
s as (select l_returnflag, 'plain' as scale, {_sql_slope('share', 't')} from x group by 1 union all select l_returnflag, 'log', {_sql_slope('ln(share)', 't')} from x group by 1)
select l_returnflag, scale, n, round(b, 6) as slope, round({sql_t_tail('b / se', 'n - 2')}, 6) as p from s where n > 2
""")  # fmt: skip
def trend_logged(t: Tables) -> DataFrame:
    """The slope over years of a share and of its logarithm, each with its p."""
    x = t.lineitem.groupBy("l_returnflag", (F.year("l_shipdate") - 1992).cast("double").alias("t")).agg((F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice")).alias("share"))
    both = x.select("l_returnflag", "t", F.inline(F.array(F.struct(F.lit("plain").alias("scale"), F.col("share").alias("v")), F.struct(F.lit("log").alias("scale"), F.ln("share").alias("v")))))
    s = stats.slope_by(both, ["l_returnflag", "scale"], "v", "t").where("n > 2")
    return s.select("l_returnflag", "scale", "n", r6(F.col("slope")).alias("slope"), r6(F.col("p")).alias("p"))


@query("fe_two_way", f"""
with b as (select l_extendedprice as y, l_discount as x1, l_quantity as x2, (l_linestatus = 'O')::int as d, l_suppkey as g from lineitem),
m as (select y - avg(y) over w as y, x1 - avg(x1) over w as x1, x2 - avg(x2) over w as x2, d - avg(d) over w as d from b window w as (partition by g)),
f as (select sum(d * y) / sum(d * d) as ry, sum(d * x1) / sum(d * d) as r1, sum(d * x2) / sum(d * d) as r2 from m), e as (select y - ry * d as y, x1 - r1 * d as x1, x2 - r2 * d as x2 from m cross join f),
s as (select sum(x1 * x1) as a, sum(x1 * x2) as b, sum(x2 * x2) as c, sum(x1 * y) as p, sum(x2 * y) as q, count(*) as n from e),
k as (select *, a * c - b * b as det, (p * c - q * b) / (a * c - b * b) as b1, (q * a - p * b) / (a * c - b * b) as b2, n - 2 - (select count(distinct g) + count(distinct d) - 1 from b) as freedom from s),
u as (select sum(r * r * x1 * x1) as m11, sum(r * r * x1 * x2) as m12, sum(r * r * x2 * x2) as m22 from (select x1, x2, y - b1 * x1 - b2 * x2 as r from e cross join k)),
z as (select b1, b2, n, freedom, sqrt((c * c * m11 - 2 * b * c * m12 + b * b * m22) * n / freedom) / det as s1, sqrt((b * b * m11 - 2 * a * b * m12 + a * a * m22) * n / freedom) / det as s2 from k cross join u)
select 'l_discount' as term, round(b1, 3) as estimate, round(s1, 3) as robust_se, round(b1 / s1, 4) as t, n, freedom from z union all select 'l_quantity', round(b2, 3), round(s2, 3), round(b2 / s2, 4), n, freedom from z
""")  # fmt: skip
def fe_two_way(t: Tables) -> DataFrame:
    """Two regressors, effects of supplier and line status, robust errors; the SQL takes the two-level factor out as a regressor."""
    e = effects.two_way(t.lineitem, "l_extendedprice", ["l_discount", "l_quantity"], "l_suppkey", "l_linestatus")
    return e.select("term", F.round("estimate", 3).alias("estimate"), F.round("robust_se", 3).alias("robust_se"), F.round("t", 4).alias("t"), "n", "freedom")


@query("fe_many_levels")
def fe_many_levels(t: Tables) -> DataFrame:
    """Effects of supplier and month, both with many levels, weighted by quantity: no SQL, as each would be a dummy."""
    rows = t.lineitem.withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return effects.two_way(rows, "l_extendedprice", ["l_discount", "l_tax"], "l_suppkey", "month", "l_quantity")


@query("permutation_test")
def permutation_test(t: Tables) -> DataFrame:
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("quality", F.ln(F.col("n_chars") + 1).alias("v"))
    return permutation.permutation_test(d, "v", "quality")


@query("permutation_sizes", "select count(*) as rows_all, count(*) filter (where quality = 1) as least_first, count(*) filter (where quality = 1) as most_first, 20000::bigint as replicates, round(avg(l) filter (where quality = 1) - avg(l) filter (where quality = 0), 6) as seen from (select quality, ln(n_chars + 1) as l from labels join documents using (doc_id))")
def permutation_sizes(t: Tables) -> DataFrame:
    """What is certain of the test: the difference seen, and that the first group has its size in every replicate."""
    p = permutation_test(t)
    return p.select((F.col("n_first") + F.col("n_second")).alias("rows_all"), "least_first", "most_first", "replicates", r6(F.col("seen")).alias("seen"))


#: Regressors beside the interaction: a base, and two that add one more.
SPECS = {"base": ["n_orders", "items", "price"], "first": ["n_orders", "items", "price", "spread"], "second": ["n_orders", "items", "price", "late"]}


@query("binomial_specs")
def binomial_specs(t: Tables) -> DataFrame:
    """Three specifications of a logistic model with an interaction: estimates, standard errors, z and p."""
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    by = t.orders.join(items, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        (F.count(F.lit(1)) / 10).alias("n_orders"), (F.avg("q") / 50).alias("items"), (F.avg("o_totalprice") / 1e5).alias("price"),
        (F.avg("d") * 10).alias("spread"), F.avg((F.year("o_orderdate") > 1995).cast("double")).alias("late"),
    )
    d = t.customer.join(by, "c_custkey").select("*", (F.col("c_acctbal") > 4000).cast("double").alias("rich"), (F.col("c_nationkey") / 25).alias("place"))
    return models.interaction_specs(d, "rich", "place", "c_mktsegment", "BUILDING", SPECS)


@query("election_regression")
def election_regression(t: Tables) -> DataFrame:
    """A line over years that may bend by decade, with odd and even years and late ones apart: estimates, standard errors, t and p."""
    y = F.year("o_orderdate")
    rows = t.orders.select((F.col("o_totalprice") / 1000).alias("price"), (y - 1992).alias("years"), (y % 2).alias("odd"), (y >= 1998).cast("int").alias("late"), (F.floor(y / 10) * 10).cast("string").alias("decade"))
    first = rows.agg(F.min("decade")).first()[0]
    return models.interaction_specs(rows, "price", "years", "decade", first, {"line": [], "features": ["odd", "late"]}, family="gaussian")


@query("interaction_lines", """
with r as (select o_orderstatus as g, o_totalprice / 1000 as y, cast(year(o_orderdate) - 1995 as double) as x from orders),
s as (select g, count(*) as n, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_sxx(y, x) as sxx, avg(x) as mx, regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) as rss from r group by g),
v as (select sum(rss) / (sum(n) - 2 * count(*)) as s2 from s), f as (select n as fn, b as fb, a as fa, sxx as fxx, mx as fmx from s where g = 'F'),
z as (select 'years' as term, fb as e, sqrt(s2 / fxx) as se from f cross join v union all select '(Intercept)', fa, sqrt(s2 * (1.0 / fn + fmx * fmx / fxx)) from f cross join v
  union all select 'o_orderstatus_' || g, a - fa, sqrt(s2 * (1.0 / n + mx * mx / sxx + 1.0 / fn + fmx * fmx / fxx)) from s cross join f cross join v where g <> 'F'
  union all select 'years:o_orderstatus_' || g, b - fb, sqrt(s2 * (1.0 / sxx + 1.0 / fxx)) from s cross join f cross join v where g <> 'F')
select term, round(e, 5) as estimate, round(se, 5) as se, round(e / se, 4) as t from z
""")  # fmt: skip
def interaction_lines(t: Tables) -> DataFrame:
    """A line a status as one model with an interaction: the SQL fits each line by itself and pools the variance."""
    rows = t.orders.select((F.col("o_totalprice") / 1000).alias("price"), (F.year("o_orderdate") - 1995).cast("double").alias("years"), "o_orderstatus")
    e = models.interaction_specs(rows, "price", "years", "o_orderstatus", "F", {"line": []}, family="gaussian")
    return e.select("term", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se"), F.round("z", 4).alias("t"))
