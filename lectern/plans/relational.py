"""Queries of filters, joins, aggregates, sets, order and sampling, on the tables that stand for speeches and their records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import dates, scores
from lectern.operators import counts, joins, labels
from lectern.plans.registry import Tables, i64, query, r6
from lectern.sources.readers import blank_to, surveys
from lectern.vocab import PRESIDENTS



def rows():
    """The number of rows; a function, as columns need a session."""
    return F.count(F.lit(1))


# Filters and conditional columns


@query("filter_basic", "select o_orderkey, o_orderstatus from orders where o_orderkey <> 1 and cast(o_orderdate as date) <> date '1995-06-14'")
def filter_basic(t: Tables) -> DataFrame:
    return t.orders.where((F.col("o_orderkey") != 1) & (F.to_date("o_orderdate") != F.lit("1995-06-14").cast("date"))).select("o_orderkey", "o_orderstatus")


@query("filter_either", "select conv_id, turn, role from conversations where role = 'user' and (nullif(text, 'None') is not null or conv_id is not null)")
def filter_either(t: Tables) -> DataFrame:
    return t.conversations.where((F.col("role") == "user") & (F.nullif(F.col("text"), F.lit("None")).isNotNull() | F.col("conv_id").isNotNull())).select("conv_id", "turn", "role")


@query("filter_range", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 10 and 20")
def filter_range(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_quantity").between(10, 20)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_compound", "select o_orderkey, o_totalprice from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus <> 'F' and o_totalprice > 100000")
def filter_compound(t: Tables) -> DataFrame:
    keep = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") != "F") & (F.col("o_totalprice") > 100_000)
    return t.orders.where(keep).select("o_orderkey", "o_totalprice")


@query("filter_neq", "select event_id, value from events where event_type <> 'click'")
def filter_neq(t: Tables) -> DataFrame:
    return t.events.where("event_type <> 'click'").select("event_id", "value")


@query("filter_array_overlap", "select p_partkey from part where list_has_any(string_split(p_name, ' '), ['red', 'blue', 'green']) or list_has_any(string_split(p_type, ' '), ['BRASS', 'TIN'])")
def filter_array_overlap(t: Tables) -> DataFrame:
    has = lambda c, *ws: F.arrays_overlap(F.split(c, " "), F.array(*map(F.lit, ws)))
    return t.part.where(has("p_name", "red", "blue", "green") | has("p_type", "BRASS", "TIN")).select("p_partkey")


@query("case_chain", """
select o_orderkey, case when o_orderstatus = 'P' then 'None' when o_orderpriority = '1-URGENT' then 'Executive' when o_orderpriority like '2%' then 'D' else 'R' end as party from orders
""")  # fmt: skip
def case_chain(t: Tables) -> DataFrame:
    p = F.when(F.col("o_orderstatus") == "P", "None").when(F.col("o_orderpriority") == "1-URGENT", "Executive").when(F.startswith("o_orderpriority", F.lit("2")), "D").otherwise("R")
    return t.orders.select("o_orderkey", p.alias("party"))


_STATES = ["TX", "NY", "CA", "GA", "OH", "PR", "DK", "AZ", "WV", "HI"]


@query("region_case", """
select c_custkey, ['TX', 'NY', 'CA', 'GA', 'OH', 'PR', 'DK', 'AZ', 'WV', 'HI'][1 + c_nationkey % 10] as state,
  ['Southeast+Southwest', 'Northeast+Midwest', 'West', 'Southeast+Southwest', 'Northeast+Midwest', 'Other', 'Northeast+Midwest', 'Southeast+Southwest', 'Southeast+Southwest', 'West'][1 + c_nationkey % 10] as region from customer
""")  # fmt: skip
def region_case(t: Tables) -> DataFrame:
    state = F.get(F.array(*map(F.lit, _STATES)), (F.col("c_nationkey") % 10).cast("int"))
    return t.customer.select("c_custkey", state.alias("state")).withColumn("region", scores.region(F.col("state")))


@query("one_hot", """
select o_orderkey, case when o_orderstatus = 'F' then 1.0::double else 0.0::double end as "is_F", case when o_orderstatus = 'O' then 1.0::double else 0.0::double end as "is_O", case when o_orderstatus = 'P' then 1.0::double else 0.0::double end as "is_P" from orders
""")  # fmt: skip
def one_hot(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", *scores.one_hot(F.col("o_orderstatus"), ["F", "O", "P"], "is_"))


@query("compound_key", r"""
select k, regexp_extract(k, '^(.*) \(', 1) as name, regexp_extract(k, '\((\w+), ', 1) as party, regexp_extract(k, ', (\w+)\)$', 1) as state from (select c_name || ' (' || c_mktsegment || ', ' || 'S' || c_nationkey || ')' as k from customer)
""")  # fmt: skip
def compound_key(t: Tables) -> DataFrame:
    k = t.customer.select(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(", S"), "c_nationkey", F.lit(")")).alias("k"))
    part = lambda p: F.regexp_extract("k", p, 1)
    return k.select("k", part(r"^(.*) \(").alias("name"), part(r"\((\w+), ").alias("party"), part(r", (\w+)\)$").alias("state"))


@query("blank_to_unknown", "select s_suppkey, case when s_suppkey % 3 = 0 then 'Unknown' else s_name end as party from supplier")
def blank_to_unknown(t: Tables) -> DataFrame:
    return blank_to(t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name")).alias("party")), "party")


@query("day_boost_filter", """
with d as (select cast(o_orderdate as date) as day, count(*) as n_day from orders where o_orderstatus = 'F' group by 1),
s as (select o_orderkey, cast(o_orderdate as date) as day, (o_orderkey % 100) / 100.0 as p from orders where o_orderstatus <> 'F')
select o_orderkey, round(p, 6) as p, coalesce(n_day, 0) as n_day from s left join d using (day) where p > 0.5 and round(p * 100) + coalesce(n_day, 0) > 100
""")  # fmt: skip
def day_boost_filter(t: Tables) -> DataFrame:
    o = t.orders.withColumn("day", F.to_date("o_orderdate"))
    d = o.where("o_orderstatus = 'F'").groupBy("day").agg(rows().alias("n_day"))
    s = o.where("o_orderstatus <> 'F'").select("o_orderkey", "day", ((F.col("o_orderkey") % 100) / 100).alias("p")).join(d, "day", "left").withColumn("n_day", F.coalesce("n_day", F.lit(0)))
    return s.where((F.col("p") > 0.5) & (F.round(F.col("p") * 100) + F.col("n_day") > 100)).select("o_orderkey", r6(F.col("p")).alias("p"), "n_day")


# Joins


@query("join_inner", "select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def join_inner(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("left_join_coalesce", """
select c_custkey, coalesce(s_name, c_name) as name, coalesce(s_acctbal, c_acctbal) as acctbal from customer left join supplier on s_suppkey = c_custkey
""")  # fmt: skip
def left_join_coalesce(t: Tables) -> DataFrame:
    left = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    right = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return joins.overwrite(left, right, "c_custkey", ["name", "acctbal"])


@query("left_join", "select n_name, r_name from nation left join region on r_regionkey = n_regionkey and r_name <> 'ASIA'")
def left_join(t: Tables) -> DataFrame:
    return t.nation.join(t.region.where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name")


@query("interval_join_last", """
with t as (select c_custkey, k as pos, make_date(1992 + 2 * cast(k as integer), 1, 1) as lo, make_date(1995 + 2 * cast(k as integer), 1, 1) as hi, 'term' || k || '-' || c_custkey % 3 as party from customer, range(3) r(k)),
m as (select o_orderkey, max_by(party, pos) as party from orders join t on o_custkey = c_custkey and cast(o_orderdate as date) between lo and hi group by o_orderkey)
select o_orderkey, party from orders left join m using (o_orderkey)
""")  # fmt: skip
def interval_join_last(t: Tables) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    terms = t.customer.select(F.col("c_custkey").alias("who"), k.alias("pos"))
    day = lambda y: F.make_date(F.lit(y) + 2 * F.col("pos"), F.lit(1), F.lit(1))
    terms = terms.select("who", "pos", day(1992).alias("lo"), day(1995).alias("hi"), F.concat(F.lit("term"), "pos", F.lit("-"), F.col("who") % 3).alias("party"))
    facts = t.orders.select("o_orderkey", F.col("o_custkey").alias("who"), F.to_date("o_orderdate").alias("day"))
    return joins.interval_last(facts, terms, "who", "day", "lo", "hi", "pos", ["party"], ["o_orderkey"]).select("o_orderkey", "party")


@query("join_segments", "select l_orderkey, l_linenumber, round(l_discount, 6) as p from lineitem join (select o_orderkey from orders where o_totalprice > 200000) on o_orderkey = l_orderkey where l_linenumber = 1")
def join_segments(t: Tables) -> DataFrame:
    chosen = t.orders.where("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.where("l_linenumber = 1").join(chosen, "l_orderkey").select("l_orderkey", "l_linenumber", r6(F.col("l_discount")).alias("p"))


@query("full_outer_diff", """
select coalesce(c_nationkey, s_nationkey) as nationkey, case when s_nationkey is null then 'left' else 'right' end as side from (select distinct c_nationkey from customer where c_acctbal > 9000 and c_nationkey < 20) full join (select distinct s_nationkey from supplier where s_nationkey > 4) on c_nationkey = s_nationkey where c_nationkey is null or s_nationkey is null
""")  # fmt: skip
def full_outer_diff(t: Tables) -> DataFrame:
    a = t.customer.where("c_acctbal > 9000 and c_nationkey < 20").select(F.col("c_nationkey").alias("nationkey")).distinct()
    b = t.supplier.where("s_nationkey > 4").select(F.col("s_nationkey").alias("nationkey")).distinct()
    return a.join(b, "nationkey", "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, "nationkey", "left_anti").withColumn("side", F.lit("right")))


@query("left_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def left_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("left_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def left_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


_PRESIDENT_SQL = "(values " + ", ".join(f"({a}, {b}, '{p}', '{n}')" for a, b, p, n in PRESIDENTS) + ') as p("start", "end", party, name)'


@query("range_join", f"""
select p.name, p.party, count(*) as n from (select year(o_orderdate) as year from orders) o join {_PRESIDENT_SQL} on year >= p."start" and year < p."end" group by 1, 2
""")  # fmt: skip
def range_join(t: Tables) -> DataFrame:
    p = t.rows("start int, end int, party string, name string", *PRESIDENTS)
    return joins.in_range(t.orders.select(F.year("o_orderdate").alias("year")), p, "year", "start", "end").groupBy("name", "party").agg(rows().alias("n"))


@query("join_multi_key", """
with s as (select s_nationkey as k, cast(s_suppkey % 5 as bigint) as decade, avg(s_acctbal) as ses from supplier group by 1, 2), c as (select c_nationkey as k, cast(c_custkey % 5 as bigint) as decade, count(*) as n from customer group by 1, 2)
select k, decade, n, round(ses, 4) as ses from c join s using (k, decade)
""")  # fmt: skip
def join_multi_key(t: Tables) -> DataFrame:
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 5).alias("decade")).agg(F.avg("s_acctbal").alias("ses"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 5).alias("decade")).agg(rows().alias("n"))
    return c.join(s, ["k", "decade"]).select("k", "decade", "n", F.round("ses", 4).alias("ses"))


@query("join_one_to_one", "select n_nationkey, n_name, n from nation join (select s_nationkey, count(*) as n from supplier group by 1) on s_nationkey = n_nationkey")
def join_one_to_one(t: Tables) -> DataFrame:
    n = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(rows().alias("n"))
    return joins.one_to_one(t.nation.select("n_nationkey", "n_name"), n, ["n_nationkey"]).select("n_nationkey", "n_name", "n")


@query("fuzzy_best_match", """
with b as (select c_custkey, c_name, s_name, 100.0 * (1 - levenshtein(c_name, s_name) / cast(greatest(length(c_name), length(s_name)) as double)) as score from customer join supplier on c_nationkey = s_nationkey)
select c_custkey, s_name, round(score, 6) as score from b qualify row_number() over (partition by c_custkey order by score desc, s_name) = 1
""")  # fmt: skip
def fuzzy_best_match(t: Tables) -> DataFrame:
    left = t.customer.select("c_custkey", "c_name", F.col("c_nationkey").alias("nation"))
    right = t.supplier.select("s_name", F.col("s_nationkey").alias("nation"))
    return joins.best_match(left, right, ["nation"], "c_name", "s_name").select("c_custkey", "s_name", r6(F.col("score")).alias("score"))


@query("union_prefer_last", """
select k, name from (select c_custkey as k, c_name as name, 0 as p from customer union all select s_suppkey, s_name, 1 from supplier) qualify row_number() over (partition by k order by p desc) = 1
""")  # fmt: skip
def union_prefer_last(t: Tables) -> DataFrame:
    a, b = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return joins.prefer_last([a, b], "k")


# Aggregates


@query("agg_count", "select source, count(*) as n from documents group by source")
def agg_count(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(rows().alias("n"))


@query("agg_two_key", "select user_id, event_type, count(*) as n from events group by 1, 2")
def agg_two_key(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(rows().alias("n"))


@query("grouping_sets_party", """
with d as (select source, case lang when 'en' then 'D' when 'fr' then 'R' else 'Unknown' end as party, n_chars from documents)
select source, 'all' as party, count(*) as n_speeches, cast(sum(n_chars) as bigint) as n_chars from d group by source union all select source, party, count(*), cast(sum(n_chars) as bigint) from d where party in ('D', 'R') group by source, party
""")  # fmt: skip
def grouping_sets_party(t: Tables) -> DataFrame:
    party = F.when(F.col("lang") == "en", "D").when(F.col("lang") == "fr", "R").otherwise("Unknown")
    d = t.documents.select("source", party.alias("party"), "n_chars")
    return counts.by_party(d, "source", "party", {"n_speeches": F.lit(1), "n_chars": F.col("n_chars")}).select("source", "party", "n_speeches", "n_chars")


@query("agg_max", "select l_orderkey, max(l_discount) as max_p from lineitem group by 1")
def agg_max(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.max("l_discount").alias("max_p"))


@query("daily_count", "select cast(ts as date) as day, count(*) as n from events where event_type in (select event_type from events group by 1 having count(*) > 10) group by 1")
def daily_count(t: Tables) -> DataFrame:
    often = t.events.groupBy("event_type").agg(rows().alias("m")).where("m > 10").select("event_type")
    return t.events.join(often, "event_type", "left_semi").groupBy(F.to_date("ts").alias("day")).agg(rows().alias("n"))


@query("agg_count_distinct", "select event_type, count(distinct user_id) as n_users, count(distinct cast(ts as date)) as n_days from events group by 1")
def agg_count_distinct(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct(F.to_date("ts")).alias("n_days"))


@query("agg_collect_list", "select o_custkey, array_to_string(list(o_orderkey order by o_orderkey), ',') as orders from orders group by 1")
def agg_collect_list(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("orders"))


@query("length_stats", """
select lang, round(avg(n_chars), 4) as mean_chars, round(quantile_cont(n_chars, 0.5), 4) as median_chars, max(n_chars) as max_chars, round(avg(case when n_chars > 2000 then 1.0 else 0.0 end), 6) as share_long from documents group by lang
""")  # fmt: skip
def length_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(
        F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.percentile("n_chars", 0.5), 4).alias("median_chars"), F.max("n_chars").alias("max_chars"),
        r6(F.avg(F.when(F.col("n_chars") > 2000, 1.0).otherwise(0.0))).alias("share_long"),
    )


@query("agg_argmax", "select lang, doc_id, n_chars from documents qualify row_number() over (partition by lang order by n_chars desc, doc_id) = 1")
def agg_argmax(t: Tables) -> DataFrame:
    best = F.max_by(F.struct("doc_id", "n_chars"), F.struct("n_chars", -F.col("doc_id")))
    return t.documents.groupBy("lang").agg(best.alias("b")).select("lang", "b.doc_id", "b.n_chars")


@query("agg_mean", "select s_nationkey, round(avg(s_acctbal), 4) as acctbal from supplier group by 1")
def agg_mean(t: Tables) -> DataFrame:
    return t.supplier.groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 4).alias("acctbal"))


@query("agg_having", "select o_custkey, count(*) as n from orders group by 1 having count(*) >= 10")
def agg_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(rows().alias("n")).where("n >= 10")


@query("agg_mode", """
with c as (select o_custkey, o_orderpriority, count(*) as n_mode from orders group by 1, 2), r as (select *, sum(n_mode) over (partition by o_custkey) as n, row_number() over (partition by o_custkey order by n_mode desc, o_orderpriority) as r from c)
select o_custkey, o_orderpriority, n_mode, cast(n as bigint) as n from r where r = 1 and n_mode >= 0.4 * n
""")  # fmt: skip
def agg_mode(t: Tables) -> DataFrame:
    return counts.mode_by(t.orders, ["o_custkey"], "o_orderpriority").where("n_mode >= 0.4 * n").select("o_custkey", "o_orderpriority", "n_mode", "n")


@query("net_share", "select c_mktsegment, round(100.0 * (sum(case when c_acctbal > 5000 then 1 else 0 end) - sum(case when c_acctbal < 0 then 1 else 0 end)) / count(*), 6) as net from customer group by 1")
def net_share(t: Tables) -> DataFrame:
    v = F.when(F.col("c_acctbal") > 5000, 1).when(F.col("c_acctbal") < 0, -1).otherwise(0)
    return t.customer.groupBy("c_mktsegment").agg(r6(100.0 * F.sum(v) / rows()).alias("net"))


@query("pivot_counts", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as \"F\", count(*) filter (where o_orderstatus = 'O') as \"O\", count(*) filter (where o_orderstatus = 'P') as \"P\" from orders group by 1")
def pivot_counts(t: Tables) -> DataFrame:
    wide = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in "FOP"])


@query("weighted_mean", "select l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) as m from lineitem group by 1")
def weighted_mean(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(r6(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity")).alias("m"))


@query("explode_counts", "select user_id, cast(i as bigint) as copy from (select user_id, count(*) filter (where event_type = 'purchase') as n from events group by 1), lateral (select unnest(range(n)) as i)")
def explode_counts(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    return n.select("user_id", F.posexplode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("copy", "x")).select("user_id", i64(F.col("copy")).alias("copy"))


# Sets


@query("set_union", "select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("set_intersect", "select c_custkey as k from customer intersect select s_suppkey from supplier")
def set_intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).intersect(t.supplier.select("s_suppkey"))


@query("set_except", "select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'P'")
def set_except(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("union_all", "select c_custkey as k, c_name as name from customer union all select s_suppkey, s_name from supplier")
def union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).unionByName(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query("union_by_name", "select c_custkey as k, c_mktsegment as segment, null::double as bal from customer union all select s_suppkey, null, s_acctbal from supplier")
def union_by_name(t: Tables) -> DataFrame:
    return surveys([(t.customer, {"c_custkey": "k", "c_mktsegment": "segment"}), (t.supplier, {"s_suppkey": "k", "s_acctbal": "bal"})])


@query("union_weighted", "select doc_id, 1.0::double as weight from labels where quality = 1 union all select doc_id, 0.5::double from labels where quality = 0")
def union_weighted(t: Tables) -> DataFrame:
    base, extra = t.labels.where("quality = 1").select("doc_id", F.lit(1.0).alias("weight")), t.labels.where("quality = 0").select("doc_id", F.lit(1.0).alias("weight"))
    return base.unionByName(extra.withColumn("weight", F.col("weight") * 0.5))


# Order, sampling, assignment


@query("sort_by_date", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from orders")
def sort_by_date(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", i64(F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).alias("place"))


@query("top_n_per_group", "select event_type, event_id, value from events qualify row_number() over (partition by event_type order by value desc, event_id desc) <= 25")
def top_n_per_group(t: Tables) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("value").desc(), F.col("event_id").desc()))
    return t.events.withColumn("r", r).where("r <= 25").select("event_type", "event_id", "value")


@query("most_common", "select p_brand, count(*) as n from part group by 1 order by 2 desc, 1 limit 10")
def most_common(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(rows().alias("n")).orderBy(F.col("n").desc(), "p_brand").limit(10)


@query("top_k_excluding", "select c_nationkey, count(*) as n from customer where c_nationkey not in (1, 2, 3, 4) group by 1 order by 2 desc, 1 limit 20")
def top_k_excluding(t: Tables) -> DataFrame:
    return t.customer.where(~F.col("c_nationkey").isin(1, 2, 3, 4)).groupBy("c_nationkey").agg(rows().alias("n")).orderBy(F.col("n").desc(), "c_nationkey").limit(20)


@query("top_k_filtered", """
with c as (select user_id || '-' || event_type as name, count(*) as n from events group by 1 order by 2 desc, 1 limit 100) select name, n from c where not starts_with(name, '1') order by n desc, name limit 20
""")  # fmt: skip
def top_k_filtered(t: Tables) -> DataFrame:
    c = t.events.groupBy(F.concat_ws("-", "user_id", "event_type").alias("name")).agg(rows().alias("n"))
    return counts.top_then_filter(c, "name", "n", "1")


@query("hash_split", "select l.doc_id from labels l qualify row_number() over (partition by quality order by md5(concat_ws('|', doc_id, '42')), doc_id) <= 20")
def hash_split(t: Tables) -> DataFrame:
    return labels.ranked(t.labels, "doc_id", 42, ["quality"]).where("rn <= 20").select("doc_id")


@query("bernoulli_sample", "select event_id from events where substr(md5(concat_ws('|', event_id, '7')), 1, 1) in ('0', '1')")
def bernoulli_sample(t: Tables) -> DataFrame:
    return t.events.where(F.substring(labels.shuffle_key(7, "event_id"), 1, 1).isin("0", "1")).select("event_id")


@query("repeated_folds", """
with e as (select doc_id, fold from labels, range(5) r(fold)), k as (select *, row_number() over (partition by fold order by md5(concat_ws('|', doc_id, fold)), doc_id) as rn, count(*) over (partition by fold) as n from e)
select doc_id, cast(fold as bigint) as fold, cast(rn <= floor(n * 0.2) as bigint) as test from k
""")  # fmt: skip
def repeated_folds(t: Tables) -> DataFrame:
    f = labels.repeated_folds(t.labels, "doc_id", 5, 0.2)
    return f.select("doc_id", i64(F.col("fold")).alias("fold"), i64(F.col("test")).alias("test"))


@query("split_n_way", """
with k as (select doc_id, lang, row_number() over (partition by lang order by md5(concat_ws('|', doc_id, '5')), doc_id) as rn, count(*) over (partition by lang) as n from documents)
select doc_id, lang, cast(least(floor((rn - 1) / greatest(n // 4, 1)), 3) as bigint) as piece from k
""")  # fmt: skip
def split_n_way(t: Tables) -> DataFrame:
    k = labels.ranked(t.documents.select("doc_id", "lang"), "doc_id", 5, ["lang"]).join(t.documents.groupBy("lang").agg(rows().alias("n")), "lang")
    return k.select("doc_id", "lang", labels.split_n_way(F.col("rn"), F.col("n"), 4).alias("piece"))


@query("round_robin_assign", """
with k as (select item_id, row_number() over (order by md5(concat_ws('|', item_id, '3')), item_id) as rn from benchmark)
select item_id, unnest([['a', 'b'], ['a', 'c'], ['b', 'c']][1 + (rn - 1) % 3]) as annotator from k
""")  # fmt: skip
def round_robin_assign(t: Tables) -> DataFrame:
    return labels.round_robin(t.benchmark, "item_id", [["a", "b"], ["a", "c"], ["b", "c"]], 3)


# Dates


@query("session_of_date", """
select o_orderkey, cast(floor((y - 2013) / 2.0) + 113 as integer) as session from (select o_orderkey, year(o_orderdate) - case when month(o_orderdate) > 1 or day(o_orderdate) > 2 then 0 else 1 end as y from orders)
""")  # fmt: skip
def session_of_date(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", dates.date_to_session(F.to_date("o_orderdate")).alias("session"))


@query("session_years", """
select distinct y, cast(floor((y - 1873) / 2.0) + 43 as integer) as session, cast((floor((y - 1873) / 2.0)) * 2 + 1874 as integer) as year, cast(floor((floor((y - 1873) / 2.0) + 43 - 47) / 5.0) * 10 + 1885 as integer) as decade from (select cast(1780 + c_custkey % 240 as integer) as y from customer)
""")  # fmt: skip
def session_years(t: Tables) -> DataFrame:
    y = t.customer.select((1780 + F.col("c_custkey") % 240).cast("int").alias("y")).distinct().withColumn("session", dates.year_to_session(F.col("y")))
    return y.withColumns({"year": dates.session_to_year(F.col("session")), "decade": dates.session_to_decade(F.col("session"))})


@query("month_names", """
select o_orderkey, cast(month(o_orderdate) as integer) as month, case when o_orderkey % 5 > 0 then cast(year(o_orderdate) as integer) end as year from orders
""")  # fmt: skip
def month_names(t: Tables) -> DataFrame:
    name = F.lower(F.date_format("o_orderdate", "MMMM"))
    said = F.concat(name, F.lit(" 1, "), F.when(F.col("o_orderkey") % 5 > 0, F.year("o_orderdate").cast("string")).otherwise(F.lit("late")))
    return t.orders.select("o_orderkey", dates.month_number(name).alias("month"), dates.trailing_year(said).alias("year"))


@query("white_house_party", """
select k, case when d < date '1869-03-04' then null when d < date '1885-03-04' then 'R' when d < date '1889-03-04' then 'D' when d < date '1893-03-04' then 'R' when d < date '1897-03-04' then 'D'
  when d < date '1913-03-04' then 'R' when d < date '1921-03-04' then 'D' when d < date '1933-03-04' then 'R' when d < date '1953-01-20' then 'D' when d < date '1961-01-20' then 'R' when d < date '1969-01-20' then 'D'
  when d < date '1977-01-20' then 'R' when d < date '1981-01-20' then 'D' when d < date '1993-01-20' then 'R' when d < date '2001-01-20' then 'D' when d < date '2009-01-20' then 'R' when d < date '2017-01-20' then 'D' end as party
from (select o_orderkey as k, date '1860-01-01' + cast(o_orderkey * 13 % 60000 as integer) as d from orders)
""")  # fmt: skip
def white_house_party(t: Tables) -> DataFrame:
    d = F.date_add(F.lit("1860-01-01").cast("date"), (F.col("o_orderkey") * 13 % 60000).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("k"), dates.white_house_party(d).alias("party"))


@query("period_ladder", """
select y, case when y < 1882 then '1873-1881' when y < 1891 then '1882-1890' when y < 1903 then '1891-1902' when y < 1913 then '1903-1912' when y < 1920 then '1913-1919' when y < 1925 then '1920-1924'
  when y < 1932 then '1925-1931' when y < 1965 then '1932-1965' else '1965+' end as period, case when y < 1924 then 'early' when y < 1965 then 'mid' else 'modern' end as era,
  cast(floor(case when y = 2019 then 2020 else y end / 10.0) * 10 as integer) as decade from (select distinct cast(1870 + c_custkey % 151 as integer) as y from customer)
""")  # fmt: skip
def period_ladder(t: Tables) -> DataFrame:
    y = t.customer.select((1870 + F.col("c_custkey") % 151).cast("int").alias("y")).distinct()
    return y.withColumns({"period": dates.named_period(F.col("y")), "era": dates.era_of_three(F.col("y")), "decade": dates.decade(F.col("y"))})


@query("months_to_election", """
with m as (select distinct cast(date_trunc('month', o_orderdate) as date) as m from orders)
select m, cast(floor(date_diff('day', m, make_date(case when year(m) % 2 = 1 then year(m) + 1 when month(m) = 12 then year(m) + 2 else year(m) end, 11, 1)) / 30.0) as integer) as months,
  cast(year(m) as integer) as year, cast(year(m) * 100 + month(m) as integer) as yearmonth from m
""")  # fmt: skip
def months_to_election(t: Tables) -> DataFrame:
    m = t.orders.select(F.trunc("o_orderdate", "month").alias("m")).distinct()
    day = F.date_format("m", "yyyyMMdd").cast("int")
    return m.select("m", dates.months_to_election(F.col("m")).alias("months"), dates.year_of_int(day).alias("year"), dates.month_of_int(day).alias("yearmonth"))


@query("term_label", """
with p as (select case when o_orderpriority = '1-URGENT' then 'Grover Cleveland' else o_orderpriority end as person, year(o_orderdate) - 103 as y from orders)
select case when person <> 'Grover Cleveland' then person when y < 1892 then 'Grover Cleveland (85-89)' else 'Grover Cleveland (93-97)' end as person, count(*) as n from p group by 1
""")  # fmt: skip
def term_label(t: Tables) -> DataFrame:
    person = F.when(F.col("o_orderpriority") == "1-URGENT", "Grover Cleveland").otherwise(F.col("o_orderpriority"))
    named = t.orders.select(dates.term_label(person, F.year("o_orderdate") - 103).alias("person"))
    return named.groupBy("person").agg(F.count(F.lit(1)).alias("n"))
