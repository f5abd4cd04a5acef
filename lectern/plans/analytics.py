"""Queries of scores, series, associations, agreement, evaluation and regression.

lineitem stands for segments with three logits, orders for speeches with dates, customers for speakers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import scores
from lectern.functions.text import words
from lectern.operators import counts, labels, models, segment, stats
from lectern.operators.calibration import calibration as calibration_curve
from lectern.plans.registry import Tables, i64, query, r6
from lectern.vocab import CONFUSION, terms_table

#: Queries and vectors that a top-k search compares at a time.
QUERY_BLOCK = 4096


def rows():
    """The number of rows; a function, as columns need a session."""
    return F.count(F.lit(1))
WORDS = r"list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')"

_PROBS = """select l_orderkey, l_linenumber, l_quantity, exp(a) / (exp(a) + exp(n) + exp(p)) as anti, exp(n) / (exp(a) + exp(n) + exp(p)) as neutral, exp(p) / (exp(a) + exp(n) + exp(p)) as pro,
  case when a >= n and a >= p then 'anti' when n >= p then 'neutral' else 'pro' end as label
  from (select l_orderkey, l_linenumber, l_quantity, l_discount * 10 as a, l_tax * 10 as n, l_quantity / 50 as p from lineitem)"""
_TONES = f"""select l_orderkey, sum(anti) as anti, sum(neutral) as neutral, sum(pro) as pro, count(*) as n, count(*) filter (where label = 'anti') as n_anti, count(*) filter (where label = 'neutral') as n_neutral,
  count(*) filter (where label = 'pro') as n_pro from ({_PROBS}) group by l_orderkey"""


def segments(t: Tables) -> DataFrame:
    """Segments with class probabilities, by the same steps as in SQL to the last bit, and the predicted class; the logits are small numbers."""
    logit = {"anti": F.col("l_discount") * 10, "neutral": F.col("l_tax") * 10, "pro": F.col("l_quantity") / 50}
    p = scores.softmax(*logit.values(), shift=False)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", *[x.alias(k) for k, x in zip(logit, p, strict=True)], scores.argmax_label(logit).alias("label"))


def speeches(t: Tables) -> DataFrame:
    """Speeches with their classes' sums, which don't depend on the order of segments, and counts."""
    sums = [scores.share_sum(F.col(c)).alias(c) for c in scores.TONES]
    return segments(t).groupBy("l_orderkey").agg(*sums, rows().alias("n"), *[F.count_if(F.col("label") == c).alias(f"n_{c}") for c in scores.TONES])


def dated(t: Tables) -> DataFrame:
    """Speeches with period and party."""
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus", F.floor((F.year("o_orderdate") - 1991) / 2).alias("period"))
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("party"))
    return speeches(t).join(o, "l_orderkey").join(c, "o_custkey")


_DATED = f"select s.*, o_custkey, o_orderstatus, cast(floor((year(o_orderdate) - 1991) / 2.0) as bigint) as period, c_mktsegment as party from ({_TONES}) s join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey"


@query("softmax", f"select l_orderkey, l_linenumber, round(anti, 6) as anti, round(neutral, 6) as neutral, round(pro, 6) as pro from ({_PROBS})")
def softmax(t: Tables) -> DataFrame:
    return segments(t).select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in scores.TONES])


@query("argmax_label", f"select l_orderkey, l_linenumber, label from ({_PROBS})")
def argmax_label(t: Tables) -> DataFrame:
    return segments(t).select("l_orderkey", "l_linenumber", "label")


@query("prediction_check", f"select label, count(*) as n, count(*) filter (where greatest(anti, neutral, pro) >= 0.5) as n_sure from ({_PROBS}) group by label")
def prediction_check(t: Tables) -> DataFrame:
    return segments(t).groupBy("label").agg(rows().alias("n"), F.count_if(F.greatest(*scores.TONES) >= 0.5).alias("n_sure"))


@query("era_interpolate", """
select l_orderkey, l_linenumber, c as session, round((1 - w) * l_discount + w * l_tax, 6) as p from (select *, least(1.0, greatest(0.0, (c - 73) / 12.0)) as w from (select *, cast(60 + l_orderkey % 40 as integer) as c from lineitem))
""")  # fmt: skip
def era_interpolate(t: Tables) -> DataFrame:
    c = (60 + F.col("l_orderkey") % 40).cast("int")
    return t.lineitem.select("l_orderkey", "l_linenumber", c.alias("session"), r6(scores.interpolate(F.col("l_discount"), F.col("l_tax"), c)).alias("p"))


@query("tone_aggregate", f"select l_orderkey, n, n_anti, n_neutral, n_pro, round(anti, 6) as anti, round(neutral, 6) as neutral, round(pro, 6) as pro from ({_TONES})")
def tone_aggregate(t: Tables) -> DataFrame:
    return speeches(t).select("l_orderkey", "n", "n_anti", "n_neutral", "n_pro", *[r6(F.col(c)).alias(c) for c in scores.TONES])


@query("tone_score", f"""
select l_orderkey, round((pro - anti) / (anti + neutral + pro + 1), 6) as tone, round(case when l_orderkey % 3 = 0 then (pro - anti) / (anti + neutral + pro + 1) else 0 end, 6) as keyword_tone,
  round(case when l_orderkey % 3 = 0 then 0 else (pro - anti) / (anti + neutral + pro + 1) end, 6) as other_tone from ({_TONES})
""")  # fmt: skip
def tone_score(t: Tables) -> DataFrame:
    s, k = speeches(t), F.col("l_orderkey") % 3 == 0
    sides = [{c: F.when(k == side, F.col(c)) for c in scores.TONES} for side in (True, False)]
    own, other = (scores.tone(*side.values()) for side in sides)
    both = F.when(k, own).otherwise(other)
    return s.select("l_orderkey", r6(both).alias("tone"), r6(own).alias("keyword_tone"), r6(other).alias("other_tone"))


@query("tone_binary", f"select l_orderkey, round(case when n_anti + n_pro > 0 then n_pro / (n_anti + n_pro) end, 6) as tone from ({_TONES})")
def tone_binary(t: Tables) -> DataFrame:
    return speeches(t).select("l_orderkey", r6(scores.binary_tone(F.col("n_anti"), F.col("n_pro"))).alias("tone"))


@query("net_tone_band", f"""
with d as (select period, party, count(*) as n, count(*) filter (where pro >= anti and pro >= neutral and not (anti >= pro) and not (neutral >= pro)) as n_pro, count(*) filter (where anti >= neutral and anti >= pro) as n_anti
   from ({_DATED}) where not (o_orderstatus = 'F' and n < 3) group by 1, 2),
s as (select *, n_pro / n as p, n_anti / n as a from d)
select period, party, n, n_pro, n_anti, round(100 * (p - a), 6) as net, round(100 * (p - a - 2 * sqrt(p * (1 - p) / n + a * (1 - a) / n)), 6) as low, round(100 * (p - a + 2 * sqrt(p * (1 - p) / n + a * (1 - a) / n)), 6) as high from s
""")  # fmt: skip
def net_tone_band(t: Tables) -> DataFrame:
    """Net tone by period and party with bands of two standard errors; procedural speeches are out of both sides of the shares."""
    d = dated(t)
    procedural = d.where("o_orderstatus = 'F' and n < 3").select("l_orderkey")
    kept = d.join(procedural, "l_orderkey", "left_anti").withColumn("label", scores.argmax_label({c: F.col(c) for c in scores.TONES}))
    g = kept.groupBy("period", "party").agg(rows().alias("n"), F.count_if(F.col("label") == "pro").alias("n_pro"), F.count_if(F.col("label") == "anti").alias("n_anti"))
    net, low, high = scores.net_band(F.col("n_pro") / F.col("n"), F.col("n_anti") / F.col("n"), F.col("n"))
    return g.select("period", "party", "n", "n_pro", "n_anti", r6(net).alias("net"), r6(low).alias("low"), r6(high).alias("high"))


@query("share_with_band", """
select c_mktsegment, n, round(100 * p, 6) as share, round(100 * (p - 2 * sqrt(p * (1 - p) / n)), 6) as low, round(100 * (p + 2 * sqrt(p * (1 - p) / n)), 6) as high
from (select c_mktsegment, count(*) as n, count(*) filter (where c_acctbal > 3000) / count(*) as p from customer group by 1)
""")  # fmt: skip
def share_with_band(t: Tables) -> DataFrame:
    g = t.customer.groupBy("c_mktsegment").agg(rows().alias("n"), (F.count_if(F.col("c_acctbal") > 3000) / rows()).alias("p"))
    share, low, high = scores.share_band(F.col("p"), F.col("n"))
    return g.select("c_mktsegment", "n", r6(share).alias("share"), r6(low).alias("low"), r6(high).alias("high"))


@query("soft_counts", f"select period, count(*) as n, round(sum(anti / n), 4) as anti, round(sum(pro / n), 4) as pro, round((sum(pro / n) - sum(anti / n)) / count(*), 6) as net from ({_DATED}) group by period")
def soft_counts(t: Tables) -> DataFrame:
    g = dated(t).groupBy("period").agg(rows().alias("n"), F.sum(F.col("anti") / F.col("n")).alias("anti"), F.sum(F.col("pro") / F.col("n")).alias("pro"))
    return g.select("period", "n", F.round("anti", 4).alias("anti"), F.round("pro", 4).alias("pro"), r6((F.col("pro") - F.col("anti")) / F.col("n")).alias("net"))


_YEARS = "select cast(year(o_orderdate) as integer) as year, count(*) as n, count(*) filter (where o_orderstatus = 'F') as pos from orders group by 1"


@query("term_pooling", f"""
with y as ({_YEARS}), p as (select * from (values (1990, 1995, 'x'), (1995, 1997, 'y'), (1997, 2001, 'z')) as v("start", "end", name))
select year, name, cast(case when "start" >= 1997 then n else sum(n) over (partition by "start") end as bigint) as n, cast(case when "start" >= 1997 then pos else sum(pos) over (partition by "start") end as bigint) as pos from y join p on year >= "start" and year < "end"
""")  # fmt: skip
def term_pooling(t: Tables) -> DataFrame:
    y = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(rows().alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("pos"))
    p = t.rows("start int, end int, name string", (1990, 1995, "x"), (1995, 1997, "y"), (1997, 2001, "z"))
    return counts.pool_terms(y, p, "year", "n", "pos", 1997)


@query("mention_frequency", f"""
with w as (select source, lang, unnest({WORDS.format(x='lower(text)')}) as x from documents) select source, round(count(*) filter (where x in ('the', 'la', 'der')) / count(*), 6) as share from w group by source
""")  # fmt: skip
def mention_frequency(t: Tables) -> DataFrame:
    w = words(F.lower("text"))
    g = t.documents.groupBy("source").agg(F.sum(F.size(F.filter(w, lambda x: x.isin("the", "la", "der")))).alias("k"), F.sum(F.size(w)).alias("n"))
    return g.select("source", r6(F.col("k") / F.col("n")).alias("share"))


@query("annotation_tone", """
with g as (select lang, source, count(*) as n, avg(case when quality = 1 then 1.0 else 0 end) as p, avg(case when toxic = 1 then 1.0 else 0 end) as a from labels join documents using (doc_id) group by 1, 2 having count(*) > 4)
select lang, source, n, round(p - a, 6) as net, round(2 * sqrt(p * (1 - p) / n + a * (1 - a) / n), 6) as band from g
""")  # fmt: skip
def annotation_tone(t: Tables) -> DataFrame:
    one = lambda c: F.avg(F.when(F.col(c) == 1, 1.0).otherwise(0.0))
    g = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").groupBy("lang", "source").agg(rows().alias("n"), one("quality").alias("p"), one("toxic").alias("a")).where("n > 4")
    net, low, _ = scores.net_band(F.col("p"), F.col("a"), F.col("n"))
    return g.select("lang", "source", "n", r6(net / 100).alias("net"), r6((net - low) / 100).alias("band"))


# Windows over periods


@query("window_count", "select c_custkey, count(*) over (partition by c_nationkey, c_mktsegment) as weight from customer")
def window_count(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", rows().over(Window.partitionBy("c_nationkey", "c_mktsegment")).alias("weight"))


_DAYS = "select user_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer) as day, count(*) as n, count(*) filter (where event_type = 'purchase') as pos from events group by 1, 2"


def days(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(rows().alias("n"), F.count_if(F.col("event_type") == "purchase").alias("pos"))


@query("gaps_islands", f"""
with v as (select user_id, day from ({_DAYS}) where n >= 2),
m as (select *, coalesce(day - lag(day) over w = 1, false) or coalesce(lead(day) over w - day = 1, false) as near, lag(day) over w is not null and lead(day) over w is not null as inside from v window w as (partition by user_id order by day)),
b as (select *, sum(case when not near and inside then 1 else 0 end) over (partition by user_id order by day) as block from m)
select user_id, day, cast(block as bigint) as block from b where near
""")  # fmt: skip
def gaps_islands(t: Tables) -> DataFrame:
    v = days(t).where("n >= 2").select("user_id", "day")
    return segment.islands(v, ["user_id"], "day").select("user_id", "day", i64(F.col("block")).alias("block"))


@query("sliding_prior", """
with c as (select cast(o_orderkey % 60 as bigint) as period, o_orderstatus as label, count(*) as n from orders group by 1, 2), e as (select period + k - 10 as period, label, n from c, range(21) r(k)), s as (select period, label, sum(n) as n from e group by 1, 2)
select period, label, round(n / sum(n) over (partition by period), 6) as share from s
""")  # fmt: skip
def sliding_prior(t: Tables) -> DataFrame:
    p = counts.sliding_prior(t.orders.select((F.col("o_orderkey") % 60).alias("period"), F.col("o_orderstatus").alias("label")), "period", "label")
    return p.select("period", "label", r6(F.col("share")).alias("share"))


@query("bucket_other", "select name, count(*) as n from (select case when count(*) over (partition by user_id) < 70 then 'other' else cast(user_id as varchar) end as name from events) group by 1")
def bucket_other(t: Tables) -> DataFrame:
    b = counts.bucket_other(t.events.select(F.col("user_id").cast("string").alias("name")), "name", 70)
    return b.groupBy("name").agg(rows().alias("n"))


@query("first_valid_period", f"select user_id, min(day) as first_day from ({_DAYS}) where n >= 3 group by 1")
def first_valid_period(t: Tables) -> DataFrame:
    return days(t).where("n >= 3").groupBy("user_id").agg(F.min("day").alias("first_day"))


@query("lead_gap", f"select * from (select user_id, day, lead(day) over (partition by user_id order by day) as next_day from ({_DAYS})) where next_day - day in (2, 4)")
def lead_gap(t: Tables) -> DataFrame:
    nxt = F.lead("day").over(Window.partitionBy("user_id").orderBy("day"))
    return days(t).select("user_id", "day", nxt.alias("next_day")).where((F.col("next_day") - F.col("day")).isin(2, 4))


@query("leave_one_out", f"""
with d as ({_DAYS}), a as (select day, sum(n) as n, sum(pos) as pos from d group by day) select user_id, d.day, round(case when a.n > d.n then (a.pos - d.pos) / (a.n - d.n) end, 6) as rest from d join a on a.day = d.day
""")  # fmt: skip
def leave_one_out(t: Tables) -> DataFrame:
    return counts.leave_one_out(days(t), "user_id", "day", "n", "pos").select("user_id", "day", r6(F.col("rest")).alias("rest"))


@query("loo_band", "with c as (select source, lang, count(*) as n from documents group by 1, 2), a as (select source, sum(n) as total from c group by 1) select source, cast(max(total) as bigint) as total, cast(min(total - n) as bigint) as low, cast(max(total - n) as bigint) as high from c join a using (source) group by source")
def loo_band(t: Tables) -> DataFrame:
    return counts.loo_band(t.documents.groupBy("source", "lang").agg(rows().alias("n")), "source", "lang", "n")


@query("interpolate_missing", """
with d as (select cast((s_suppkey % 12) * 10 + 1900 as bigint) as decade, round(avg(s_acctbal), 6) as v from supplier group by 1),
m as (select decade, case when decade in (1930, 1970) then null else v end as v from d)
select decade, round(coalesce(v, (lag(v) over (order by decade) + lead(v) over (order by decade)) / 2), 6) as v from m
""")  # fmt: skip
def interpolate_missing(t: Tables) -> DataFrame:
    d = t.supplier.groupBy(((F.col("s_suppkey") % 12) * 10 + 1900).alias("decade")).agg(r6(F.avg("s_acctbal")).alias("v"))
    m = d.withColumn("v", F.when(~F.col("decade").isin(1930, 1970), F.col("v")))
    w = Window.orderBy("decade")  # a row a decade
    return m.select("decade", r6(F.coalesce("v", (F.lag("v").over(w) + F.lead("v").over(w)) / 2)).alias("v"))


# Terms and associations

_CUBE = f"select source, case lang when 'en' then 'D' when 'fr' then 'R' else 'U' end as party, term, count(*) as n from (select source, lang, unnest({WORDS.format(x='lower(text)')}) as term from documents) group by 1, 2, 3"


def cube(t: Tables) -> DataFrame:
    """Counts of terms by source and party: one aggregation serves the analyses after it."""
    party = F.when(F.col("lang") == "en", "D").when(F.col("lang") == "fr", "R").otherwise("U")
    return t.documents.select("source", party.alias("party"), F.explode(words(F.lower("text"))).alias("term")).groupBy("source", "party", "term").agg(rows().alias("n"))


@query("term_cube", f"select source, party, term, n from ({_CUBE}) where party in ('D', 'R') and n >= 5")
def term_cube(t: Tables) -> DataFrame:
    return cube(t).where("party in ('D', 'R') and n >= 5")


@query("period_fold", f"select term, cast(sum(n) as bigint) as n from ({_CUBE}) where source between 'src1' and 'src14' group by term having sum(n) >= 10")
def period_fold(t: Tables) -> DataFrame:
    return cube(t).where("source between 'src1' and 'src14'").groupBy("term").agg(F.sum("n").alias("n")).where("n >= 10")


_FRAMES = {"articles": ["the", "la", "le", "der", "die", "das"], "joins": ["and", "et", "und", "y", "or"], "places": ["in", "on", "at", "dans", "en"]}
_BASE_TERMS = ("the", "of", "en", "de")
_FRAMES_SQL = "(values " + ", ".join(f"('{c}', '{x}')" for c, xs in _FRAMES.items() for x in xs) + ") as f(category, term)"


@query("frame_freq", f"""
with c as (select source, term, sum(n) as n from ({_CUBE}) group by 1, 2), a as (select source, sum(n) as n_all from c group by 1)
select source, category, cast(sum(n) as bigint) as n_frame, round(sum(n) / max(n_all), 6) as share from c join {_FRAMES_SQL} using (term) join a using (source) group by 1, 2
""")  # fmt: skip
def frame_freq(t: Tables) -> DataFrame:
    c = _framed(t).groupBy("source", "term").agg(F.sum("n").alias("n"))
    s = counts.frame_shares(c, terms_table(t.spark, _FRAMES), "source", "term", "n")
    return s.select("source", "category", "n_frame", r6(F.col("share")).alias("share"))


def _framed(t: Tables) -> DataFrame:
    """cube() with all terms outside the frames and the base as one, so that what is shuffled has a few rows a source and party."""
    known = sorted({x for xs in _FRAMES.values() for x in xs} | set(_BASE_TERMS))
    party = F.when(F.col("lang") == "en", "D").when(F.col("lang") == "fr", "R").otherwise("U")
    term = F.when(F.col("term").isin(known), F.col("term")).otherwise("")
    told = t.documents.select("source", party.alias("party"), F.explode(words(F.lower("text"))).alias("term"))
    return told.groupBy("source", "party", term.alias("term")).agg(rows().alias("n"))


_PMI = f"""select source, category, sum(case when party = 'D' then n else 0 end) as nd, sum(case when party <> 'D' then n else 0 end) as nb from ({_CUBE}) join {_FRAMES_SQL} using (term) group by 1, 2"""
_BASE = f"""select source, sum(case when party = 'D' then n else 0 end) as ad, sum(case when party <> 'D' then n else 0 end) as ab, sum(case when party = 'D' and term in ('the', 'of', 'en', 'de') then n else 0 end) as bd,
  sum(case when party <> 'D' and term in ('the', 'of', 'en', 'de') then n else 0 end) as bb from ({_CUBE}) group by 1"""


def _cells(t: Tables) -> DataFrame:
    c = _framed(t)
    d, b = F.col("party") == "D", F.col("term").isin(*_BASE_TERMS)
    add = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
    inside = c.join(F.broadcast(terms_table(t.spark, _FRAMES)), "term").groupBy("source", "category").agg(add(d, "nd"), add(~d, "nb"))
    return inside.join(c.groupBy("source").agg(add(d, "ad"), add(~d, "ab"), add(d & b, "bd"), add(~d & b, "bb")), "source")


@query("scaled_pmi", f"select source, category, round(ln((nd / ad) / (nb / ab)) / ln((bd / ad) / (bb / ab)), 4) as pmi from ({_PMI}) join ({_BASE}) using (source) where nd > 0 and nb > 0 and bd > 0 and bb > 0")
def scaled_pmi(t: Tables) -> DataFrame:
    c = _cells(t).where("nd > 0 and nb > 0 and bd > 0 and bb > 0")
    return counts.scaled_pmi(c, "source", "nd", "nb", "ad", "ab", "bd", "bb").select("source", "category", F.round("pmi", 4).alias("pmi"))


@query("pmi_party_diff", f"""
with c as (select party, category, sum(n) as n from ({_CUBE}) join {_FRAMES_SQL} using (term) where party in ('D', 'R') group by 1, 2), a as (select party, sum(n) as al from ({_CUBE}) where party in ('D', 'R') group by 1)
select category, round(max(case when party = 'R' then ln(n / al) end) - max(case when party = 'D' then ln(n / al) end), 6) as diff from c join a using (party) group by 1
""")  # fmt: skip
def pmi_party_diff(t: Tables) -> DataFrame:
    c = _framed(t).where("party in ('D', 'R')")
    inside = c.join(F.broadcast(terms_table(t.spark, _FRAMES)), "term").groupBy("party", "category").agg(F.sum("n").alias("n"))
    f = inside.join(c.groupBy("party").agg(F.sum("n").alias("al")), "party").withColumn("l", F.ln(F.col("n") / F.col("al")))
    side = lambda p: F.max(F.when(F.col("party") == p, F.col("l")))
    return f.groupBy("category").agg(r6(side("R") - side("D")).alias("diff"))


@query("log_freq_ratio", f"""
with c as (select category, term, sum(case when party = 'D' then n else 0 end) as d, sum(case when party = 'U' then n else 0 end) as u from ({_CUBE}) join {_FRAMES_SQL} using (term) group by 1, 2),
a as (select sum(case when party = 'D' then n else 0 end) as ad, sum(case when party = 'U' then n else 0 end) as au from ({_CUBE})), s as (select category, sum(d) as sd, sum(u) as su from c group by 1),
x as (select category, sd, su, sd - d as rd, su - u as ru, ad, au from c join s using (category) cross join a)
select category, round(max(case when sd > 0 and su > 0 then ln((sd / ad) / (su / au)) end), 6) as ratio, round(min(case when rd > 0 and ru > 0 then ln((rd / ad) / (ru / au)) end), 6) as low, round(max(case when rd > 0 and ru > 0 then ln((rd / ad) / (ru / au)) end), 6) as high from x group by 1
""")  # fmt: skip
def log_freq_ratio(t: Tables) -> DataFrame:
    c = _framed(t)
    add = lambda p, name: F.sum(F.when(F.col("party") == p, F.col("n")).otherwise(0)).alias(name)
    per = c.join(F.broadcast(terms_table(t.spark, _FRAMES)), "term").groupBy("category", "term").agg(add("D", "d"), add("U", "u"))
    whole = per.groupBy("category").agg(F.sum("d").alias("sd"), F.sum("u").alias("su"))
    x = per.join(whole, "category").crossJoin(F.broadcast(c.agg(add("D", "ad"), add("U", "au"))))
    log = lambda a, b: F.when((a > 0) & (b > 0), F.ln((a / F.col("ad")) / (b / F.col("au"))))
    one = log(F.col("sd") - F.col("d"), F.col("su") - F.col("u"))
    return x.groupBy("category").agg(r6(F.max(log(F.col("sd"), F.col("su")))).alias("ratio"), r6(F.min(one)).alias("low"), r6(F.max(one)).alias("high"))


@query("beta_posterior", "with a as (select count(*) filter (where c_acctbal < 0) as p, count(*) as n from customer) select c_nationkey, round(pos + 100.0 * p / a.n, 6) as alpha, round(g.n + 100.0 - (pos + 100.0 * p / a.n), 6) as beta from (select c_nationkey, count(*) as n, count(*) filter (where c_acctbal < 0) as pos from customer group by 1) g cross join a")
def beta_posterior(t: Tables) -> DataFrame:
    g = t.customer.groupBy("c_nationkey").agg(rows().alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("pos"))
    a = t.customer.agg(F.count_if(F.col("c_acctbal") < 0).alias("p"), rows().alias("all_n"))
    alpha, beta = scores.beta_parameters(F.col("pos"), F.col("n"), F.col("p"), F.col("all_n"))
    return g.crossJoin(F.broadcast(a)).select("c_nationkey", r6(alpha).alias("alpha"), r6(beta).alias("beta"))


@query("beta_interval")
def beta_interval(t: Tables) -> DataFrame:
    return stats.beta_interval(beta_posterior(t), ["c_nationkey"], "alpha", "beta", 100_000)


@query("log_mean_exp", "select l_returnflag, round(ln(avg(exp(l_discount)) / avg(exp(l_tax))), 6) as v from lineitem group by 1")
def log_mean_exp(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(r6(F.ln(F.avg(F.exp("l_discount")) / F.avg(F.exp("l_tax")))).alias("v"))


_M = CONFUSION[("modern", "modern", "na")]
_COR = ", ".join(
    "round(" + " + ".join(f"{p} * {_M[i][k]} * pr{i} / (" + " + ".join(f"{_M[j][k]} * pr{j}" for j in range(3)) + ")" for k, p in enumerate(scores.TONES)) + f", 6) as {scores.TONES[i]}" for i in range(3)
)


@query("cfm_correct", f"select l_orderkey, l_linenumber, {_COR} from (select *, 0.2 + 0.01 * (l_orderkey % 10) as pr0, 0.5 as pr1, 0.3 - 0.01 * (l_orderkey % 10) as pr2 from ({_PROBS}))")
def cfm_correct(t: Tables) -> DataFrame:
    k = F.col("l_orderkey") % 10
    fixed = scores.confusion_corrected([F.col(c) for c in scores.TONES], [0.2 + 0.01 * k, F.lit(0.5), 0.3 - 0.01 * k], _M)
    return segments(t).select("l_orderkey", "l_linenumber", *[r6(x).alias(c) for c, x in zip(scores.TONES, fixed, strict=True)])


@query("unpivot_max", """
with w as (select s_nationkey as k, sum(s_suppkey % 5) as y1900, sum(s_suppkey % 7) as y1910, sum(s_suppkey % 3) as y1920 from supplier group by 1), l as (unpivot w on y1900, y1910, y1920 into name year value v)
select k, year, cast(v as bigint) as v from l qualify row_number() over (partition by k order by v desc, year) = 1
""")  # fmt: skip
def unpivot_max(t: Tables) -> DataFrame:
    w = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(*[F.sum(F.col("s_suppkey") % m).alias(y) for y, m in (("y1900", 5), ("y1910", 7), ("y1920", 3))])
    long = w.unpivot("k", ["y1900", "y1910", "y1920"], "year", "v")
    r = F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc(), "year"))
    return long.withColumn("r", r).where("r = 1").select("k", "year", "v")


@query("zscore", "select c_custkey, round((c_acctbal - avg(c_acctbal) over (partition by c_mktsegment)) / stddev_samp(c_acctbal) over (partition by c_mktsegment), 6) as z, round(ln(abs(c_acctbal) + 1), 6) as log_bal from customer")
def zscore(t: Tables) -> DataFrame:
    z = stats.zscore(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal")
    return z.select("c_custkey", r6(F.col("z")).alias("z"), r6(F.log1p(F.abs("c_acctbal"))).alias("log_bal"))


@query("ci_bounds", "select c_mktsegment, round(avg(c_acctbal) - 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 4) as low, round(avg(c_acctbal) + 1.96 * stddev_samp(c_acctbal) / sqrt(count(*)), 4) as high from customer group by 1")
def ci_bounds(t: Tables) -> DataFrame:
    m, se = F.avg("c_acctbal"), F.stddev_samp("c_acctbal") / F.sqrt(rows())
    return t.customer.groupBy("c_mktsegment").agg(F.round(m - 1.96 * se, 4).alias("low"), F.round(m + 1.96 * se, 4).alias("high"))


@query("log_grid", "select cast(i as bigint) as i, round(lo * pow(hi / lo, i / 9.0), 4) as alpha from (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) cross join range(10) r(i)")
def log_grid(t: Tables) -> DataFrame:
    """Ten steps, equal in the logarithm, from the least to the largest price."""
    ends = t.orders.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    step = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")
    return ends.select("lo", "hi", step).select(i64(F.col("i")).alias("i"), F.round(F.col("lo") * F.pow(F.col("hi") / F.col("lo"), F.col("i") / 9), 4).alias("alpha"))


@query("sample_weights", """
with c as (select quality, count(*) as n from labels group by 1), s as (select *, row_number() over (partition by quality order by md5(concat_ws('|', doc_id, '1')), doc_id) as rn from labels)
select doc_id, cast(rn <= 0.8 * n as bigint) as train, round(case when rn <= 0.8 * n then 1.0 else n / 200.0 end, 6) as weight from s join c using (quality)
""")  # fmt: skip
def sample_weights(t: Tables) -> DataFrame:
    s = labels.ranked(t.labels, "doc_id", 1, ["quality"]).join(t.labels.groupBy("quality").agg(rows().alias("n")), "quality")
    train = F.col("rn") <= 0.8 * F.col("n")
    return s.select("doc_id", i64(train.cast("int")).alias("train"), r6(F.when(train, 1.0).otherwise(F.col("n") / 200)).alias("weight"))


@query("weighted_order", "select c_nationkey, round((avg(c_acctbal) filter (where c_custkey % 2 = 0) * count(*) filter (where c_custkey % 2 = 0) + avg(c_acctbal) filter (where c_custkey % 2 = 1) * count(*) filter (where c_custkey % 2 = 1)) / count(*), 4) as m from customer group by 1 order by 2 desc limit 15")
def weighted_order(t: Tables) -> DataFrame:
    even = F.col("c_custkey") % 2 == 0
    part = lambda c: F.avg(F.when(c, F.col("c_acctbal"))) * F.count_if(c)
    return t.customer.groupBy("c_nationkey").agg(F.round((part(even) + part(~even)) / rows(), 4).alias("m")).orderBy(F.col("m").desc()).limit(15)


# Agreement and evaluation

_RATED = "select item, worker, response from (select event_id, cast(event_id // 4 as bigint) as item, user_id % 5 as worker, event_type as response from events) qualify row_number() over (partition by item, worker order by event_id desc) = 1"


@query("krippendorff_alpha", f"""
with r as ({_RATED}), c as (select item, response, count(*) as c from r group by 1, 2), i as (select item, sum(c) as n, sum(c * c) as q from c group by 1 having sum(c) > 1),
o as (select sum((n * n - q) / 2.0 / (n - 1)) as d, sum(n) as n from i), g as (select response, sum(c) as c from c join i using (item) group by 1), e as (select (sum(c) * sum(c) - sum(c * c)) / 2.0 / (sum(c) * (sum(c) - 1)) as de from g)
select round(1 - d / n / de, 6) as alpha from o cross join e
""")  # fmt: skip
def krippendorff_alpha(t: Tables) -> DataFrame:
    r = t.events.select("event_id", F.floor(F.col("event_id") / 4).alias("item"), (F.col("user_id") % 5).alias("worker"), F.col("event_type").alias("response"))
    return labels.krippendorff_alpha(r, "item", "worker", "response", "event_id").select(r6(F.col("alpha")).alias("alpha"))


_EVAL = "select doc_id, quality as y, cast(case when (doc_id * 7919) % 100 < 85 then quality else 1 - quality end as integer) as y_hat, ((doc_id * 7919) % 1000) / 1000.0 as p, 1.0 + doc_id % 3 as w from labels"


def judged(t: Tables) -> DataFrame:
    h = F.col("doc_id") * 7919
    guess = F.when(h % 100 < 85, F.col("quality")).otherwise(1 - F.col("quality")).cast("int")
    return t.labels.select("doc_id", F.col("quality").alias("y"), guess.alias("y_hat"), ((h % 1000) / 1000).alias("p"), (1.0 + F.col("doc_id") % 3).alias("w"))


@query("confusion_matrix", f"select y, count(*) filter (where y_hat = 0) as to_0, count(*) filter (where y_hat = 1) as to_1, round(count(*) filter (where y_hat = y) / count(*), 6) as recall from ({_EVAL}) group by y")
def confusion_matrix(t: Tables) -> DataFrame:
    return judged(t).groupBy("y").agg(F.count_if(F.col("y_hat") == 0).alias("to_0"), F.count_if(F.col("y_hat") == 1).alias("to_1"), r6(F.count_if(F.col("y_hat") == F.col("y")) / rows()).alias("recall"))


@query("accuracy", f"select round(avg(case when y = y_hat then 1.0 else 0 end), 6) as accuracy, round(sum(case when y = y_hat then w else 0 end) / sum(w), 6) as weighted, round(abs(sum(w * y) / sum(w) - sum(w * y_hat) / sum(w)), 6) as mae from ({_EVAL})")
def accuracy(t: Tables) -> DataFrame:
    hit, w = F.col("y") == F.col("y_hat"), F.sum("w")
    return judged(t).agg(
        r6(F.avg(F.when(hit, 1.0).otherwise(0.0))).alias("accuracy"), r6(F.sum(F.when(hit, F.col("w")).otherwise(0.0)) / w).alias("weighted"),
        r6(F.abs(F.sum(F.col("w") * F.col("y")) / w - F.sum(F.col("w") * F.col("y_hat")) / w)).alias("mae"),
    )


@query("f1_by_class", f"""
with d as ({_EVAL}), k as (select unnest([0, 1]) as label) select label, round(2 * sum(case when y = label and y_hat = label then w else 0 end) / (sum(case when y = label then w else 0 end) + sum(case when y_hat = label then w else 0 end)), 6) as f1 from d cross join k group by label
""")  # fmt: skip
def f1_by_class(t: Tables) -> DataFrame:
    return labels.f1_by_class(judged(t), "y", "y_hat", "w").select("label", r6(F.col("f1")).alias("f1"))


@query("f1_scores", f"""
with d as ({_EVAL}), k as (select unnest([0, 1]) as label),
c as (select label, sum(case when y = label and y_hat = label then w else 0 end) as tp, sum(case when y = label then w else 0 end) as t, sum(case when y_hat = label then w else 0 end) as p from d cross join k group by label)
select round(max(case when label = 1 then 2 * tp / (t + p) end), 6) as "binary", round(sum(tp) / sum(t), 6) as micro, round(avg(2 * tp / (t + p)), 6) as macro, round(sum(t * 2 * tp / (t + p)) / sum(t), 6) as weighted from c
""")  # fmt: skip
def f1_scores(t: Tables) -> DataFrame:
    return labels.f1_scores(judged(t), "y", "y_hat", "w").select(*[r6(F.col(c)).alias(c) for c in ("binary", "micro", "macro", "weighted")])


@query("calibration", f"""
with d as (select *, floor((row_number() over (order by p, doc_id) - 1) * 8 / count(*) over ()) as bin from ({_EVAL})) select cast(bin as bigint) as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as share from d group by 1
""")  # fmt: skip
def calibration(t: Tables) -> DataFrame:
    return calibration_curve(judged(t), "y", "p", 8, "doc_id").select("bin", "n", r6(F.col("mean_p")).alias("mean_p"), r6(F.col("share")).alias("share"))


@query("brier_and_correlation", f"""
with d as ({_EVAL}), r as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rp, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from d),
m as (select sum(case when y = 1 and y_hat = 1 then 1 else 0 end)::double as tp, sum(case when y = 0 and y_hat = 0 then 1 else 0 end)::double as tn, sum(case when y = 0 and y_hat = 1 then 1 else 0 end)::double as fp, sum(case when y = 1 and y_hat = 0 then 1 else 0 end)::double as fn from d)
select round(avg((p - y) * (p - y)), 6) as brier, round(corr(p, y), 6) as pearson, round(corr(rp, ry), 6) as spearman, round(max((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), 6) as mcc from r cross join m
""")  # fmt: skip
def brier_and_correlation(t: Tables) -> DataFrame:
    d = judged(t)
    r = stats.average_ranks(stats.average_ranks(d, "p", "rp"), "y", "ry")
    cell = lambda a, b: F.count_if((F.col("y") == a) & (F.col("y_hat") == b)).cast("double")
    tp, tn, fp, fn = cell(1, 1), cell(0, 0), cell(0, 1), cell(1, 0)
    y = F.col("y").cast("double")
    return r.agg(
        r6(F.avg((F.col("p") - y) * (F.col("p") - y))).alias("brier"), r6(F.corr(F.col("p"), y)).alias("pearson"), r6(F.corr("rp", "ry")).alias("spearman"),
        r6((tp * tn - fp * fn) / F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


# Regressions


@query("regr_by_group", "select c_mktsegment, count(*) as n, round(regr_slope(c_acctbal, c_nationkey), 4) as slope, round(regr_intercept(c_acctbal, c_nationkey), 4) as intercept from customer group by 1")
def regr_by_group(t: Tables) -> DataFrame:
    s = stats.slope_by(t.customer, ["c_mktsegment"], "c_acctbal", "c_nationkey")
    return s.select("c_mktsegment", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("fe_slope", """
with m as (select *, sum(l_extendedprice * l_quantity) over w / sum(l_quantity) over w as my, sum(l_discount * l_quantity) over w / sum(l_quantity) over w as mx from lineitem window w as (partition by l_returnflag))
select round(sum(l_quantity * (l_discount - mx) * (l_extendedprice - my)) / sum(l_quantity * (l_discount - mx) * (l_discount - mx)), 3) as slope, count(*) as n from m
""")  # fmt: skip
def fe_slope(t: Tables) -> DataFrame:
    return stats.within_slope(t.lineitem, "l_returnflag", "l_extendedprice", "l_discount", "l_quantity").select(F.round("slope", 3).alias("slope"), "n")


@query("fe_robust", """
with m as (select *, sum(l_extendedprice * l_quantity) over w / sum(l_quantity) over w as my, sum(l_discount * l_quantity) over w / sum(l_quantity) over w as mx from lineitem window w as (partition by l_returnflag)),
d as (select l_quantity::double as w, l_discount - mx as x, l_extendedprice - my as y from m), b as (select sum(w * x * y) / sum(w * x * x) as b, sum(w * x * x) as xx, count(*) as n from d), g as (select count(distinct l_returnflag) as g from lineitem),
r as (select sqrt(sum(w * w * x * x * (y - b * x) * (y - b * x)) * max(n) / (max(n) - max(g) - 1)) / max(xx) as se, max(b) as b from d cross join b cross join g)
select round(se, 2) as robust_se, round(b / se, 4) as t from r
""")  # fmt: skip
def fe_robust(t: Tables) -> DataFrame:
    return stats.within_slope(t.lineitem, "l_returnflag", "l_extendedprice", "l_discount", "l_quantity").select(F.round("robust_se", 2).alias("robust_se"), F.round("t", 4).alias("t"))


@query("election_features", """
select cast(year(o_orderdate) as integer) as year, cast(year(o_orderdate) % 2 as integer) as odd, cast(case when year(o_orderdate) >= 1995 then 1 else 0 end as integer) as late, count(*) as n, round(avg(o_totalprice), 3) as price from orders group by 1, 2, 3 having count(*) >= 10
""")  # fmt: skip
def election_features(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    return t.orders.groupBy(y.alias("year"), (y % 2).alias("odd"), F.when(y >= 1995, 1).otherwise(0).alias("late")).agg(rows().alias("n"), F.round(F.avg("o_totalprice"), 3).alias("price")).where("n >= 10")


@query("posterior_summary", "select label, round(avg(embedding[1]), 5) as m, round(stddev_pop(embedding[1]), 5) as s, round(avg(embedding[1] - embedding[2]), 5) as d from embeddings group by 1")
def posterior_summary(t: Tables) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return t.embeddings.groupBy("label").agg(F.round(F.avg(e(0)), 5).alias("m"), F.round(F.stddev_pop(e(0)), 5).alias("s"), F.round(F.avg(e(0) - e(1)), 5).alias("d"))


@query("cosine_top_k", """
with q as (select vec_id as query, embedding as qv from embeddings where vec_id % 20 = 0), s as (select query, vec_id, list_cosine_similarity(embedding::double[], qv::double[]) as sim from embeddings join q on vec_id <> query)
select query, vec_id, rank from (select query, vec_id, row_number() over (partition by query order by sim desc, vec_id) as rank from s) where rank <= 10
""")  # fmt: skip
def cosine_top_k(t: Tables) -> DataFrame:
    """The ten nearest vectors of every twentieth one, in blocks."""
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))
    return models.cosine_top_k(t.embeddings, q, "vec_id", "embedding", 10, QUERY_BLOCK).select("query", "vec_id", i64(F.col("rank")).alias("rank"))


@query("linear_shap", """
with f as (select p_partkey as key, unnest(list_distinct(string_split(p_name, ' '))) as term from part), n as (select count(distinct key) as n from f), m as (select term, count(*) / max(n) as mx from f cross join n group by 1)
select key, term, round((length(term) - 4) * (1 - mx), 6) as shap from f join m using (term)
""")  # fmt: skip
def linear_shap(t: Tables) -> DataFrame:
    f = t.part.select(F.col("p_partkey").alias("key"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("term"), F.lit(1.0).alias("x"))
    w = f.select("term").distinct().withColumn("weight", (F.length("term") - 4).cast("double"))
    return models.linear_shap(f, w).select("key", "term", r6(F.col("shap")).alias("shap"))


@query("logistic_by_group")
def logistic_by_group(t: Tables) -> DataFrame:
    d = t.customer.select("c_mktsegment", (F.col("c_acctbal") > 4000).cast("int").alias("y"), (F.col("c_nationkey") / 25).alias("x"))
    return stats.logistic_by(d, "c_mktsegment", "y", ["x"])


@query("binomial_interaction")
def binomial_interaction(t: Tables) -> DataFrame:
    d = t.customer.select((F.col("c_acctbal") > 4000).cast("double").alias("y"), (F.col("c_nationkey") / 25).alias("x"), F.col("c_mktsegment").alias("g"))
    names, model = models.binomial(d, "y ~ x + g + x:g")
    return t.spark.createDataFrame([(n, float(c)) for n, c in zip(names, model.coefficients, strict=True)], "term string, estimate double")


@query("ngram_classifier")
def ngram_classifier(t: Tables) -> DataFrame:
    d = t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), words(F.lower("text")).alias("w"))
    features, model = models.ngram_classifier(d.where("doc_id % 5 <> 0"), "w", "label")
    return model.transform(features.transform(d)).select("doc_id", "label", "prediction")


@query("nms_prune", """
with recursive s as (select l_orderkey, l_partkey % 30 as num, max(l_discount) as p from lineitem where l_discount >= 0.05 group by 1, 2), r as (select *, row_number() over (partition by l_orderkey order by p desc, num desc) as i from s),
k as (select l_orderkey, i, [num] as kept, num, true as keep from r where i = 1
 union all select r.l_orderkey, r.i, case when len(list_filter(k.kept, lambda x: abs(x - r.num) <= 5)) > 0 then k.kept else list_append(k.kept, r.num) end, r.num, len(list_filter(k.kept, lambda x: abs(x - r.num) <= 5)) = 0 from k join r on r.l_orderkey = k.l_orderkey and r.i = k.i + 1)
select l_orderkey, num from k where keep
""")  # fmt: skip
def nms_prune(t: Tables) -> DataFrame:
    s = t.lineitem.where("l_discount >= 0.05").groupBy("l_orderkey", (F.col("l_partkey") % 30).alias("num")).agg(F.max("l_discount").alias("p"))
    kept = s.groupBy("l_orderkey").agg(segment.suppress(F.collect_list(F.struct("p", "num"))).alias("k"))
    return kept.select("l_orderkey", F.explode("k").alias("k")).select("l_orderkey", "k.num")


@query("fact_table", f"""
select l_orderkey || '_' || lpad(cast(l_linenumber as varchar), 3, '0') as segment_id, cast(l_orderkey as varchar) as speech_id, cast(o_orderdate as date) as date, c_mktsegment as party, n_name as state, r_name as region,
  round(anti, 6) as anti, round(neutral, 6) as neutral, round(pro, 6) as pro from ({_PROBS}) join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where o_totalprice > 150000
""")  # fmt: skip
def fact_table(t: Tables) -> DataFrame:
    """Segments with scores and metadata: the wide table that analyses start from."""
    o = t.orders.where("o_totalprice > 150000").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.to_date("o_orderdate").alias("date"))
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("region"))
    c = t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("party"), "state", "region")
    s = segments(t).join(o, "l_orderkey").join(c, "o_custkey")
    sid = F.concat_ws("_", "l_orderkey", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"))
    return s.select(sid.alias("segment_id"), F.col("l_orderkey").cast("string").alias("speech_id"), "date", "party", "state", "region", *[r6(F.col(k)).alias(k) for k in scores.TONES])


@query("ols_interaction")
def ols_interaction(t: Tables) -> DataFrame:
    d = t.orders.select((F.col("o_totalprice") / 1000).alias("y"), (F.year("o_orderdate") - 1992).cast("double").alias("x"), F.col("o_orderstatus").alias("g"))
    names, model = models.least_squares(d, "y ~ x + g + x:g")
    return t.spark.createDataFrame([(n, float(c)) for n, c in zip(names, model.coefficients, strict=True)], "term string, estimate double")


@query("query_expansion")
def query_expansion(t: Tables) -> DataFrame:
    """The words nearest to the five most frequent ones, in texts of all languages."""
    w = t.documents.select(words(F.lower("text")).alias("w"))
    counts = w.select(F.explode("w").alias("term")).groupBy("term").agg(rows().alias("n"))
    terms = [r["term"] for r in counts.orderBy(F.desc("n"), "term").limit(5).collect()]
    return models.expand_query(w, "w", terms, k=10, size=50)
