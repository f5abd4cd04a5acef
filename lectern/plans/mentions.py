"""Queries of sentences that mention groups of people, by whole dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import dates
from lectern.functions.phrases import american, compared_groups, fuse_mentions, hyphenable, mention_terms
from lectern.functions.text import keyword_match
from lectern.operators import counts, mentions
from lectern.plans.registry import Tables, i64, query, r6
from lectern.vocab import AFTER_GROUP, EARLY, MID, MODERN, NATIONALITIES, SPLIT_PHRASES, Keywords, terms_table
from lectern.vocab import GROUPS as PEOPLE


def sql_pick(words, key: str) -> str:
    return f"list_extract([{', '.join(f"'{w}'" for w in words)}], {key} % {len(words)} + 1)"


# Sentences about groups, from the table's own numbers: a group, plain or american, with a space or without, and a term after it, or any words of the part's name.
_SAID = f"""select l_orderkey, l_linenumber, l_partkey, 'The ' || {sql_pick(list(PEOPLE), 'l_partkey')} || case l_linenumber % 4 when 0 then ' American ' when 1 then ' american-born ' else ' ' end
  || {sql_pick(AFTER_GROUP, 'l_suppkey')} || case l_linenumber % 3 when 0 then ' and displaced persons near ' when 1 then ' of latin american people by ' else ' in ' end || p_name as said from lineitem join part on p_partkey = l_partkey"""
_FIRSTS = "|".join(sorted([*PEOPLE, *[g + "american" for g in american(PEOPLE)]], key=lambda g: (-len(g), g)))
_JOINED = f"""select *, regexp_replace(regexp_replace({reduce(lambda x, p: f"replace({x}, '{p}', '{p.replace(' ', '')}')", SPLIT_PHRASES, 'lower(said)')},
  '({"|".join(sorted(american(PEOPLE), key=lambda g: (-len(g), g)))}) (american)', '\\1\\2', 'g'), '({_FIRSTS}) ({"|".join(sorted(AFTER_GROUP, key=lambda g: (-len(g), g)))})', '\\1\\2', 'g') as fused from ({_SAID})"""


def said(t: Tables) -> DataFrame:
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (F.col(k) % len(words) + 1).cast("int"))
    kind, end = F.col("l_linenumber") % 4, F.col("l_linenumber") % 3
    middle = F.when(kind == 0, " American ").when(kind == 1, " american-born ").otherwise(" ")
    last = F.when(end == 0, " and displaced persons near ").when(end == 1, " of latin american people by ").otherwise(" in ")
    rows = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("The "), pick(list(PEOPLE), "l_partkey"), middle, pick(AFTER_GROUP, "l_suppkey"), last, F.col("p_name")).alias("said"))


@query("mention_fuse", f"select l_orderkey, l_linenumber, l_partkey, md5(fused) as fused_md5 from ({_JOINED})")
def mention_fuse(t: Tables) -> DataFrame:
    """Three passes over whole dictionaries: 166 firsts times 113 seconds in the last."""
    return said(t).select("l_orderkey", "l_linenumber", "l_partkey", F.md5(fuse_mentions(F.lower("said"))).alias("fused_md5"))


@query("mention_terms", f"""
with s as (select *, list_filter(string_split(fused, ' '), lambda w: w <> '') as w from ({_JOINED})), t as (select unnest(list_distinct(w)) as term from s where len(w) >= 4)
select term, count(*) as n from t where term in ({", ".join(f"'{x}'" for x in mention_terms()[0])}) or regexp_full_match(term, '({_FIRSTS})({"|".join(AFTER_GROUP)})') group by 1
""")  # fmt: skip
def mention_term_counts(t: Tables) -> DataFrame:
    """Equal sentences are worked off once."""
    each = said(t).groupBy("said").agg(F.count(F.lit(1)).alias("times"))
    return mentions.mention_counts(mentions.mention_sentences(each.withColumn("tokens", F.split("said", " ")), "tokens"), "times")


_NATIONAL = "|".join(sorted({h for c in NATIONALITIES for h in hyphenable(c)}, key=lambda h: (-len(h), h)))
_GROUPED = f"""select *, {", ".join(f"list_has_any(w, [{', '.join(f"'{x}'" for x in terms)}]) as {name.lower()}" for name, terms in compared_groups().items())}
  from (select l_orderkey, l_linenumber, l_partkey, list_filter(string_split(regexp_replace(lower(said), '({_NATIONAL})[ -](american)', '\\1\\2', 'g'), ' '), lambda x: x <> '') as w from ({_SAID}))"""


def grouped(t: Tables) -> DataFrame:
    return mentions.with_groups(said(t).withColumn("tokens", F.split("said", " ")), "tokens")


@query("group_mentions", " union all ".join(f"select '{name}' as \"group\", count(*) as n, cast(sum(l_orderkey) as bigint) as keys from ({_GROUPED}) where {name.lower()}" for name in compared_groups()))
def group_mentions(t: Tables) -> DataFrame:
    """Sentences by group, in which a sentence may count for several."""
    each = grouped(t).select("l_orderkey", F.explode("groups").alias("group"))
    return each.groupBy("group").agg(F.count(F.lit(1)).alias("n"), i64(F.sum("l_orderkey")).alias("keys"))


#: Some of the words after a group, as frames.
_LIVES = {"family": ["family", "families", "husband", "wife", "children", "parents", "mother", "fathers"], "labor": ["worker", "workers", "laborer", "laborers", "farmworkers", "workmen"], "crowd": ["horde", "hordes", "population", "people"]}
_LIVES_SQL = "(values " + ", ".join(f"('{c}', '{x}')" for c, xs in _LIVES.items() for x in xs) + ") as f(category, term)"


@query("group_log_ratio", f"""
with g as ({_GROUPED}), s as (select hispanic, european, unnest(w) as term from g where hispanic or european), a as (select count(*) filter (where hispanic) as ah, count(*) filter (where european) as ae from s),
c as (select category, term, count(*) filter (where hispanic) as h, count(*) filter (where european) as e from s join {_LIVES_SQL} using (term) group by 1, 2), z as (select category, sum(h) as sh, sum(e) as se from c group by 1),
x as (select category, ln((sh / ah) / (se / ae)) as ratio, case when sh > h and se > e then ln(((sh - h) / ah) / ((se - e) / ae)) end as held from c join z using (category) cross join a)
select category, round(max(ratio), 6) as ratio, round(min(held), 6) as low, round(max(held), 6) as high from x group by 1
""")  # fmt: skip
def group_log_ratio(t: Tables) -> DataFrame:
    """How much more often frames stand in sentences on Hispanic than on European people, with the range when a term is left out."""
    words = grouped(t).select("groups", F.explode("words").alias("term"))
    side = lambda name: F.array_contains("groups", name)
    n = words.groupBy("term").agg(F.count_if(side("Hispanic")).alias("h"), F.count_if(side("European")).alias("e"))
    totals = n.agg(F.sum("h").alias("ah"), F.sum("e").alias("ae"))
    cells = n.join(F.broadcast(terms_table(t.spark, _LIVES)), "term").crossJoin(F.broadcast(totals))
    band = counts.log_ratio_band(cells, "category", "h", "e", "ah", "ae")
    return band.select("category", *[r6(F.col(c)).alias(c) for c in ("ratio", "low", "high")])


def _sql_matched(k: Keywords, w: str = "w") -> str:
    """Whether the tokens w hold one of an era's keywords, dictionary by dictionary."""
    some = lambda words: ", ".join(f"'{x}'" for x in sorted(words))
    ways = [f"contains(array_to_string({w}, ' '), 'immig')"]
    if k.unigrams:
        ways.append(f"list_has_any({w}, [{some(k.unigrams)}])")
    if k.bigrams:
        ways.append(f"list_has_any(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]), [{some(k.bigrams)}])")
    for n, prefixes in k.prefixes.items():
        blocked = f" and x[1:7] not in ({some(k.exclude)})" if n <= 7 and k.exclude else ""
        ways.append(f"len(list_filter({w}, lambda x: x[1:{n}] in ({some(prefixes)}){blocked})) > 0")
    return "(" + " or ".join(ways) + ")"


_ERAS = {"early": EARLY, "mid": MID, "modern": MODERN}


@query("era_keywords", f"select {', '.join(f'count(*) filter (where {_sql_matched(k)}) as {name}' for name, k in _ERAS.items())}, count(*) as n from (select list_filter(string_split(lower(said), ' '), lambda x: x <> '') as w from ({_SAID}))")
def era_keywords(t: Tables) -> DataFrame:
    """How many sentences the whole keyword dictionaries of three eras select."""
    w = said(t).select(F.filter(F.split(F.lower("said"), " "), lambda x: x != "").alias("w"))
    return w.agg(*[F.count_if(keyword_match(F.col("w"), k)).alias(name) for name, k in _ERAS.items()], F.count(F.lit(1)).alias("n"))


@query("session_terms", """
with c as (select l_returnflag as party, cast(floor((year(d) - 1873) / 2.0) + 43 - case when year(d) % 2 = 1 and d < make_date(cast(year(d) as integer), 1, 3) then 1 else 0 end as integer) as session, unnest(string_split(p_name, ' ')) as term
  from (select l_returnflag, p_name, cast(l_shipdate as date) as d from lineitem join part on p_partkey = l_partkey))
select party, case when session between 103 and 104 then 'early' when session >= 106 then 'modern' end as period, term, count(*) as n from c where session between 103 and 104 or session >= 106 group by 1, 2, 3
""")  # fmt: skip
def session_terms(t: Tables) -> DataFrame:
    """Terms by party, folded over an early and a modern range of sessions."""
    rows = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    session = dates.date_to_session(F.to_date("l_shipdate"))
    cells = rows.groupBy(F.col("l_returnflag").alias("party"), session.alias("session"), "p_name").agg(F.count(F.lit(1)).alias("n"))
    period = F.when(F.col("session").between(103, 104), "early").when(F.col("session") >= 106, "modern")
    some = cells.select("party", period.alias("period"), "n", F.explode(F.split("p_name", " ")).alias("term")).where("period is not null")
    return some.groupBy("party", "period", "term").agg(i64(F.sum("n")).alias("n"))
