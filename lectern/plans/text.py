"""Queries on texts: cleaning, segments, keywords, features. Documents stand for speeches, their lines for sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import joins, labels, segment
from lectern.plans.registry import Tables, i64, query, r6
from lectern.sources.readers import explode_pages
from lectern.vocab import METAPHORS, Keywords, terms_table

#: Words of the synthetic texts, in the place of the keyword dictionaries.
DEMO = Keywords(
    unigrams=frozenset({"disgusting", "trash"}),
    bigrams=frozenset({"of the", "the in"}),
    prefixes={4: ("stup", "idio"), 5: ("pathe", "thing"), 9: ("thingatio", "ertionent")},
    exclude=("thingth", "thinger"),
)
DEMO_TERMS = {"place": ["the", "in", "on", "at"], "link": ["and", "or", "that", "und", "et", "y"], "insult": ["idiot", "stupid", "trash", "scum", "clown"]}
GROUPS = {"group_a": ["the", "of"], "group_b": ["la", "de", "le"], "group_c": ["der", "die", "und"]}
STOP = ["the", "of", "and", "la", "de", "der", "die"]

#: The pieces that the SQL texts share.
WORDS = r"list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')"
LINES = "select doc_id, unnest(range(len(l))) as pos, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)"


def lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def tokens_of(column: str = "text"):
    return T.words(F.lower(column))


@query("simplify_text", r"""
select doc_id, md5(s) as simplified_md5, cast(length(s) as bigint) as n_chars from (
  select doc_id, regexp_replace(lower(regexp_replace(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g'), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') as s from documents)
""")  # fmt: skip
def simplify_text(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", T.simplify_text(F.col("text")).alias("s"))
    return s.select("doc_id", F.md5("s").alias("simplified_md5"), i64(F.length("s")).alias("n_chars"))


@query("normalize_text", r"""
select conv_id, turn, md5(s) as normal_md5, cast(length(s) as bigint) as n_chars from (
  select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    text || ' it''s o''clock, O''Neil the boys'' so-called a-b-c 1-2', '''(s|m|d|t|ll|re|ve)', '\1', 'g'), 's''\s', 's ', 'g'), 'o''([a-z])', 'o\1', 'g'),
    'O''([A-Z])', 'O\1', 'g'), '([a-zA-Z0-9])-([a-zA-Z0-9])', '\1\2', 'g'), '([a-zA-Z0-9])-([a-zA-Z0-9])', '\1\2', 'g') as s from conversations)
""")  # fmt: skip
def normalize_text(t: Tables) -> DataFrame:
    said = F.concat("text", F.lit(" it's o'clock, O'Neil the boys' so-called a-b-c 1-2"))
    s = t.conversations.select("conv_id", "turn", T.normalize_text(said).alias("s"))
    return s.select("conv_id", "turn", F.md5("s").alias("normal_md5"), i64(F.length("s")).alias("n_chars"))


@query("token_count", f"select doc_id, cast(len({WORDS.format(x='text')}) as bigint) as n_tokens from documents")
def token_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query("strip_prefix", r"""
select conv_id, turn, case when starts_with(s, role) then regexp_replace(substr(s, length(role) + 2), '^\s+|\s+$', '', 'g') end as said
from (select conv_id, turn, role, case when turn % 3 = 2 then text else role || ':  ' || text end as s from conversations)
""")  # fmt: skip
def strip_prefix(t: Tables) -> DataFrame:
    s = F.when(F.col("turn") % 3 == 2, F.col("text")).otherwise(F.concat("role", F.lit(":  "), "text"))
    return t.conversations.select("conv_id", "turn", T.strip_prefix(s, F.col("role")).alias("said"))


@query("comma_to_period", f"""
select doc_id, cast(len(w) as bigint) as n_tokens, md5(array_to_string(list_transform(w, lambda x: replace(x, ',', '.')), ' ')) as tokens_md5
from (select doc_id, {WORDS.format(x='text')} as w from documents)
""")  # fmt: skip
def comma_to_period(t: Tables) -> DataFrame:
    w = T.words(F.col("text"))
    return t.documents.select("doc_id", i64(F.size(w)).alias("n_tokens"), F.md5(F.array_join(T.comma_to_period(w), " ")).alias("tokens_md5"))


@query("zero_pad_id", """
select doc_id, case when length(d) >= 3 then d else lpad(d, 3, '0') end as id3, case when length(d) >= 8 then d else lpad(d, 8, '0') end as id8
from (select doc_id, cast(doc_id as varchar) as d from documents)
""")  # fmt: skip
def zero_pad_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.zero_pad(F.col("doc_id"), 3).alias("id3"), T.zero_pad(F.col("doc_id"), 8).alias("id8"))


@query("id_to_period", """
select o_orderkey, try_cast(case when starts_with(k, '1') then substr(k, 1, 3) else substr(k, 1, 2) end as integer) as session, regexp_replace(k || '_x_7', '_[^_]*$', '') as speech
from (select o_orderkey, case when o_orderkey % 11 = 0 then 'C' || o_orderkey else cast(o_orderkey as varchar) end as k from orders)
""")  # fmt: skip
def id_to_period(t: Tables) -> DataFrame:
    k = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("C"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", T.id_to_session(k).alias("session"), T.speech_of_segment(F.concat(k, F.lit("_x_7"))).alias("speech"))


_READ = "Tile Tlie Time Tihe Tire Thie Tite Tlhe Tise Tlfe Tlle Tfhe Tiie Thle Tlte Tle Tme Tne Tie Tue Tte Tse".replace(" ", "|")


@query("prefix_repair", rf"""
select s_suppkey, speaker, case when regexp_matches(speaker, '^(?:{_READ})') then 'The ' || regexp_replace(regexp_replace(speaker, '^(?:{_READ})', ''), '^\s+|\s+$', '', 'g') else speaker end as fixed
from (select s_suppkey, ['Tile', 'Tlie', 'Tme', 'The', 'Mr.', 'Tiie', 'Tne', 'Tse'][1 + s_suppkey % 8] || ['', ' ', '  '][1 + s_suppkey % 3] || s_name as speaker from supplier)
""")  # fmt: skip
def prefix_repair(t: Tables) -> DataFrame:
    first = F.get(F.array(*map(F.lit, ["Tile", "Tlie", "Tme", "The", "Mr.", "Tiie", "Tne", "Tse"])), (F.col("s_suppkey") % 8).cast("int"))
    gap = F.get(F.array(*map(F.lit, ["", " ", "  "])), (F.col("s_suppkey") % 3).cast("int"))
    return t.supplier.select("s_suppkey", F.concat(first, gap, "s_name").alias("speaker")).withColumn("fixed", T.repair_prefix(F.col("speaker")))


_TITLES = ["The VICE PRES.", "The  PRESIDENT", "The ACTING PRESIDENT", "The PRESIDENT protempore", "The PRESIDENTpro tempore", "Mr. SMITH-JONES", "The CHAIR  "]


@query("title_case_when", r"""
with a as (select s_suppkey, array_to_string(list_filter(string_split_regex(
    ['The VICE PRES.', 'The  PRESIDENT', 'The ACTING PRESIDENT', 'The PRESIDENT protempore', 'The PRESIDENTpro tempore', 'Mr. SMITH-JONES', 'The CHAIR  '][1 + s_suppkey % 7], '\s+'), lambda t: t <> ''), ' ') as s from supplier),
b as (select s_suppkey, case when starts_with(string_split(s, ' ')[2], 'VICE') then 'The VICE PRESIDENT' else s end as s from a),
c as (select s_suppkey, case when regexp_matches(s, '(pro tempore|protempore)$') then regexp_replace(regexp_replace(s, '(pro tempore|protempore)$', ''), '^\s+|\s+$', '', 'g') || ' pro tempore' else s end as s from b)
select s_suppkey, replace(case when s in ('The PRESIDENT', 'The ACTING PRESIDENT') then s || ' pro tempore' else s end, '-', ' ') as title from c
""")  # fmt: skip
def title_case_when(t: Tables) -> DataFrame:
    s = F.get(F.array(*map(F.lit, _TITLES)), (F.col("s_suppkey") % 7).cast("int"))
    return t.supplier.select("s_suppkey", T.canonical_title(s).alias("title"))


@query("keyword_match", f"""
with s as (select doc_id, pos, {WORDS.format(x='lower(line)')} as w from ({LINES}))
select doc_id, pos, len(w) > 0 and (list_has_any(w, ['disgusting', 'trash'])
  or list_has_any(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), ['of the', 'the in'])
  or contains(array_to_string(w, ' '), 'immig')
  or len(list_filter(w, lambda x: x[1:9] in ('thingatio', 'ertionent') or ((x[1:5] in ('pathe', 'thing') or x[1:4] in ('stup', 'idio')) and not x[1:7] in ('thingth', 'thinger')))) > 0) as matched
from s
""")  # fmt: skip
def keyword_match(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", i64(F.col("pos")).alias("pos"), T.keyword_match(tokens_of("line"), DEMO).alias("matched"))


@query("phrase_fuse", r"""
select doc_id, md5(regexp_replace(lower(text), '(die|the|der|of|la)[ -](thing|and|of|is|in|de|la)', '\1\2', 'g')) as fused_md5,
  md5(replace(replace(lower(text), 'of the', 'ofthe'), 'ofthe in', 'ofthein')) as ordered_md5 from documents
""")  # fmt: skip
def phrase_fuse(t: Tables) -> DataFrame:
    low = F.lower("text")
    fused = T.fuse_phrases(low, ["the", "of", "la", "der", "die"], ["thing", "and", "of", "is", "in", "de", "la"])
    return t.documents.select("doc_id", F.md5(fused).alias("fused_md5"), F.md5(T.replace_phrases(low, {"of the": "ofthe", "ofthe in": "ofthein"})).alias("ordered_md5"))


_TAGGED = f"select doc_id, list_transform({WORDS.format(x='lower(text)')}, lambda x: x || ' (' || case when x in ('self', 'the', 'la', 'der') then 'n' when x in ('of', 'de', 'die') then 'v' else 'j' end || ')') as l from documents"


def _tags(w):
    return F.transform(w, lambda x: F.when(x.isin("self", "the", "la", "der"), "NN").when(x.isin("of", "de", "die"), "VB").otherwise("JJ"))


@query("tagged_lemma", f"select doc_id, cast(len(l) as bigint) as n, md5(array_to_string(l, '|')) as lemmas_md5 from ({_TAGGED})")
def tagged_lemma(t: Tables) -> DataFrame:
    w = T.words(F.col("text"))
    s = t.documents.select("doc_id", w.alias("w")).select("doc_id", T.tagged_lemmas(F.col("w"), _tags(F.transform("w", F.lower))).alias("l"))
    return s.select("doc_id", i64(F.size("l")).alias("n"), F.md5(F.array_join("l", "|")).alias("lemmas_md5"))


@query("bigram_append", f"""
with a as ({_TAGGED}), b as (select doc_id, l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) as p from a)
select doc_id, cast(len(l) as bigint) as n_before, cast(len(l) + len(list_filter(p, lambda x: x in ('the (n) of (v)', 'la (n) de (v)'))) as bigint) as n_after,
  cast(len(list_filter(p, lambda x: x = 'the (n) of (v)')) as bigint) as n_fused from b
""")  # fmt: skip
def bigram_append(t: Tables) -> DataFrame:
    w = T.words(F.lower("text"))
    s = t.documents.select("doc_id", w.alias("w")).select("doc_id", T.tagged_lemmas(F.col("w"), _tags(F.col("w"))).alias("l"))
    more = s.withColumn("m", T.append_fused(F.col("l"), {"the (n) of (v)": "theof (n)", "la (n) de (v)": "lade (n)"}))
    fused = F.size(F.filter("m", lambda x: x == "theof (n)"))
    return more.select("doc_id", i64(F.size("l")).alias("n_before"), i64(F.size("m")).alias("n_after"), i64(fused).alias("n_fused"))


@query("ngrams", f"""
with a as (select conv_id, turn, {WORDS.format(x='lower(text)')} as w from conversations),
g as (select conv_id, turn, list_transform(range(1, len(w)), lambda i: w[i:i + 1]) as g from a)
select conv_id, turn, cast(len(g) as bigint) as n_all, cast(len(list_filter(g, lambda x: len(list_filter(x, lambda y: not regexp_matches(y, '^\\p{{L}}+$'))) = 0)) as bigint) as n_alpha,
  cast(len(list_filter(g, lambda x: len(list_filter(x, lambda y: not regexp_matches(y, '[a-zA-Z0-9]'))) = 0)) as bigint) as n_alnum,
  md5(array_to_string(list_transform(g, lambda x: array_to_string(x, '_')), ' ')) as grams_md5 from g
""")  # fmt: skip
def ngrams(t: Tables) -> DataFrame:
    w = t.conversations.select("conv_id", "turn", tokens_of().alias("w"))
    g = w.select("conv_id", "turn", T.ngrams(F.col("w"), 2).alias("g"), *[i64(F.size(T.ngrams(F.col("w"), 2, k))).alias(f"n_{k}") for k in ("alpha", "alnum")])
    return g.select("conv_id", "turn", i64(F.size("g")).alias("n_all"), "n_alpha", "n_alnum", F.md5(F.array_join("g", " ")).alias("grams_md5"))


_CLEAN = f"""select doc_id, lang, list_transform({WORDS.format(x='text')}, lambda x: case when lower(x) in ('the', 'of', 'and', 'la', 'de', 'der', 'die')
  or not regexp_matches(x, '^[a-zA-Z0-9#$!?%"]') then '_' else regexp_replace(replace(x, '_', '-'), '[0-9]', '#', 'g') end) as c from documents"""


@query("token_clean", f"select doc_id, cast(len(list_filter(c, lambda x: x = '_')) as bigint) as n_dropped, md5(array_to_string(c, ' ')) as clean_md5 from ({_CLEAN})")
def token_clean(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", T.clean_tokens(T.words(F.col("text")), STOP).alias("c"))
    return s.select("doc_id", i64(F.size(F.filter("c", lambda x: x == "_"))).alias("n_dropped"), F.md5(F.array_join("c", " ")).alias("clean_md5"))


@query("token_clean_kept", rf"""
select doc_id, cast(len(list_filter(c, lambda x: regexp_matches(x, '^\p{{L}}+$'))) as bigint) as n_alpha, cast(len(list_filter(c, lambda x: regexp_matches(x, '[a-zA-Z0-9]'))) as bigint) as n_alnum,
  md5(array_to_string(list_transform(c, lambda x: case when regexp_matches(x, '^\p{{L}}+$') then x else '_' end), ' ')) as clean_md5 from ({_CLEAN})
""")  # fmt: skip
def token_clean_kept(t: Tables) -> DataFrame:
    w = T.words(F.col("text"))
    s = t.documents.select("doc_id", *[T.clean_tokens(w, STOP, k).alias(k) for k in ("alpha", "alnum")])
    kept = [i64(F.size(F.filter(k, lambda x: x != "_"))).alias(f"n_{k}") for k in ("alpha", "alnum")]
    return s.select("doc_id", *kept, F.md5(F.array_join("alpha", " ")).alias("clean_md5"))


@query("feda_features", f"select doc_id, cast(2 * len(c) as bigint) as n, md5(array_to_string(list_concat(c, list_transform(c, lambda x: x || '__' || substr(lang, 1, 10))), ' ')) as features_md5 from ({_CLEAN})")
def feda_features(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", T.domain_features(T.clean_tokens(T.words(F.col("text")), STOP), F.col("lang")).alias("c"))
    return s.select("doc_id", i64(F.size("c")).alias("n"), F.md5(F.array_join("c", " ")).alias("features_md5"))


@query("levenshtein", "select p_partkey, cast(levenshtein(p_name, p_type) as bigint) as d, cast(levenshtein(p_name, p_brand) as bigint) as e from part")
def levenshtein(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", i64(F.levenshtein("p_name", "p_type")).alias("d"), i64(F.levenshtein("p_name", "p_brand")).alias("e"))


@query("nearest_label", """
with a as (select conv_id, turn, case when turn % 4 = 0 then 'postive' else left(role, 4) || right(role, 1 + cast(turn % 3 as integer)) end as said from conversations),
o as (select * from (values (0, 'user'), (1, 'assistant'), (2, 'system')) as v(i, o)),
r as (select conv_id, turn, said, o, row_number() over (partition by conv_id, turn order by levenshtein(said, o), i) as n from a cross join o)
select conv_id, turn, said, case when said = 'postive' then 'positive' else o end as nearest from r where n = 1
""")  # fmt: skip
def nearest_label(t: Tables) -> DataFrame:
    said = F.when(F.col("turn") % 4 == 0, "postive").otherwise(F.concat(F.left("role", F.lit(4)), F.right("role", F.lit(1) + (F.col("turn") % 3).cast("int"))))
    df = t.conversations.select("conv_id", "turn", said.alias("said"))
    return labels.nearest(df, "said", ["user", "assistant", "system"], {"postive": "positive"})


@query("ocr_neighbors", f"""
with v as (select word, count(*) as n from (select unnest({WORDS.format(x='lower(text)')}) as word from documents) group by 1),
f as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as form from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
p as (select a.word, b.word as other, b.n from f a join f b on a.i = b.i and a.form = b.form and a.word <> b.word
  union select f.word, v.word, v.n from f join v on v.word = f.form union select v.word, f.word, f.n from f join v on v.word = f.form)
select word, other, n as n_other, rank from (select word, other, n, row_number() over (partition by word order by n desc, other) as rank from p) where rank <= 10
""")  # fmt: skip
def ocr_neighbors(t: Tables) -> DataFrame:
    """Over all tokens of all documents. The SQL lets words meet by their forms with one letter left out, as this does."""
    x = t.documents.select(F.explode(tokens_of()).alias("word"))
    found = joins.one_edit_neighbours(x.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.col("n_other").desc(), "other"))
    return found.withColumn("rank", i64(rank)).where("rank <= 10")


@query("surname", r"""
with a as (select s_suppkey, 'Ms. ' || ['José', 'Müller', 'O''Neil', 'Lee-Ann'][1 + s_suppkey % 4] || ' Peña.' || case when s_suppkey % 2 = 0 then ' of ' || s_name else '' end as x from supplier)
select s_suppkey, upper(regexp_replace(list_filter(string_split_regex(string_split(translate(x, 'áàâäãéèêëíìîïóòôöõúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), ' of ')[1], '\s+'), lambda t: t <> '')[-1], '[!-/:-@\[-`{-~]', '', 'g')) as surname,
  case when contains(x, ' of ') then array_to_string(list_concat(string_split(x, ' ')[1:2], string_split(x, ' ')[-2:]), ' ') else x end as short_name from a
""")  # fmt: skip
def surname(t: Tables) -> DataFrame:
    first = F.get(F.array(*map(F.lit, ["José", "Müller", "O'Neil", "Lee-Ann"])), (F.col("s_suppkey") % 4).cast("int"))
    x = F.concat(F.lit("Ms. "), first, F.lit(" Peña."), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" of "), "s_name")).otherwise(F.lit("")))
    return t.supplier.select("s_suppkey", T.surname(x).alias("surname"), T.short_name(x).alias("short_name"))


@query("alpha_stopword", rf"""
select doc_id, cast(len(w) as bigint) as n, md5(array_to_string(w, ' ')) as words_md5 from (
 select doc_id, list_filter({WORDS.format(x='lower(text)')}, lambda x: regexp_matches(x, '^\p{{L}}+$') and x not in ('the', 'of', 'and', 'la', 'de', 'der', 'die')) as w from documents)
""")  # fmt: skip
def alpha_stopword(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", T.alpha_words(T.words(F.lower("text")), STOP).alias("w"))
    return w.select("doc_id", i64(F.size("w")).alias("n"), F.md5(F.array_join("w", " ")).alias("words_md5"))


# Of words that share the white space between them one replacement takes every other one, so the SQL has it twice.
_MASK = r"regexp_replace({x}, '(^|\s)the(\s|$)', '\1[MASK]\2', 'g')"
_PIECES = "replace(replace(text, ' la', ' ##la'), ' ##', '')"


@query("piece_collapse", f"select conv_id, turn, md5({_MASK.format(x=_MASK.format(x=_PIECES))}) as masked_md5 from conversations")
def piece_collapse(t: Tables) -> DataFrame:
    pieces = F.replace("text", F.lit(" la"), F.lit(" ##la"))
    return t.conversations.select("conv_id", "turn", F.md5(T.mask_word(pieces, "the")).alias("masked_md5"))


@query("sentence_rejoin", rf"""
with l as (select doc_id, pos, line from ({LINES}) where line <> ''),
f as (select doc_id, pos, line, case when lag(pos) over w is not null and regexp_matches(line, '^[\p{{Ll}}0-9$%]') and right(lag(line) over w, 1) = '.' then 0 else 1 end as b
      from l window w as (partition by doc_id order by pos)),
g as (select doc_id, pos, line, sum(b) over (partition by doc_id order by pos) - 1 as grp from f)
select doc_id, cast(grp as bigint) as grp, count(*) as n_sents, md5(string_agg(line, ' ' order by pos)) as text_md5 from g group by doc_id, grp
""")  # fmt: skip
def sentence_rejoin(t: Tables) -> DataFrame:
    return segment.rejoin(lines(t), "doc_id", "pos", "line").select("doc_id", "grp", "n_sents", F.md5("text").alias("text_md5"))


@query("arrays_rejoin", rf"""
with l as (select doc_id, unnest(range(len(s))) as pos, unnest(s) as line from (select doc_id, string_split(replace(text, ', ', ' .' || chr(10)), chr(10)) as s from documents)),
k as (select doc_id, pos, {WORDS.format(x='line')} as w from l),
f as (select doc_id, pos, w, case when (regexp_matches(w[1], '^[^\p{{Lu}}\p{{Lt}}]*\p{{Ll}}[^\p{{Lu}}\p{{Lt}}]*$') or regexp_matches(w[1], '^\p{{Nd}}+$') or w[1] in ('$', '%')) and lag(w[len(w)]) over o = '.' then 0 else 1 end as b
      from k where len(w) > 0 window o as (partition by doc_id order by pos)),
g as (select doc_id, pos, w, sum(b) over (partition by doc_id order by pos) - 1 as grp from f)
select doc_id, cast(grp as bigint) as grp, cast(sum(len(w)) as bigint) as n_tokens, md5(string_agg(array_to_string(w, ' '), ' ' order by pos)) as tokens_md5, md5(string_agg(lower(array_to_string(w, ' ')), ' ' order by pos)) as lemmas_md5 from g group by doc_id, grp
""")  # fmt: skip
def arrays_rejoin(t: Tables) -> DataFrame:
    pieces = F.split(F.replace("text", F.lit(", "), F.lit(" .\n")), "\n")
    w = t.documents.select("doc_id", F.posexplode(pieces).alias("pos", "line")).select("doc_id", "pos", T.words(F.col("line")).alias("w"))
    glued = segment.rejoin_arrays(w.withColumn("lemmas", F.transform("w", F.lower)), "doc_id", "pos", "w", "lemmas")
    return glued.select("doc_id", "grp", i64(F.size("w")).alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"), F.md5(F.array_join("lemmas", " ")).alias("lemmas_md5"))


@query("block_pack", rf"""
with recursive s as (select doc_id, row_number() over (partition by doc_id order by pos) as i, n from (
   select doc_id, pos, cast(len({WORDS.format(x='line')}) as bigint) as n from ({LINES}) where line <> '')),
b as (select doc_id, i, n as have, 0 as block from s where i = 1
  union all select s.doc_id, s.i, case when b.have + s.n > 50 then s.n else b.have + s.n end, case when b.have + s.n > 50 then b.block + 1 else b.block end
  from b join s on s.doc_id = b.doc_id and s.i = b.i + 1)
select doc_id, cast(block as bigint) as block, cast(max(have) as bigint) as n_tokens from b group by doc_id, block
""")  # fmt: skip
def block_pack(t: Tables) -> DataFrame:
    return segment.blocks(t.documents, "doc_id", F.split("text", "\n"), 50).select("doc_id", "block", "n_tokens")


@query("context_window", rf"""
with s as (select doc_id, string_split(text, chr(10)) as l from documents),
h as (select doc_id, l, unnest(list_filter(range(len(l)), lambda i: contains(l[i + 1], 'the '))) as i from s)
select doc_id, cast(i as bigint) as center, md5(array_to_string(l[greatest(i - 3, 0) + 1 : i + 4], ' ')) as text_md5 from h
""")  # fmt: skip
def context_window(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", F.split("text", "\n").alias("l"))
    hits = F.filter(F.transform("l", lambda x, i: F.when(x.contains("the "), i)), lambda i: i.isNotNull())
    c = s.select("doc_id", "l", hits.alias("h")).select("doc_id", F.explode(segment.contexts(F.col("l"), F.col("h"))).alias("c"))
    return c.select("doc_id", i64(F.col("c.center")).alias("center"), F.md5("c.text").alias("text_md5"))


@query("chunk_tokens", rf"""
with w as (select doc_id, {WORDS.format(x='text')} as w from documents), p as (select doc_id, w, greatest(1, len(w) // 100) as k from w)
select doc_id, cast(i as bigint) as chunk, md5(array_to_string(w[i * (len(w) // k) + 1 : case when i = k - 1 then len(w) else (i + 1) * (len(w) // k) end], ' ')) as text_md5
from (select doc_id, w, k, unnest(range(k)) as i from p)
""")  # fmt: skip
def chunk_tokens(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", T.words(F.col("text")).alias("w")).withColumn("k", F.greatest(F.lit(1), F.floor(F.size("w") / 100).cast("int")))
    c = w.select("doc_id", F.posexplode(segment.chunks(F.col("w"), F.col("k"))).alias("chunk", "c"))
    return c.select("doc_id", i64(F.col("chunk")).alias("chunk"), F.md5(F.array_join("c", " ")).alias("text_md5"))


@query("flatten_join", rf"""
select doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda s: array_to_string({WORDS.format(x='s')}, ' ')), ' ')) as joined_md5,
  cast(len(flatten(list_transform(string_split(text, chr(10)), lambda s: {WORDS.format(x='s')}))) as bigint) as n_flat from documents
""")  # fmt: skip
def flatten_join(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", F.transform(F.split("text", "\n"), lambda x: T.words(x)).alias("s"))
    return s.select("doc_id", F.md5(T.join_sentences(F.col("s"))).alias("joined_md5"), i64(F.size(F.flatten("s"))).alias("n_flat"))


@query("retokenize_possessive", rf"""
with w as (select doc_id, {WORDS.format(x='lower(text)')} as w from documents)
select doc_id, cast(len(w) - len(list_filter(w[2:], lambda x: x = 'of')) as bigint) as n_tokens from w
""")  # fmt: skip
def retokenize_possessive(t: Tables) -> DataFrame:
    """Tokens 'of' stand in for "'s"; 'de' is tagged like a possessive, but isn't one."""
    w = t.documents.select("doc_id", tokens_of().alias("w"))
    said = F.transform("w", lambda x: F.when(x == "of", "'s").otherwise(x))
    joined = T.retokenize_possessives(said, F.transform("w", lambda x: F.when(x.isin("of", "de"), "POS").otherwise("NN")))
    return w.select("doc_id", i64(F.when(F.size("w") == 0, 0).otherwise(F.size(joined))).alias("n_tokens"))


@query("speaker_ffill", """
with l as (select doc_id, pos, line, case when starts_with(line, 'The') then 1 when starts_with(line, 'In') or starts_with(line, 'A') then 2 else 0 end as kind from (""" + LINES + """)),
s as (select *, coalesce(last_value(case when kind > 0 then kind end ignore nulls) over (partition by doc_id order by pos rows unbounded preceding), 1) as state, max(kind) over (partition by doc_id) as marked from l)
select doc_id, cast(pos as bigint) as pos, cast(kind as bigint) as kind from s where marked = 0 or state = 1
""")  # fmt: skip
def speaker_ffill(t: Tables) -> DataFrame:
    kind = F.when(F.startswith("line", F.lit("The")), 1).when(F.startswith("line", F.lit("In")) | F.startswith("line", F.lit("A")), 2).otherwise(0)
    return segment.president_lines(lines(t).withColumn("kind", kind), "doc_id", "pos", "kind").select("doc_id", i64(F.col("pos")).alias("pos"), i64(F.col("kind")).alias("kind"))


@query("length_bucket", r"""
with s as (select doc_id, pos, regexp_replace(lower(regexp_replace(regexp_replace(line, '[!-/:-@\[-`{-~]', '', 'g'), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') as s from (""" + LINES + r"""))
select case when len(list_filter(string_split(s, ' '), lambda x: x <> '')) <= 2 or length(s) <= 15 then 'skip' when length(s) < 400 then 'short' else 'long' end as bucket, count(*) as n from s group by 1
""")  # fmt: skip
def length_bucket(t: Tables) -> DataFrame:
    s = lines(t).select(T.simplify_text(F.col("line")).alias("s"))
    bucket = F.when((T.token_count(F.col("s")) <= 2) | (F.length("s") <= 15), "skip").when(F.length("s") < 400, "short").otherwise("long")
    return s.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_TERMS = "(select * from (values ('place', 'the'), ('place', 'in'), ('place', 'on'), ('place', 'at'), ('link', 'and'), ('link', 'or'), ('link', 'that'), ('link', 'und'), ('link', 'et'), ('link', 'y'), ('insult', 'idiot'), ('insult', 'stupid'), ('insult', 'trash'), ('insult', 'scum'), ('insult', 'clown')) as v(category, term))"
_LINE_TERMS = f"select distinct l.doc_id, l.pos, m.category from (select doc_id, pos, unnest({WORDS.format(x='lower(line)')}) as term from ({LINES})) l join {_TERMS} m on m.term = l.term"


def _matched_lines(t: Tables) -> DataFrame:
    """Lines with the categories they hold: distinct tokens meet a small dictionary that every task has."""
    each = lines(t).select("doc_id", "pos", F.explode(F.array_distinct(tokens_of("line"))).alias("term"))
    return each.join(F.broadcast(terms_table(t.spark, DEMO_TERMS)), "term").select("doc_id", "pos", "category").distinct()


@query("dictionary_match", f"select category, count(*) as n_segments, count(distinct doc_id) as n_docs from ({_LINE_TERMS}) group by category")
def dictionary_match(t: Tables) -> DataFrame:
    return _matched_lines(t).groupBy("category").agg(F.count(F.lit(1)).alias("n_segments"), F.countDistinct("doc_id").alias("n_docs"))


@query("agg_collect_set", f"select distinct category, doc_id from ({_LINE_TERMS})")
def agg_collect_set(t: Tables) -> DataFrame:
    """The set of documents of each category, a row a member: no row grows with the table."""
    return _matched_lines(t).select("category", "doc_id").distinct()


@query("multi_membership", f"select m.category, d.lang, count(distinct m.doc_id) as n_docs, sum(d.n_chars) as n_chars from (select distinct doc_id, category from ({_LINE_TERMS})) m join documents d on d.doc_id = m.doc_id group by 1, 2".replace("sum(d.n_chars)", "cast(sum(d.n_chars) as bigint)"))
def multi_membership(t: Tables) -> DataFrame:
    member = _matched_lines(t).select("doc_id", "category").distinct()
    return member.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").groupBy("category", "lang").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("mention_detect", rf"""
with l as (select doc_id, pos, {WORDS.format(x='lower(line)')} as w from ({LINES})),
f as (select doc_id, pos, string_split(replace(replace(array_to_string(w, ' '), 'of the', 'ofthe'), 'the thing', 'thething'), ' ') as x from l where list_has_any(w, ['of', 'thing', 'idiot']))
select doc_id, cast(pos as bigint) as pos, cast(len(list_intersect(list_distinct(x), ['ofthe', 'thething', 'idiot'])) as bigint) as n_terms from f where len(x) >= 4 and list_has_any(x, ['ofthe', 'thething', 'idiot'])
""")  # fmt: skip
def mention_detect(t: Tables) -> DataFrame:
    w = lines(t).select("doc_id", "pos", tokens_of("line").alias("w")).where(F.arrays_overlap("w", F.array(*map(F.lit, ["of", "thing", "idiot"]))))
    fused = F.split(T.replace_phrases(F.array_join("w", " "), {"of the": "ofthe", "the thing": "thething"}), " ")
    targets = F.array(*map(F.lit, ["ofthe", "thething", "idiot"]))
    x = w.select("doc_id", i64(F.col("pos")).alias("pos"), fused.alias("x")).where((F.size("x") >= 4) & F.arrays_overlap("x", targets))
    return x.select("doc_id", "pos", i64(F.size(F.array_intersect("x", targets))).alias("n_terms"))


@query("procedural_classes", r"""
with s as (select pos, regexp_replace(lower(regexp_replace(regexp_replace(line, '[!-/:-@\[-`{-~]', '', 'g'), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') as s from (""" + LINES + r""")),
c as (select s, count(*) as n from s where length(s) < 200 and not (length(s) <= 15 or len(list_filter(string_split(s, ' '), lambda x: x <> '')) <= 2) group by s)
select case when n >= 20 then 'train' else 'test' end as part, count(*) as n_texts, cast(sum(case when n >= 20 then n // 10 else 1 end) as bigint) as n_rows from c where n >= 10 group by 1
""")  # fmt: skip
def procedural_classes(t: Tables) -> DataFrame:
    s = lines(t).select(T.simplify_text(F.col("line")).alias("s")).where((F.length("s") < 200) & ~((F.length("s") <= 15) | (T.token_count(F.col("s")) <= 2)))
    c = s.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    part = F.when(F.col("n") >= 20, "train").otherwise("test")
    return c.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_texts"), i64(F.sum(F.when(F.col("n") >= 20, F.floor(F.col("n") / 10)).otherwise(1))).alias("n_rows"))


@query("ngram_vocab", rf"""
with l as (select doc_id, {WORDS.format(x='lower(line)')} as w from ({LINES})),
g as (select unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])))) as term from l)
select term, count(*) as sentence_df from g group by term having count(*) >= 25
""")  # fmt: skip
def ngram_vocab(t: Tables) -> DataFrame:
    w = lines(t).select(tokens_of("line").alias("w"))
    terms = F.array_distinct(F.concat("w", T.ngrams(F.col("w"), 2)))
    return w.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("sentence_df")).where("sentence_df >= 25")


@query("idf_raw", rf"""
with w as (select doc_id, unnest({WORDS.format(x='lower(text)')}) as term from documents)
select term, count(*) as n, round((select count(*) from documents) / count(*), 6) as idf from w group by term having count(*) >= 50
""")  # fmt: skip
def idf_raw(t: Tables) -> DataFrame:
    n = t.documents.agg(F.count(F.lit(1)).alias("docs"))
    w = t.documents.select(F.explode(tokens_of()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 50")
    return w.crossJoin(F.broadcast(n)).select("term", "n", r6(F.col("docs") / F.col("n")).alias("idf"))


@query("noun_filter", rf"select doc_id, cast(len(list_filter({WORDS.format(x='lower(text)')}, lambda x: x in ('the', 'la', 'der'))) as bigint) as n_nouns from documents")
def noun_filter(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", tokens_of().alias("w"))
    tags = F.transform("w", lambda x: F.when(x.isin("the", "la", "der"), "NN").otherwise("X"))
    return w.select("doc_id", i64(F.size(T.nouns(F.col("w"), tags))).alias("n_nouns"))


@query("random_terms", f"""
with c as (select unnest({WORDS.format(x='lower(text)')}) as term from documents), n as (select term, count(*) as n from c group by 1 having count(*) >= 50), v as (select distinct unnest({WORDS.format(x='lower(text)')}) as term from benchmark)
select term, n from n where term in (select term from v) and term not in ('the', 'of', 'and', 'la', 'de', 'der', 'die') order by md5(concat_ws('|', term, '7')), term limit 50
""")  # fmt: skip
def random_terms(t: Tables) -> DataFrame:
    uses = t.documents.select(F.explode(tokens_of()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    known = t.benchmark.select(F.explode(tokens_of()).alias("term")).distinct()
    return labels.draw_terms(uses, "term", "n", 50, 50, 7, known, F.broadcast(t.rows("term string", *[(x,) for x in STOP])))


@query("comma_list", "select conv_id, turn, cast(len(l) as bigint) as n, l[1] as first from (select conv_id, turn, string_split(text, ',') as l from conversations)")
def comma_list(t: Tables) -> DataFrame:
    parts = t.conversations.select("conv_id", "turn", T.comma_list(F.col("text")).alias("l"))
    return parts.select("conv_id", "turn", i64(F.size("l")).alias("n"), F.get("l", F.lit(0)).alias("first"))


@query("combinations", "select a.r_name as name1, b.r_name as name2, c.r_name as name3 from region a join region b on a.r_regionkey < b.r_regionkey join region c on b.r_regionkey < c.r_regionkey")
def combinations(t: Tables) -> DataFrame:
    return joins.combinations(t.region.withColumnRenamed("r_name", "name"), "r_regionkey", ["name"], 3)


@query("zip_map", "select p_partkey, word, max(i) as at from (select p_partkey, unnest(w) as word, unnest(range(len(w))) as i from (select p_partkey, string_split(p_name, ' ') || [p_brand, p_type] || string_split(p_name, ' ')[1:1] as w from part)) group by 1, 2")
def zip_map(t: Tables) -> DataFrame:
    """Words to places, as a map in which the last place of a word counts."""
    w = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type"), F.slice(F.split("p_name", " "), F.lit(1), F.lit(1)))
    rows = t.part.select("p_partkey", w.alias("w")).select("p_partkey", "w", F.transform("w", lambda _, i: i.cast("long")).alias("i"))
    return rows.select("p_partkey", F.explode(T.zip_map(F.col("w"), F.col("i"))).alias("word", "at"))


@query("join_trailing", r"select doc_id, md5(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda s: s || ' '), ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) as joined_md5 from documents")
def join_trailing(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.join_trailing(F.split("text", "\n"))).alias("joined_md5"))


@query("explode_nested", """
select conv_id || '_' || lpad(cast(row_number() over (partition by conv_id order by turn) - 1 as varchar), 4, '0') as id, role as speaker, text from conversations qualify role is not null
""")  # fmt: skip
def explode_nested(t: Tables) -> DataFrame:
    item = F.struct(F.col("turn").alias("o"), F.lit("speech").alias("kind"), F.col("role").alias("speaker"), F.lit(None).cast("string").alias("speaker_bioguide"), "text", F.col("turn").cast("int").alias("turn"))
    header = F.struct(F.lit("H").alias("chamber"), F.lit("2001").alias("year"), F.lit("1").alias("month"), F.lit("2").alias("day"), F.lit(None).cast("string").alias("extension"))
    pages = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("content")).select(F.col("conv_id").cast("string").alias("id"), header.alias("header"), "content")
    return explode_pages(pages).select("id", "speaker", "text")


@query("explode_map", "select event_id, 'k' as key, cast(json_extract(props, '$.k') as bigint) as value from events")
def explode_map(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))


@query("metaphor_counts", f"""
with w as (select doc_id, unnest({WORDS.format(x='lower(text)')}) as term from documents)
select lang, count(*) filter (where term in ('thing', 'things', 'object', 'objects')) as n_cargo, count(*) as n from w join documents using (doc_id) group by lang
""")  # fmt: skip
def metaphor_counts(t: Tables) -> DataFrame:
    w = t.documents.select("lang", F.explode(tokens_of()).alias("term"))
    return w.groupBy("lang").agg(F.count_if(F.col("term").isin(*METAPHORS["cargo"][:4])).alias("n_cargo"), F.count(F.lit(1)).alias("n"))
