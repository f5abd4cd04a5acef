"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, chat_format, decontamination, exact_dedup, fingerprints, jaccard_join, language_id, mixing, periodic_runs, quality, sharding, source_divergence, substring_dedup
from lectern.llm.common import checkpoint


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary's path, the same on every executor."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_pieces(_table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    record = {"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]}
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(json.dumps(record)).alias("record"))
    turns = chat_format.turns_of_table(_table(spark, sf_dir, "conversations"))
    turns = turns.unionByName(chat_format.turns_of_records(extra, "conv_id", "record"))
    done = chat_format.format_chat(turns)
    told = done.select(
        "conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss")
    )
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(spoken, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return exact_dedup.exact_dedup(docs, narrow=True).select("doc_id", "keep_id", F.col("group_size").cast("long"), "kept", "text_sha256")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    marked = docs.withColumn("held_out", quality.held_out(F.col("doc_id")))
    return quality.score(marked, model).select("doc_id", "held_out", "score", "predicted")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return byte_bpe.encode(docs, vocabulary(), public_tokenizers.PATTERN, keep=["doc_id"], digests=True)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, 16).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard"
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    marked = docs.select("doc_id", "text", language_id.held_out(F.col("doc_id")).alias("held_out"))
    return language_id.predict(marked, model).select("doc_id", "held_out", "lang_pred", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), narrow=True).select("doc_id", "size", "source_size", "target", "taken")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_near_counts(checkpoint(fingerprints.with_edited(_table(spark, sf_dir, "documents"))))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = F.crc32(F.col("doc_id").cast("string"))
    lot, n = F.floor(drawn / 10), F.greatest(periodic_runs.n_words(F.col("text")), F.lit(1))
    first = lot % n
    period = 1 + F.floor((n - first) / (3 + lot % 8))
    loops = (drawn % 10 == 0) & (periodic_runs.n_words(F.col("text")) > 0)
    text = F.when(loops, periodic_runs.looped(F.col("text"), first.cast("int"), period.cast("int"))).otherwise(F.col("text"))
    found = periodic_runs.find_runs(_table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_sharding": op7_sharding,
        "op8_language_id": op8_language_id,
        "op9_mixing": op9_mixing,
        "op10_fingerprints": op10_fingerprints,
        "op11_decontamination": op11_decontamination,
        "op12_source_divergence": op12_source_divergence,
        "op13_periodic_runs": op13_periodic_runs,
    }


_SQL_SPACE = r"[\x20\x09-\x0D]+"

OP3_SQL = rf"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SQL_SPACE}', ' ', 'g')) as h from documents)
select doc_id, min(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
       doc_id = min(doc_id) over (partition by h) as kept, h as text_sha256
from d
"""

_ESC = chat_format.ESCAPE.replace("'", "''")
OP2_SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), c as (
  select conv_id, count(*) as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as spoken,
         coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
         sum(length(regexp_replace(text, '{_ESC}', '\1\\\2\3', 'g')) + length(role) + 24) as formatted_chars
  from t group by conv_id
)
select conv_id, n_turns, sha256(spoken) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
       cast(formatted_chars as bigint) as formatted_chars
from c
"""


OP11_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), win as (
  select distinct item_id, n, array_to_string(w[s : s + n - 1], ' ') as said
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as s from b where len(w) > 0)
), occ as (
  select doc_id, s, g.n, said
  from (select doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') as said
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from win))) g
  semi join win on win.said = g.said and win.n = g.n
), hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(s, s + n)) as place from occ) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from occ join win using (said, n)) group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit using (doc_id) left join named using (doc_id)
"""

OP12_SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), t as (select id, lang, source, unnest(w) as term from d
), kept as (select lang, term from t group by lang, term having count(distinct id) >= 30
), c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by lang, source, term
), v as (select lang, count(*) as v from kept group by lang
), g as (
  select g.lang, g.source, coalesce(sum(c.n), 0) as total, coalesce(max(v.v), 0) as v
  from (select distinct lang, source from d) g left join c using (lang, source) left join v using (lang) group by g.lang, g.source
), p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) as p
  from g join kept k using (lang) left join c using (lang, source, term)
), l as (select lang, sum(total) as total, max(v) as v from g group by lang
), q as (
  select k.lang, k.term, 1 + (1000000000::hugeint * (coalesce(sum(c.n), 0) + 5)) // (max(l.total) + 5 * max(l.v)) as q
  from kept k join l using (lang) left join c using (lang, term) group by k.lang, k.term
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(x.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
             from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source) x
    on x.lang = a.lang and x.source = a.source and x.item = b.source
), both_parts as (
  select lang, source, 'pair' as part, item, cast(value as bigint) as value from pairs
  union all
  select p.lang, p.source, 'term', p.term, cast(p.p - q.q as bigint) from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q
)
select lang, source, part, item, value,
       cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
from both_parts
qualify part = 'pair' or rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op11_decontamination": OP11_SQL, "op12_source_divergence": OP12_SQL}
