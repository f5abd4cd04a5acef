"""Benchmark decontamination: a positional inverted index of the training tokens, asked for the phrases of test items.

The index holds a posting (row, place) for every token that any phrase asks for; it is written as its texts are read, without a shuffle. A phrase is
looked up from its rarest terms: their lists, moved back by the term's offset in the phrase, meet at the places where it may begin; what meets is then
compared with the lists of its other terms, at those places alone. A slack above 0 lets each term stand so many words beside its place (proximity).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, checkpoint, col

#: Words of a window of a test item.
WINDOW = 10
#: Lists that are intersected before the others are looked at.
RAREST = 3
#: What is broadcast has at most so many bytes (terms) or rows (of two or three numbers); larger tables are joined by a shuffle.
MOST_BYTES, MOST_ROWS = 8 << 20, 1 << 18

# Words hold ASCII letters and digits and all characters beyond ASCII; A-Z count as a-z.
_GAP, _WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "".join(map(chr, range(65, 91)))


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else; null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def token_list(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(_WORD), F.lit(0))


@dataclass
class Index:
    """postings (row, pos, t), rows (row, id, n_words, skip), terms (term, t); pos counts pieces of the text, of which `skip` (0 or 1) stand before its words."""

    postings: DataFrame
    rows: DataFrame
    terms: DataFrame


def _small(df: DataFrame, size: Column, most: int) -> DataFrame:
    """df, marked to be broadcast if it is known to be small."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def build_index(df: DataFrame, terms: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Postings of the given terms (one column, term) in the words of df; stored. Each row of df is a row of the index, whatever its id and text."""
    terms = scratch.store(terms.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    pieces = F.split(lowered(col(text_col)), _GAP)
    split = df.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"), pieces.alias("pieces"))
    first, last = (F.element_at("pieces", i) == "" for i in (1, -1))
    counted = F.greatest(F.size("pieces") - first.cast("int") - last.cast("int"), F.lit(0))
    tokens = split.select("row", "id", counted.cast("long").alias("n_words"), first.cast("int").alias("skip"), F.posexplode("pieces").alias("pos", "term"))
    known = _small(terms, F.octet_length("term") + 32, MOST_BYTES)
    stored = scratch.store(tokens.join(known, "term", "left").where("t is not null or pos = 0").select("row", "id", "n_words", "skip", "pos", "t"))
    return Index(stored.where("t is not null").select("row", "pos", "t"), stored.where("pos = 0").select("row", "id", "n_words", "skip"), terms)


def lookup(index: Index, phrases: DataFrame, scratch: Scratch, slack: int = 0) -> DataFrame:
    """(p, n, row, start): where the phrases (p, words) of n words stand, each term `slack` words from its place at most, its rarest one at its place.

    start counts the pieces of the text from 0. phrases has one row a phrase, with one word at least; their terms are the index's.
    """
    places = phrases.select("p", F.size("words").alias("n"), F.posexplode("words").alias("o", "term")).join(index.terms, "term")
    found = index.postings.groupBy("t").agg(F.count(F.lit(1)).alias("found"))
    of = Window.partitionBy("p")
    places = places.join(found, "t", "left").withColumn("rank", F.row_number().over(of.orderBy("found", "o")))
    places = scratch.store(places.withColumn("all", F.count("found").over(of)).where("all = n").select("p", "n", "o", "t", "rank"))
    rarest = places.where(F.col("rank") <= RAREST)
    moved = F.explode(F.when(F.col("rank") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(-slack), F.lit(slack)))) if slack else F.lit(0)
    lists = index.postings.join(_small(rarest, F.lit(1), MOST_ROWS), "t").withColumn("moved", moved)
    lists = lists.withColumn("start", F.col("pos") - F.col("o") + F.col("moved")).where("start >= 0" if not slack else "true")
    met = lists.groupBy("p", "n", "row", "start").agg(F.bit_or(F.expr("shiftleft(1, rank - 1)")).alias("ranks"))
    met = scratch.store(met.where(F.bit_count("ranks") == F.least("n", F.lit(RAREST))).drop("ranks"))
    others = places.where(F.col("rank") > RAREST)
    asked = met.where(F.col("n") > RAREST).join(_small(others, F.lit(1), MOST_ROWS), ["p", "n"])
    asked = asked.withColumn("moved", F.explode(F.sequence(F.lit(-slack), F.lit(slack))) if slack else F.lit(0)).withColumn("pos", F.col("start") + F.col("o") + F.col("moved"))
    rows = met.select("row").distinct()
    few = rows.agg(F.count(F.lit(1))).first()[0] <= MOST_ROWS
    postings = index.postings.join(F.broadcast(rows), "row", "left_semi") if few else index.postings
    there = asked.join(postings, ["row", "pos", "t"], "left_semi").groupBy("p", "n", "row", "start").agg(F.count_distinct("o").alias("seen") if slack else F.count(F.lit(1)).alias("seen"))
    return met.where(F.col("n") <= RAREST).unionAll(there.where(F.col("seen") == F.col("n") - RAREST).select("p", "n", "row", "start"))


def _phrases(items: DataFrame, words: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The different phrases (p, words) of items (item, said), and by phrase the items that have it."""
    cut = items.select("item", F.explode(words).alias("words")).where(F.size("words") > 0).distinct()
    phrases = scratch.store(cut.select("words").distinct().withColumn("p", F.monotonically_increasing_id()))
    return phrases, scratch.store(cut.join(phrases, "words").select("p", "item"))


def _items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return items.select(col(item_col).cast("string").alias("item"), token_list(col(text_col)).alias("said"))


def find_items(df: DataFrame, items: DataFrame, slack: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item, start, n_words: where whole items stand in texts, as a phrase (slack 0) or with each word at most `slack` words from its place.

    start is the number of the word, from 0, at which the item would begin, counted from the place of its word that is rarest in df; with a slack it may
    lie before the text. Ids and items come as strings (item) and as they are (id). Items without words stand nowhere; those with the same words are all told.
    """
    with Scratch(df.sparkSession) as scratch:
        phrases, owners = _phrases(_items(items, item_col, item_text_col), F.array("said"), scratch)
        index = build_index(df, phrases.select(F.explode("words").alias("term")), scratch, id_col, text_col)
        found = lookup(index, phrases, scratch, slack).join(owners, "p").join(index.rows, "row")
        return checkpoint(found.select("id", "item", (F.col("start") - F.col("skip")).alias("start"), F.col("n").alias("n_words")))


def contamination(df: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, items for each row of df: its words, those that stand inside a window of an item, and the ids of these items, sorted.

    A window is `size` words of an item that follow each other; an item with fewer words is one window, one without any has none. Words hold ASCII letters
    and digits and all characters beyond ASCII, A-Z as a-z. Null and empty texts have no words; items without an id hit words, but aren't listed, items
    with the same id count once. Texts of any length are read whole; rows that repeat, or repeat an id, each get a row; an empty table gives an empty
    result, without items nothing is hit; other columns play no part.
    """
    with Scratch(df.sparkSession) as scratch:
        at = F.sequence(F.lit(0), F.greatest(F.size("said") - size, F.lit(0)))
        phrases, owners = _phrases(_items(items, item_col, item_text_col), F.transform(at, lambda i: F.slice("said", i + 1, size)), scratch)
        index = build_index(df, phrases.select(F.explode("words").alias("term")), scratch, id_col, text_col)
        found = scratch.store(lookup(index, phrases, scratch))
        before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
        new = F.col("start") + F.col("n") - F.greatest("start", F.coalesce(before, F.lit(0)))
        hits = found.select("row", "start", "n").distinct().withColumn("new", F.greatest(new, F.lit(0))).groupBy("row").agg(F.sum("new").alias("n_hit"))
        named = found.join(owners, "p").select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
        out = index.rows.join(hits, "row", "left").join(named, "row", "left")
        return checkpoint(out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")))
