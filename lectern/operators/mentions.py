"""Sentences that mention a group of people."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.phrases import compared_groups, fuse_american, fuse_mentions, is_compound, mention_terms
from lectern.vocab import AFTER_GROUP, GROUPS, MENTIONS, SPLIT_PHRASES


def mention_sentences(
    df: DataFrame, tokens: str, groups: dict[str, tuple[str, ...]] = GROUPS, seconds: Iterable[str] = AFTER_GROUP, basic: Iterable[str] = MENTIONS,
    split: Iterable[str] = SPLIT_PHRASES, least: int = 4,
) -> DataFrame:
    """The rows of df, sentences with arrays of tokens, that mention a group, with simplified (the lower-case text, phrases joined) and mentions, its different terms.

    Only sentences with one of the initial words are rewritten; those with fewer than `least` words afterwards are left out, as are null tokens. A scan
    without a shuffle: dictionaries are patterns and lists in the plan.
    """
    terms, first = mention_terms(groups, basic)
    lower = F.transform(F.filter(tokens, lambda x: x.isNotNull()), lambda x: F.lower(x))
    once = lambda x: F.explode(F.array(x))  # noqa: E731  (a column that later filters don't work out again)
    some = df.withColumn("lower_", lower).where(F.exists("lower_", lambda x: x.isin(first)))
    some = some.withColumn("simplified", once(fuse_mentions(F.array_join("lower_", " "), list(groups), seconds, split)))
    some = some.withColumn("words_", F.filter(F.split("simplified", r"\s+"), lambda x: x != "")).where(F.size("words_") >= least)
    found = F.array_distinct(F.filter("words_", lambda x: x.isin(terms) | is_compound(x, list(groups), seconds)))
    return some.withColumn("mentions", once(found)).where(F.size("mentions") > 0).drop("lower_", "words_")


def mention_counts(sentences: DataFrame, times: str | None = None) -> DataFrame:
    """(term, n): in how many sentences each term stands; times: how often a row's sentence is there."""
    return sentences.select(F.explode("mentions").alias("term"), (F.col(times) if times else F.lit(1)).alias("times_")).groupBy("term").agg(F.sum("times_").alias("n"))


def with_groups(sentences: DataFrame, tokens: str, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """sentences with groups, the names of the compared groups one of whose terms they hold, and words, the lower-case words after fusion."""
    groups = groups or compared_groups()
    text = fuse_american(F.array_join(F.transform(tokens, lambda x: F.lower(x)), " "))
    some = sentences.withColumn("words", F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    holds = [F.when(F.arrays_overlap("words", F.array(*map(F.lit, terms))), F.lit(name)) for name, terms in groups.items()]
    return some.withColumn("groups", F.array_compact(F.array(*holds)))
