"""Phrases of two words written as one, by whole dictionaries: firsts times seconds.

All pairs of a pass are one pattern, factored as a trie of letters, so that its size and the work at a place follow the words, not their pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.vocab import AFTER_GROUP, CHINESE_TERMS, EUROPEAN_COUNTRIES, GROUPS, HISPANIC_TERMS, MENTIONS, MEXICAN_TERMS, NATIONALITIES, SPLIT_PHRASES


def trie_pattern(words: Iterable[str]) -> str:
    """A pattern for any of the words, in which words that begin alike share their beginning."""
    trie: dict = {}
    for w in words:
        node = trie
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [re.escape(c) + written(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        one = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
        return one if "" not in node else f"(?:{one})?"

    return written(trie)


def shortest(words: Iterable[str]) -> list[str]:
    """The words that begin with no other of them."""
    kept: list[str] = []
    for w in sorted(set(words)):
        if not (kept and w.startswith(kept[-1])):
            kept.append(w)
    return kept


def join_words(text: Column, firsts: Iterable[str], seconds: Iterable[str], between: str = " ") -> Column:
    """Text without the space (or one of the signs `between`) between any of `firsts` and any of `seconds`, wherever they stand.

    Equal to replacing `first second` by `firstsecond` pair by pair, in any order, as long as no first is made only by such a replacement. A second is
    looked for after each space, by the shortest seconds, and only then a first before it.
    """
    firsts, seconds = sorted(set(firsts)), shortest(seconds)
    if not firsts or not seconds:
        return text
    gap = f"[{re.escape(between)}]"
    return F.regexp_replace(text, f"{gap}(?={trie_pattern(seconds)})(?<=(?:{'|'.join(map(re.escape, firsts))}){gap})", "")


def american(groups: Iterable[str]) -> list[str]:
    """The groups that form a name with `american`: those that don't hold it already."""
    return [g for g in groups if "american" not in g]


def compound_pairs(groups: Iterable[str] = tuple(GROUPS), seconds: Iterable[str] = AFTER_GROUP) -> int:
    """How many pairs the last pass joins."""
    groups = list(groups)
    return (len(groups) + len(american(groups))) * len(set(seconds))


def fuse_mentions(text: Column, groups: Iterable[str] = tuple(GROUPS), seconds: Iterable[str] = AFTER_GROUP, split: Iterable[str] = SPLIT_PHRASES) -> Column:
    """Lower-case tokens, joined by spaces, after three passes: split phrases; a group and `american`; a group, plain or american, and a term after it."""
    groups = list(groups)
    for phrase in split:
        text = F.replace(text, F.lit(phrase), F.lit(phrase.replace(" ", "")))
    hyphened = american(groups)
    text = join_words(text, hyphened, ["american"])
    return join_words(text, [*groups, *[g + "american" for g in hyphened]], seconds)


def mention_terms(groups: dict[str, tuple[str, ...]] = GROUPS, basic: Iterable[str] = MENTIONS) -> tuple[list[str], list[str]]:
    """(terms, initial): words that are mentions by themselves, the groups' nouns among them; words one of which a sentence must hold to be looked at."""
    hyphened = american(groups)
    terms = [*basic, *[x for nouns in groups.values() for x in nouns], *[g + "americans" for g in hyphened]]
    first = ["latin", "central", "middle", *basic, *groups, *[x for nouns in groups.values() for x in nouns], *[g + x for g in hyphened for x in ("american", "americans")]]
    return list(dict.fromkeys(terms)), list(dict.fromkeys(first))


def is_compound(token: Column, groups: Iterable[str] = tuple(GROUPS), seconds: Iterable[str] = AFTER_GROUP) -> Column:
    """Whether a token is a group, plain or american, joined to a term after it: the pairs' values, by one pattern."""
    groups = list(groups)
    return token.rlike(f"^{trie_pattern([*groups, *[g + 'american' for g in american(groups)]])}{trie_pattern(seconds)}$")


def hyphenable(nationality: str) -> list[str]:
    """The lower-case words of a nationality that stand before `american`: its first, and others that are no plurals or men."""
    first, *rest = NATIONALITIES[nationality]
    return [w.lower() for w in (first, *[x for x in rest if not x.endswith(("s", "men", "man"))])]


def compared_groups() -> dict[str, list[str]]:
    """The terms of the groups that are compared; European ones are the countries, their nationalities, and these as one word with american(s)."""
    european = {x for c in EUROPEAN_COUNTRIES for x in (c.lower(), *[n.lower() for n in NATIONALITIES[c]], *[h + a for h in hyphenable(c) for a in ("american", "americans")])}
    return {"Chinese": list(CHINESE_TERMS), "European": sorted(european), "Hispanic": list(HISPANIC_TERMS), "Mexican": list(MEXICAN_TERMS)}


def fuse_american(text: Column) -> Column:
    """Lower-case text with each nationality and a following american, after a space or a hyphen, as one word."""
    return join_words(text, [h for c in NATIONALITIES for h in hyphenable(c)], ["american"], " -")
