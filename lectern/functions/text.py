"""Text functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.vocab import FUSED_LEMMAS, MISREAD_THE, Keywords

#: The 32 ASCII punctuation signs, as a character class.
PUNCTUATION = "[" + re.escape(string.punctuation).replace("'", "\\'") + "]"


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def simplify_text(x: Column) -> Column:
    """No punctuation, lower case, one space between words."""
    return F.regexp_replace(F.lower(strip(F.regexp_replace(x, PUNCTUATION, ""))), r"\s+", " ")


def normalize_text(x: Column) -> Column:
    """Contractions, possessives, O' names and hyphens within words joined up."""
    for pattern, new in (
        (r"'(s|m|d|t|ll|re|ve)", "$1"),
        (r"s'\s", "s "),
        (r"o'(?=[a-z])", "o"),
        (r"O'(?=[A-Z])", "O"),
        (r"(?<=[a-zA-Z0-9])-(?=[a-zA-Z0-9])", ""),
    ):
        x = F.regexp_replace(x, pattern, new)
    return x


def words(x: Column) -> Column:
    """The runs without white space."""
    return F.array_remove(F.split(x, r"\s+"), "")


def token_count(x: Column) -> Column:
    return F.size(words(x)).cast("long")


def strip_prefix(x: Column, prefix: Column) -> Column:
    """What follows the prefix and one more sign, stripped; null where the text begins otherwise."""
    return F.when(F.startswith(x, prefix), strip(F.substr(x, F.length(prefix) + 2)))


def comma_to_period(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.replace(t, F.lit(","), F.lit(".")))


def zero_pad(x: Column, width: int) -> Column:
    """Zeros in front up to the width; longer values stay whole."""
    x = x.cast("string")
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, "0"))


def id_to_session(x: Column) -> Column:
    """The session an id begins with: three digits after a leading 1, else two; null for other ids."""
    return F.when(F.startswith(x, F.lit("1")), F.substring(x, 1, 3)).otherwise(F.substring(x, 1, 2)).try_cast("int")


def speech_of_segment(x: Column) -> Column:
    """A segment's id without its last part."""
    return F.regexp_replace(x, "_[^_]*$", "")


def repair_prefix(x: Column) -> Column:
    """A misread `The` at the start put right, four-letter forms first."""
    fixed = F.concat(F.lit("The "), strip(F.regexp_replace(x, "^(?:" + "|".join(MISREAD_THE) + ")", "")))
    return F.when(x.rlike("^(?:" + "|".join(MISREAD_THE) + ")"), fixed).otherwise(x)


def canonical_title(x: Column) -> Column:
    """Officers' titles in one form: spaces, the vice president, pro tempore, hyphens."""
    x = F.array_join(words(x), " ")
    x = F.when(F.get(F.split(x, " "), F.lit(1)).startswith("VICE"), F.lit("The VICE PRESIDENT")).otherwise(x)
    bare = strip(F.regexp_replace(x, "(pro tempore|protempore)$", ""))
    x = F.when(x.rlike("(pro tempore|protempore)$"), F.concat(bare, F.lit(" pro tempore"))).otherwise(x)
    x = F.when(x.isin("The PRESIDENT", "The ACTING PRESIDENT"), F.concat(x, F.lit(" pro tempore"))).otherwise(x)
    return F.replace(x, F.lit("-"), F.lit(" "))


def pairs(tokens: Column, between: str = " ") -> Column:
    """Each element with the next."""
    left = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.zip_with(left, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(between), b))


#: Stands before each token where tokens are searched as one text.
_MARK = "\u0001"


def keyword_match(tokens: Column, keywords: Keywords, stem: str | None = "immig") -> Column:
    """Whether lower-cased tokens hold a keyword; one pattern over the joined tokens.

    A prefix of k letters matches a token that begins so, or is shorter and equal to it; up to seven letters,
    tokens whose first seven letters are excluded don't count.
    """
    ends = f"(?:{_MARK}|$)"

    def first(k: int, some) -> list[str]:
        """Patterns for the tokens whose first k letters are one of these."""
        return [re.escape(p) + ("" if len(p) == k else f"(?={ends})") for p in sorted(some) if len(p) <= k]

    def prefixes(lengths: list[int]) -> list[str]:
        return [x for k in lengths for x in first(k, keywords.prefixes[k])]

    whole = [re.escape(w) for w in sorted(keywords.unigrams)] + [re.escape(w).replace("\\ ", _MARK) for w in sorted(keywords.bigrams)]
    short, excluded = prefixes([k for k in sorted(keywords.prefixes) if k <= 7]), first(7, keywords.exclude)
    ways = [f"(?:{'|'.join(whole)})(?={ends})"] if whole else []
    ways += prefixes([k for k in sorted(keywords.prefixes) if k > 7])
    if short:
        ways.append((f"(?!{'|'.join(excluded)})" if excluded else "") + f"(?:{'|'.join(short)})")
    found = [f"{_MARK}(?:{'|'.join(ways)})"] if ways else []
    found += [re.escape(stem)] if stem else []
    if not found:
        return F.lit(False)
    return F.coalesce(F.concat(F.lit(_MARK), F.array_join(tokens, _MARK)).rlike("|".join(found)) & (F.size(tokens) > 0), F.lit(False))


def fuse_phrases(x: Column, firsts: list[str], seconds: list[str], between: str = "[ -]") -> Column:
    """`first second` and `first-second` written as one word, by one alternation, longest first."""
    alt = lambda ws: "|".join(re.escape(w) for w in sorted(ws, key=lambda w: (-len(w), w)))
    return F.regexp_replace(x, f"({alt(firsts)}){between}({alt(seconds)})", "$1$2")


def replace_phrases(x: Column, phrases: dict[str, str]) -> Column:
    """Phrases replaced one after the other, in order."""
    for old, new in phrases.items():
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def tagged_lemmas(lemmas: Column, tags: Column) -> Column:
    """`lemma (t)`: the lemma and its tag's first letter, both lower-case."""
    return F.zip_with(lemmas, tags, lambda x, t: F.concat(F.lower(x), F.lit(" ("), F.lower(F.substring(t, 1, 1)), F.lit(")")))


def append_fused(lemmas: Column, fused: dict[str, str] = FUSED_LEMMAS) -> Column:
    """The lemmas, then the fused form of each neighbouring pair that has one."""
    named = F.create_map(*[F.lit(x) for kv in fused.items() for x in kv])
    return F.concat(lemmas, F.array_compact(F.transform(pairs(lemmas), lambda p: F.try_element_at(named, p))))


#: Tokens that n-grams and cleaning may be held to.
KEPT_TOKENS = {"alpha": r"^\p{L}+$", "alnum": "[a-zA-Z0-9]"}


def counted(tokens: Column) -> Column:
    """The distinct tokens with their numbers, as (term, n): the tokens are sorted and cut where they change, so that no row leaves its task to be counted."""

    def cut(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

    def runs(s: Column, at: Column) -> Column:
        return F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n")))

    # Arrays of one element name what is used several times: else it is worked out for each token.
    each = F.transform(F.array(F.sort_array(tokens)), lambda s: F.transform(F.array(cut(s)), lambda at: runs(s, at))[0])[0]
    return F.when(F.size(tokens) > 0, each)


def ngrams(tokens: Column, n: int, keep: str | None = None) -> Column:
    """n-grams joined by `_`; keep='alpha': all tokens alphabetic, 'alnum': each holds an ASCII letter or digit."""
    count = F.size(tokens) - (n - 1)
    if not keep:
        # Parts are named by their place and joined at once, without an array for each; the array of one element names the tokens, which else are worked out each time.
        joined = F.transform(F.array(tokens), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws("_", *[F.get(w, i + j) for j in range(n)])))[0]
        return F.when(count > 0, joined).otherwise(F.array().cast("array<string>"))
    grams = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))
    pattern = KEPT_TOKENS[keep]
    grams = F.filter(grams, lambda g: F.forall(g, lambda t: t.rlike(pattern)))
    return F.transform(grams, lambda g: F.array_join(g, "_"))


def clean_tokens(tokens: Column, stopwords: list[str] = (), keep: str | None = None) -> Column:
    """Tokens that begin with a letter, digit or one of #$!?%" ; digits as #, stopwords and others as `_`, `_` inside as `-`.

    keep holds what is then left to letters ('alpha') or to tokens with an ASCII letter or digit ('alnum').
    """
    stop = list(stopwords) or [""]

    def clean(t: Column) -> Column:
        kept = F.regexp_replace(F.replace(t, F.lit("_"), F.lit("-")), "[0-9]", "#")
        dropped = F.lower(t).isin(*stop) | ~t.rlike(r'^[a-zA-Z0-9#$!?%"]')
        if keep:
            dropped = dropped | ~kept.rlike(KEPT_TOKENS[keep])
        return F.when(dropped, F.lit("_")).otherwise(kept)

    return F.transform(tokens, clean)


def domain_features(tokens: Column, domain: Column) -> Column:
    """The tokens, and each with the first ten letters of its domain."""
    return F.concat(tokens, F.transform(tokens, lambda t: F.concat(t, F.lit("__"), F.substring(domain, 1, 10))))


def surname(x: Column) -> Column:
    """The last word before ` of `, without punctuation, in capitals, accents folded."""
    plain = F.translate(x, "áàâäãéèêëíìîïóòôöõúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    return F.upper(F.regexp_replace(F.element_at(words(F.substring_index(plain, " of ", 1)), -1), PUNCTUATION, ""))


def short_name(x: Column) -> Column:
    """Names with ` of ` by their first two and last two words."""
    w = words(x)
    return F.when(x.contains(" of "), F.concat_ws(" ", F.slice(w, 1, 2), F.slice(w, -2, 2))).otherwise(x)


def alpha_words(tokens: Column, stopwords: list[str]) -> Column:
    return F.transform(F.filter(tokens, lambda t: t.rlike(r"^\p{L}+$") & ~F.lower(t).isin(*stopwords)), F.lower)


def collapse_pieces(x: Column) -> Column:
    """Word pieces that begin with ## joined to the piece before."""
    return F.replace(x, F.lit(" ##"), F.lit(""))


def mask_word(x: Column, word: str, mask: str = "[MASK]") -> Column:
    return F.regexp_replace(collapse_pieces(x), rf"(?<![^\s]){re.escape(word)}(?![^\s])", re.escape(mask).replace("\\[", "[").replace("\\]", "]"))


def sentences(x: Column) -> Column:
    """Sentences end at . ! or ? before white space; no model is needed."""
    return F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: s != "")


def tokens(x: Column) -> Column:
    """Words and single signs."""
    return F.regexp_extract_all(x, F.lit(r"(\w+|[^\w\s])"), 1)


def join_sentences(sents: Column) -> Column:
    """Tokens joined by spaces, sentences too."""
    return F.array_join(F.transform(sents, lambda s: F.array_join(s, " ")), " ")


def retokenize_possessives(tokens: Column, tags: Column) -> Column:
    """A token 's that is tagged POS, unless first, joined to the one before."""
    both = F.arrays_zip(tokens.alias("t"), tags.alias("g"))
    # A possessive becomes a mark that the join removes together with the space before it.
    joined = F.array_join(F.transform(both, lambda x, i: F.concat(F.when((x["g"] == "POS") & (x["t"] == "'s") & (i > 0), F.lit("\u0001")).otherwise(F.lit("")), x["t"])), "\u0002")
    return F.split(F.replace(joined, F.lit("\u0002\u0001"), F.lit("")), "\u0002")


def nouns(tokens: Column, tags: Column) -> Column:
    """The tokens whose tag begins with N."""
    return F.transform(F.filter(F.arrays_zip(tokens.alias("t"), tags.alias("g")), lambda x: F.startswith(x["g"], F.lit("N"))), lambda x: x["t"])


def comma_list(x: Column) -> Column:
    """The parts between commas as they stand; an empty string has one empty part."""
    return F.split(x, ",")


def join_trailing(sents: Column) -> Column:
    """Each text with a space after it, joined and stripped at both ends: inner white space stays as it is."""
    return strip(F.array_join(F.transform(sents, lambda x: F.concat(x, F.lit(" "))), ""))


def zip_map(keys: Column, values: Column) -> Column:
    """A map of keys to values by place; of a key that comes again the last value counts, keys without a value or null are left out."""
    entries = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    keep = F.filter(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))), lambda e: F.array_max(F.transform(entries, lambda x, j: F.when(x["k"] == e["k"], j))) == e["i"])
    return F.map_from_entries(F.transform(keep, lambda e: F.struct(e["k"], e["v"])))
