import random
import re

from pyspark.sql import functions as F

from lectern.functions import phrases
from lectern.operators import mentions
from lectern.vocab import AFTER_GROUP, GROUPS, MENTIONS, SPLIT_PHRASES


def in_turn(text, order):
    """Each phrase replaced after the other, as dictionaries in any order give them."""
    for s in SPLIT_PHRASES:
        text = text.replace(s, s.replace(" ", ""))
    names = phrases.american(GROUPS)
    for g in order(names):
        text = text.replace(g + " american", g + "american")
    for g in order([*GROUPS, *[n + "american" for n in names]]):
        for p in order(list(AFTER_GROUP)):
            if g + " " + p in text:
                text = text.replace(g + " " + p, g + p)
    return text


def made(draw):
    some = [*GROUPS, *AFTER_GROUP, "american", "americans", "latin", "central", "middle", "eastern", "born", "displaced", "asylum", "seeker", "seekers", "manager", "the", "of", "xgerman", "peoples", "foreigner"]
    near = [*list(GROUPS)[:14], "american", "foreign", "born", "people", "persons", "worker", "workers", "man"]
    return [" ".join(draw.choice(draw.choice([some, near])) for _ in range(draw.randrange(0, 14))) for _ in range(150)]


def test_fused_text_equals_replacement_in_turn(spark):
    draw = random.Random(6)
    texts = [*made(draw), "", "  mexican  workers ", "mexican american workers german", "german american man of latin american women", "foreign born people"]
    shuffled = lambda words: draw.sample(words, len(words))
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", phrases.fuse_mentions(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [in_turn(t, shuffled) for t in texts] and sum(a != b for a, b in zip(got, texts, strict=True)) > 100
    assert phrases.compound_pairs() == 18_532


def test_trie_patterns_match_their_words_only():
    words = ["a", "ab", "abc", "b.c", "bcd", "mexican", "mexicans"]
    pattern = re.compile(phrases.trie_pattern(words) + "$")
    assert [w for w in [*words, "", "abcd", "bxc", "mexic"] if pattern.match(w)] == words
    assert phrases.shortest(["man", "manager", "men", "m", "x"]) == ["m", "x"]


def test_mention_sentences(spark):
    rows = [(1, "The Mexican American workers left town".split()), (2, "Foreign born persons came here".split()), (3, "he saw trees and rivers".split()), (4, ["aliens", "came"]), (5, None),
            (6, "German farmers and German children spoke".split()), (7, "Aliens and aliens of Latin American women , and Germans".split()), (8, [None, "aliens", "came", "here", "again"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    out = {r.id: (r.simplified, sorted(r.mentions)) for r in mentions.mention_sentences(df, "tokens").collect()}
    assert out == {
        1: ("the mexicanamericanworkers left town", ["mexicanamericanworkers"]),
        6: ("german farmers and germanchildren spoke", ["germanchildren"]), 7: ("aliens and aliens of latinamericanwomen , and germans", ["aliens", "germans", "latinamericanwomen"]),
        8: ("aliens came here again", ["aliens"]),
    }  # fmt: skip  # 2 has three words after fusion, 3 no initial word, 4 too few
    counts = {r.term: r.n for r in mentions.mention_counts(mentions.mention_sentences(df, "tokens")).collect()}
    assert counts["aliens"] == 2 and counts["germanchildren"] == 1


def test_every_pairs_value_is_a_compound(spark):
    firsts = [*GROUPS, *[g + "american" for g in phrases.american(GROUPS)]]
    values = [g + p for g in firsts for p in sorted(set(AFTER_GROUP))]
    df = spark.createDataFrame([(v,) for v in [*values, *MENTIONS, "mexican", "workers", "xmexicanworkers", "the"]], "t string")
    yes = {r.t for r in df.where(phrases.is_compound(F.col("t"))).collect()}
    assert set(values) <= yes and not yes & {"mexican", "workers", "xmexicanworkers", "the", *MENTIONS} - {"foreignborn"}


def test_groups_that_are_compared(spark):
    rows = [(1, "The Irish-American workers and Mexicans".split()), (2, "a Scottish American man".split()), (3, "Chinamen or Celestials".split()), (4, "trees".split()), (5, "the Scots Americans".split()), (6, None)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    got = {r.id: (r.groups, r.words) for r in mentions.with_groups(df, "tokens").collect()}
    assert got[1] == (["European", "Hispanic", "Mexican"], ["the", "irishamerican", "workers", "and", "mexicans"])
    assert got[2][0] == ["European"] and got[2][1] == ["a", "scottishamerican", "man"] and got[3][0] == ["Chinese"] and got[4][0] == []
    assert got[5] == (["European"], ["the", "scots", "americans"])  # a plural takes no american


def test_equal_sentences_count_as_often_as_they_are_there(spark):
    from pyspark.sql import functions as F

    from lectern.operators import mentions

    said = ["The mexican families came in", "The mexican families came in", "an immigrant of the town", "nobody else was there", None]
    df = spark.createDataFrame([(x,) for x in said], "said string")
    split = lambda d: mentions.mention_sentences(d.withColumn("tokens", F.split("said", " ")), "tokens")
    each = {r.term: r.n for r in mentions.mention_counts(split(df)).collect()}
    once = mentions.mention_counts(split(df.groupBy("said").agg(F.count(F.lit(1)).alias("times"))), "times")
    assert {r.term: r.n for r in once.collect()} == each and 2 in each.values()
