"""Source divergence audit: how far the word use of sources lies apart within a language, and by which terms.

The first pass counts exactly in how many documents of its language each term stands and keeps the frequent ones. The second recounts every
occurrence of the kept terms, each padded with a delimiter on both sides, with an Aho-Corasick automaton a language. The kept terms are dealt to
blocks of bounded size, and each block is a scan of its own: its terms alone are sent to the workers. The counts, as sparse postings
(term, source, count), give all pairs of sources, by blocks of terms whose sums alone are shuffled, and the ranks of terms.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bytes_kit import CACHES, buffers, release_memory, slices, tidied
from lectern.llm.common import Scratch, checkpoint, col, map_arrow

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 10**9, 50
#: Entries of a task's counters, which are then emitted and begun anew.
MOST_COUNTED = 1 << 19
#: Bytes of the kept terms of a block; its automaton has at most a node a byte.
BLOCK_BYTES = 2 << 20
#: Postings of a bucket of terms, sources of a block, and cells of a matrix when pairs are summed.
BUCKET_ROWS, SOURCES, CELLS = 1 << 17, 256, 1 << 20

# Terms are runs of ASCII letters and of all that is not ASCII; any other byte becomes the delimiter, and A-Z become lower case.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_automata: dict[str, dict] = {}
CACHES.append(_automata.clear)


def _rows(counters: dict[tuple, Counter], names: int) -> pa.RecordBatch:
    keys = [[k[i] for k, c in counters.items() for _ in range(len(c))] for i in range(names)]
    terms = [t for c in counters.values() for t in c]
    counts = [n for c in counters.values() for n in c.values()]
    return pa.RecordBatch.from_arrays(
        [*[pa.array(k, pa.string()) for k in keys], pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=[f"c{i}" for i in range(names + 2)]
    )


def _counted(batches, names: int, count, most: int):
    """Batches of (names..., term, count) for batches of (names..., text): count(names, text, counter) adds what a text has; most: see MOST_COUNTED."""
    counters: dict[tuple, Counter] = {}
    for batch in batches:
        for low, n in slices(batch.column(names)):
            some = batch.slice(low, n)
            data, ends = buffers(some.column(names))
            raw = data.tobytes().translate(_LETTERS)
            keys = zip(*[some.column(i).to_pylist() for i in range(names)], strict=True)
            for key, a, b in zip(keys, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                mine = counters.get(key)
                if mine is None:
                    mine = counters[key] = Counter()
                count(key, raw[a:b], mine)
            if sum(map(len, counters.values())) > most:
                yield _rows(counters, names)
                counters = {}
    if counters:
        yield _rows(counters, names)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n_docs) of docs (lang, source, text) without nulls: in how many rows of the language the term stands."""

    most = MOST_COUNTED

    @tidied
    def run(batches):
        yield from _counted(batches, 1, lambda key, text, mine: mine.update(set(text.split())), most)

    partial = map_arrow(docs.select("lang", "text"), run, docs.sparkSession.createDataFrame([], "lang string, term string, n long").schema)
    return partial.groupBy("lang", "term").agg(F.sum("n").alias("n_docs"))


def _automaton(name: str, terms: list[tuple[str, str]]) -> dict:
    """By language the automaton of its padded terms; a worker keeps that of the last block."""
    import ahocorasick

    if name not in _automata:
        _automata.clear()
        made: dict = {}
        for lang, term in terms:
            if lang not in made:
                made[lang] = ahocorasick.Automaton()
            made[lang].add_word(f" {term} ", term)
        for a in made.values():
            a.make_automaton()
        _automata[name] = made
    return _automata[name]


def occurrences(docs: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, term, n): how often the kept terms (lang, term) stand in docs (lang, source, text), where at all; stored, block by block."""
    spark = docs.sparkSession
    total = kept.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    schema = spark.createDataFrame([], "lang string, source string, term string, n long").schema
    parts = []
    for block in range(blocks):
        mine = kept.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).select("lang", "term")
        terms, name = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()]), uuid.uuid4().hex

        def run(batches, terms=terms, name=name, most=MOST_COUNTED):
            for clear in CACHES:
                if clear != _automata.clear:
                    clear()
            automata = _automata.get(name) or _automaton(name, terms.value)

            def count(key, text, counter):
                a = automata.get(key[0])
                if a is not None:
                    counter.update(map(itemgetter(1), a.iter(f" {text.decode()} ")))

            try:
                yield from _counted(batches, 2, count, most)
            finally:
                release_memory()

        counts = map_arrow(docs.select("lang", "source", "text"), run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        parts.append(scratch.store(counts))
        terms.destroy()
    return reduce(DataFrame.unionAll, parts)


def _share(n: Column, total: Column, terms: Column, prior: int, scale: int) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * terms)), in whole numbers of up to 38 digits; null without terms."""
    whole = lambda c: c.cast("decimal(18,0)")
    over = whole(n + prior) * F.lit(scale).cast("decimal(18,0)")
    under = whole(F.when(terms > 0, total + prior * terms))
    return 1 + ((over - over % under) / under).cast("decimal(20,0)").cast("long")


def _pair_sums(sources: int, cells: int):
    """A function for groups of postings by bucket and two blocks of sources: sums of |p - p'| by pair over the terms of the bucket, less what each
    would add if neither source had it; bucket 0 adds that for all kept terms."""
    import pandas as pd

    def run(pdf):
        lang, bucket, one, two = pdf[["lang", "bucket", "one", "two"]].iloc[0]
        heads = pdf[pdf["term"].isna()].sort_values("place")
        place, zero, n_terms = heads["place"].to_numpy(np.int64), heads["zero"].to_numpy(np.int64), int(heads["n_terms"].iloc[0])
        rows = pdf[pdf["term"].notna()]
        term, _ = pd.factorize(rows["term"])
        at, p = np.searchsorted(place, rows["place"].to_numpy(np.int64)), rows["p"].to_numpy(np.int64)
        order = np.argsort(term, kind="stable")
        term, at, p = term[order], at[order], p[order]
        left, right = np.flatnonzero(place // sources == one), np.flatnonzero(place // sources == two)
        apart = np.abs(zero[left][:, None] - zero[right][None, :])
        sums = apart * n_terms if bucket == 0 else np.zeros_like(apart)
        step, n = max(1, cells // len(place)), int(term[-1]) + 1 if len(term) else 0
        for low in range(0, n, step):
            high = min(n, low + step)
            a, b = np.searchsorted(term, [low, high])
            table = np.tile(zero, (high - low, 1))
            table[term[a:b] - low, at[a:b]] = p[a:b]
            others = table[:, right]
            for k, g in enumerate(left):
                sums[k] += np.abs(others - table[:, [g]]).sum(axis=0)
            sums -= apart * (high - low)
        a, b = np.meshgrid(place[left], place[right], indexing="ij")
        use = a < b
        return pd.DataFrame({"lang": lang, "a": a[use], "b": b[use], "value": sums[use]})

    return run


def divergence(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_docs: int = LEAST_DOCS, prior: int = PRIOR, scale: int = SCALE, top: int = TOP,
) -> DataFrame:
    """lang, source, part, item, value, rank: by group (lang, source) all other sources of its language, farthest first, and its top terms.

    Terms are runs of ASCII letters, A-Z in lower case, and of characters beyond ASCII; a language keeps those in at least least_docs of its
    rows. With N occurrences of its V kept terms, a group gives a term with n occurrences p = 1 + floor(scale * (n + prior) / (N + prior * V)).
    Part pair: value is the sum of |p - q| over all kept terms, q the other source's. Part term: value is p - q, where above 0 and n > 0, q the
    whole language's. Ranks go by value, largest first, then by the item's bytes. Sums are exact.

    Null texts, languages and sources count as empty strings; a group without terms has its pairs, and one alone in its language has none. Rows that
    repeat count as often. Texts are read whole, whatever their length; an empty table gives an empty result; other columns play no part.
    """
    spark = df.sparkSession
    plain = lambda c, name: F.coalesce(col(c).cast("string"), F.lit("")).alias(name)
    docs = df.select(plain(lang_col, "lang"), plain(source_col, "source"), plain(text_col, "text"))
    with Scratch(spark) as scratch:
        kept = scratch.store(document_frequencies(docs).where(F.col("n_docs") >= least_docs))
        counts = occurrences(docs, kept, scratch)
        sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
        groups = docs.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        groups = groups.join(sizes, "lang", "left").na.fill(0, ["total", "n_terms"])
        groups = groups.withColumn("zero", F.coalesce(_share(F.lit(0), F.col("total"), F.col("n_terms"), prior, scale), F.lit(0)))
        groups = groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))
        groups = scratch.store(groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
        p = _share(F.col("n"), F.col("total"), F.col("n_terms"), prior, scale)
        whole = F.sum("n").over(Window.partitionBy("lang", "term"))
        postings = counts.withColumn("lang_n", whole).join(groups, ["lang", "source"])
        postings = scratch.store(postings.select("lang", "source", "place", "term", p.alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"), prior, scale).alias("q")))

        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        terms = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

        buckets = max(1, math.ceil(postings.count() / BUCKET_ROWS))
        most = groups.agg(F.max("place")).first()[0] or 0
        ends = F.sequence(F.lit(0), F.lit(int(most) // SOURCES))
        mine = F.floor(F.col("place") / SOURCES).cast("int")
        pair = F.transform(ends, lambda x: F.struct(F.least(x, mine).alias("one"), F.greatest(x, mine).alias("two")))
        dealt = ["lang", "bucket", F.inline(pair), "place", "zero", "n_terms", "term", "p"]
        heads = groups.withColumns({"bucket": F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))), "term": F.lit(None).cast("string"), "p": F.lit(0).cast("long")})
        rows = postings.withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), "zero": F.lit(0).cast("long"), "n_terms": F.lit(0).cast("long")})
        sums = heads.select(*dealt).unionByName(rows.select(*dealt)).groupBy("lang", "bucket", "one", "two").applyInPandas(_pair_sums(SOURCES, CELLS), "lang string, a int, b int, value long")
        sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        names = groups.select("lang", "place", "source")
        both = sums.select("lang", "value", F.inline(F.array(F.struct(F.col("a").alias("place"), F.col("b").alias("other")), F.struct(F.col("b").alias("place"), F.col("a").alias("other")))))
        both = both.join(names, ["lang", "place"]).join(names.withColumnsRenamed({"place": "other", "source": "item"}), ["lang", "other"])
        pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
        return checkpoint(pairs.unionByName(terms))
