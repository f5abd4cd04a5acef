"""Substring dedup: paragraphs and passages that repeat across documents, by MinHash banding.

A paragraph is a line of at least MIN_WORDS words; its set holds its distinct runs of five words.
BANDS bands of ROWS minima each let a pair of similarity 3/4 miss with probability
(1 - 0.75 ** ROWS) ** BANDS, about 1 in 9,000. Equal paragraphs are one node. Paragraphs that share a band are
verified on their whole sets (Jaccard similarity 3/4 or more), linked paragraphs form components,
and of a component that spans documents the first occurrence stays.

A passage is a run of PASSAGE words or more that documents share, whatever lines it lies in. All runs of PASSAGE
words have the least of their shorter shingles for a key, so equal runs meet under one key; only runs whose key
two documents have leave the scan, and what is equal there is joined to maximal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bytes_kit import buffers, mix64, order_within, powers, shingles, slices, tidied, words
from lectern.llm.common import Scratch, checkpoint, col, fresh
from lectern.llm.jaccard_join import distinct_shingles, sketches
from lectern.llm.linking import MET, id_filter, in_filter, link_components, meet_by_members, verified

SHINGLE, MIN_WORDS = 5, 40
BANDS, ROWS = 24, 4
NUM, DEN = 75, 100
#: Longs of a paragraph's parity sketch, which discards pairs before they are verified.
SKETCH_LONGS = 8
_SKETCH = [f"s{i}" for i in range(SKETCH_LONGS)]
PIECE = 1 << 20
#: Words of a passage; the least shingle of half as many is its key.
PASSAGE = 50
# Fixed value: the multiplier whose powers make the hash functions.
SPREAD = 0xDA942042E4DD58B5


class _Paragraphs:
    """The long lines of some texts: owner, number, place, and the distinct shingles."""

    def __init__(self, texts: pa.Array, size: int, min_words: int):
        data, ends = buffers(texts)
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([ends[:-1][np.diff(ends) > 0], breaks + 1])).astype(np.int64)
        starts = starts[starts < len(data)]
        owner = np.searchsorted(ends, starts, "right") - 1
        stops = np.append(starts[1:], len(data))
        closed = np.searchsorted(breaks, stops - 1)
        closed = (closed < len(breaks)) & (breaks[np.minimum(closed, max(len(breaks) - 1, 0))] == stops - 1) if len(breaks) else np.zeros(len(stops), bool)
        hashes, first, _, _ = words(data, ends)
        at = np.searchsorted(first, np.append(starts, len(data)))
        # Lines are numbered in their text, empty ones too: by the breaks before them.
        number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, ends[:-1][owner])
        long = np.flatnonzero(np.diff(at) >= min_words)
        self.owner, self.number, self.n_words = owner[long], number[long], np.diff(at)[long]
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.start = chars[starts[long]] - chars[ends[:-1][self.owner]]
        self.n_chars = chars[(stops - closed)[long]] - chars[starts[long]]
        self.low, self.high = starts[long], (stops - closed)[long]  # bytes
        pick = np.concatenate([np.arange(at[i], at[i + 1]) for i in long]) if len(long) else np.zeros(0, np.int64)
        flat, bounds = shingles(hashes[pick], np.concatenate([[0], np.cumsum(self.n_words)]), size)
        whose = np.repeat(np.arange(len(long)), np.diff(bounds))
        self.node = mix64(np.add.reduceat(mix64(flat ^ mix64((np.arange(len(flat)) - bounds[whose]).astype(np.uint64))), bounds[:-1]) + self.n_words.astype(np.uint64)).view(np.int64) if len(long) else np.zeros(0, np.int64)
        order = order_within(whose, flat)
        flat, whose = flat[order], whose[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (whose[1:] != whose[:-1])
        self.flat = flat[new]
        self.at = np.searchsorted(whose[new], np.arange(len(long) + 1))


def _bands(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key for each set and band."""
    out = np.empty((len(at) - 1, BANDS), np.uint64)
    turns = powers(SPREAD, BANDS * ROWS + 1)[1:]
    for b in range(BANDS):
        key = np.full(len(at) - 1, mix64(np.array([b], np.uint64))[0])
        for r in range(ROWS):
            turned = flat * turns[b * ROWS + r]
            turned ^= turned >> np.uint64(32)
            key = mix64(key ^ np.minimum.reduceat(turned * np.uint64(0x9FB21C651E98DF25), at[:-1]))
        out[:, b] = key
    return out


def _listed(size: int, min_words: int):
    kinds = pa.schema([(c, pa.int64()) for c in ("id", "t", "para_no", "start", "n_chars", "n_words", "node", "n", *_SKETCH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(1), PIECE):
                found = _Paragraphs(batch.column(1).slice(start, n), size, min_words)
                ids, t = (batch.column(c).slice(start, n).take(pa.array(found.owner)) for c in (0, 2))
                rest = (found.number, found.start, found.n_chars, found.n_words, found.node, np.diff(found.at), *sketches(found.flat, found.at, SKETCH_LONGS).T)
                yield pa.RecordBatch.from_arrays([ids, t, *[pa.array(np.ascontiguousarray(x, np.int64)) for x in rest]], schema=kinds)

    return tidied(run), ", ".join(f"{c} long" for c in kinds.names)


def _keyed(size: int, min_words: int):
    kinds = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(0, np.int64)  # of this batch: a frequent paragraph is sent once a batch
            for start, n in slices(batch.column(1), PIECE):
                found = _Paragraphs(batch.column(1).slice(start, n), size, min_words)
                if not len(found.node):
                    continue
                nodes, where = np.unique(found.node, return_index=True)
                fresh = ~np.isin(nodes, seen)
                nodes, where = nodes[fresh], where[fresh]
                seen = np.union1d(seen, nodes)
                if not len(nodes):
                    continue
                sizes = np.diff(found.at)[where]
                at = np.concatenate([[0], np.cumsum(sizes)])
                flat = found.flat[np.repeat(found.at[where] - at[:-1], sizes) + np.arange(at[-1])]
                keys = _bands(flat, at)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(nodes, BANDS))], schema=kinds)

    return tidied(run), "key long, id long"


def _packed(size: int, min_words: int, needed):
    """The needed paragraphs, compressed, once a batch."""
    kinds = pa.schema([("id", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            done = np.zeros(0, np.int64)
            for start, n in slices(batch.column(1), PIECE):
                texts = batch.column(1).slice(start, n)
                found = _Paragraphs(texts, size, min_words)
                nodes, where = np.unique(found.node, return_index=True)
                fresh = in_filter(needed.value, nodes) & ~np.isin(nodes, done)
                nodes, where = nodes[fresh], where[fresh]
                done = np.union1d(done, nodes)
                raw = buffers(texts)[0]
                blobs = [pack(raw[found.low[i] : found.high[i]].tobytes()) for i in where]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(blobs, pa.binary())], schema=kinds)

    return tidied(run), "id long, blob binary"


def repeated_paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """The occurrences of paragraphs that repeat across documents, kept and removed ones.

    (id_col, para_no, start, n_chars, n_words, cluster, keep_id, keep_para_no, removed): a line is
    numbered from 0; start and n_chars count code points. Long texts are read whole; further columns of df, whatever their names, play no part. cluster names the component. The occurrence with the smallest id, then line, stays. Lines of fewer words, texts without lines of
    that length, null texts and rows without id take no part, nor do paragraphs that repeat within one document
    only. Rows that repeat an id are one document. An empty table gives an empty result. Ids are integers.
    """
    if min_words < size:
        raise ValueError("a paragraph needs the words of a shingle at least")
    with Scratch(df.sparkSession) as scratch:
        return _paragraphs(df, id_col, text_col, size, min_words, scratch).drop("t").withColumnRenamed("id", id_col)


def _paragraphs(df: DataFrame, id_col: str, text_col: str, size: int, min_words: int, scratch: Scratch) -> DataFrame:
    """The rows of repeated_paragraphs() with the hash `t` of the text that each stands in, as texts may share an id."""
    docs = df.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).where("id is not null")
    run, schema = _listed(size, min_words)
    listed = scratch.store(docs.withColumn("t", F.xxhash64("text")).mapInArrow(run, schema))
    nodes = scratch.store(listed.groupBy(F.col("node").alias("id")).agg(*[F.first(c).alias(c) for c in ("n", *_SKETCH)], F.min("id").alias("doc"), F.max("id").alias("last")))
    run, schema = _keyed(size, min_words)
    keyed = docs.mapInArrow(run, schema)
    met = scratch.store(keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(tidied(meet_by_members), MET), release=True)

    def linked(pairs: DataFrame) -> DataFrame:
        context = df.sparkSession.sparkContext
        needed = context.broadcast(id_filter(pairs.select(F.explode(F.array("u", "v")).alias("id")), "id"))
        run, schema = _packed(size, min_words, needed)
        texts = scratch.store(docs.mapInArrow(run, schema).groupBy("id").agg(F.first("blob").alias("blob")))
        return verified(pairs, texts, lambda some: distinct_shingles(some, size), NUM, DEN)

    found = link_components(met, nodes.select("id", "n", *_SKETCH), _SKETCH, linked, scratch, NUM, DEN)
    named = nodes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = named.groupBy("component").agg(F.min("doc").alias("doc"), F.max("last").alias("last")).where("doc < last").select("component")
    member = named.join(spread, "component", "left_semi").select(F.col("id").alias("node"), "component")
    rows = listed.drop("n", *_SKETCH).join(member, "node")
    # Stored, so that the join below reads two plain exchanges, of which Spark can split a hot component's.
    kept = scratch.store(rows.groupBy("component").agg(F.min(F.struct("id", "para_no")).alias("keep")))
    rows = rows.join(kept, "component")
    out = checkpoint(
        rows.select(
            "id", "t", "para_no", "start", "n_chars", "n_words", F.lower(F.hex("component")).alias("cluster"),
            F.col("keep.id").alias("keep_id"), F.col("keep.para_no").alias("keep_para_no"),
            ((F.col("id") != F.col("keep.id")) | (F.col("para_no") != F.col("keep.para_no"))).alias("removed"),
        )
    )
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, min_words: int = MIN_WORDS, passage: int | None = None) -> DataFrame:
    """df with the removed paragraphs, and passages of `passage` words if given, taken out of its texts; other rows, null texts and rows without id as they are.

    What is left before, between and after them stands on lines of its own, a line break at a cut goes with it; empty lines elsewhere stay. A row loses spans of
    its own text, also where other rows have its id; rows that repeat id and text lose the same. A text is cut in one task, whatever its length. An
    empty table gives an empty result. df may have columns of any name.
    """
    id_, t, gone = fresh(df, "id_", "t_", "gone_")
    spans = ["id", "t", "start", (F.col("start") + F.col("n_chars")).alias("stop")]
    with Scratch(df.sparkSession) as scratch:
        lines = _paragraphs(df, id_col, text_col, size, min_words, scratch).where("removed").select(*spans)
        found = lines if passage is None else lines.unionByName(_passages(df, id_col, text_col, passage, scratch).where("removed").select(*spans))
    along = Window.partitionBy("id", "t").orderBy("start", "stop")
    begins = F.coalesce(F.col("start") > F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    islands = found.withColumn("begins", begins).withColumn("island", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("id", "t", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    cuts = whole.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts")).toDF(id_, t, gone)
    keyed = df.withColumns({id_: col(id_col).cast("long"), t: F.xxhash64(col(text_col).cast("string"))})
    n, text = F.size(col(gone)), col(text_col)

    def rest(i):
        low, high = F.when(i > 0, F.get(col(gone), i - 1)["stop"]).otherwise(0), F.when(i < n, F.get(col(gone), i)["start"]).otherwise(F.char_length(text))
        piece = F.substr(text, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
        inside = (i > 0) & (i < n)
        told = F.when(inside, ~piece.isin("", "\n")).otherwise(piece != "")
        return F.when(told, F.regexp_replace(piece, F.when(inside, r"\A\n|\n\z").when(i > 0, r"\A\n").otherwise(r"\n\z"), F.lit("")))

    left = F.array_join(F.array_compact(F.transform(F.sequence(F.lit(0), n), rest)), "\n")
    out = F.when(col(gone).isNull(), text).otherwise(left)
    return keyed.join(cuts, [id_, t], "left").select(*[out.alias(c) if c == text_col else col(c) for c in df.columns])


def remove_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without what repeated_pieces() calls removed, paragraphs and passages; all else as remove_repeats()."""
    return remove_repeats(df, id_col, text_col, passage=PASSAGE)


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the run of size words at each place that has so many after it, texts' ends ignored."""
    n = max(len(hashes) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for i, m in enumerate(powers(0xD6E8FEB86659FD93, size + 1)[1:]):
        out += hashes[i : i + n] * m
    return mix64(out)


class _Runs:
    """The runs of `size` words of some texts: owner, first word, key and hash, in order."""

    def __init__(self, texts: pa.Array, size: int, anchor: int):
        self.data, self.ends = buffers(texts)
        hashes, self.first, self.stop, self.words_at = words(self.data, self.ends)
        grams = _rolled(hashes, size)
        owner = np.searchsorted(self.words_at, np.arange(len(grams)), "right") - 1
        self.word = np.flatnonzero(np.arange(len(grams)) + size <= self.words_at[owner + 1])
        self.owner, self.gram = owner[self.word], grams[self.word]
        least, width, span = _rolled(hashes, anchor), size - anchor + 1, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if len(grams) and span < width:
            least = np.minimum(least[: len(grams)], least[width - span : width - span + len(grams)])
        self.key = least[self.word].view(np.int64)
        fresh = np.ones(len(self.word), bool)  # where a stretch of neighbours with one key begins
        fresh[1:] = (self.key[1:] != self.key[:-1]) | (self.owner[1:] != self.owner[:-1])
        self.heads = np.flatnonzero(fresh)


def _run_keys(size: int, anchor: int):
    kinds = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(1), PIECE):
                found = _Runs(batch.column(1).slice(start, n), size, anchor)
                ids = batch.column(0).slice(start, n).take(pa.array(found.owner[found.heads]))
                yield pa.RecordBatch.from_arrays([pa.array(found.key[found.heads]), ids], schema=kinds)

    return tidied(run), "key long, id long"


def _stretches(size: int, anchor: int, needed):
    """Neighbouring runs with one key that other documents may have: their hashes, and where each begins and ends."""
    kinds = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("t", pa.int64()), ("word", pa.int64()), ("runs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(1), PIECE):
                found = _Runs(batch.column(1).slice(start, n), size, anchor)
                stops = np.append(found.heads[1:], len(found.word))
                hit = in_filter(needed.value, found.key[found.heads])
                heads, stops = found.heads[hit], stops[hit]
                owner, base = found.owner[heads], found.ends[:-1][found.owner]
                breaks = np.flatnonzero(found.data == 10)
                chars = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
                low, high = found.first[found.word], found.stop[found.word + size - 1]
                line = np.searchsorted(breaks, low) - np.searchsorted(breaks, base)
                short = (found.gram >> np.uint64(32)).astype(np.uint32).view(np.int32)
                told = np.stack([short, chars[low] - chars[base], chars[high] - chars[base], line], axis=1).astype(np.int32)
                blobs = [told[a:b].tobytes() for a, b in zip(heads, stops, strict=True)]
                # t tells texts apart that share an id: their words are counted from each one's own beginning.
                ids, t = (batch.column(c).slice(start, n).take(pa.array(owner)) for c in (0, 2))
                place = pa.array(found.word[heads] - found.words_at[owner])
                yield pa.RecordBatch.from_arrays([pa.array(found.key[heads]), ids, t, place, pa.array(blobs, pa.binary())], schema=kinds)

    return tidied(run), "key long, id long, t long, word long, runs binary"


_SPAN = ["id", "t", "low", "high", "start", "stop", "line"]
_KEEP = ["keep_id", "keep_t", "keep_low", "keep_start", "keep_stop", "keep_line"]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From stretches sorted by key, id, t and word: spans of neighbouring runs, each with its first occurrence, where that is another one."""
    names = [*_SPAN, *_KEEP]

    def whole(rows: pa.Table):
        key, ids, t, word = (rows.column(c).to_numpy() for c in range(4))
        blobs = rows.column(4).to_pylist()
        told = np.frombuffer(b"".join(blobs), np.int32).reshape(-1, 4)
        sizes = np.array([len(b) >> 4 for b in blobs], np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = word[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        gram = mix64(key.view(np.uint64)[row] ^ told[:, 0].view(np.uint32).astype(np.uint64))
        order = np.argsort(gram, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]]))
        counts = np.diff(np.append(heads, len(order)))
        first, last = order[heads], order[heads + counts - 1]
        keep, spread = np.empty(len(order), np.int64), np.empty(len(order), bool)
        keep[order] = np.repeat(first, counts)
        spread[order] = np.repeat(ids[row[first]] != ids[row[last]], counts)
        own = (ids[row] == ids[row[keep]]) & (t[row] == t[row[keep]]) & (place == place[keep])
        at = np.flatnonzero(spread & ~own)
        if not len(at):
            return
        on = (at[1:] == at[:-1] + 1) & (row[at[1:]] == row[at[:-1]]) & (keep[at[1:]] == keep[at[:-1]] + 1) & (row[keep[at[1:]]] == row[keep[at[:-1]]])
        a, b = at[np.concatenate([[True], ~on])], at[np.concatenate([~on, [True]])]
        ka, kb = keep[a], keep[b]
        out = (ids[row[a]], t[row[a]], place[a], place[b] + 1, told[a, 1], told[b, 2], told[a, 3], ids[row[ka]], t[row[ka]], place[ka], told[ka, 1], told[kb, 2], told[ka, 3])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=names)

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        last = int(np.searchsorted(rows.column(0).to_numpy(), rows.column(0)[-1].as_py()))
        if last:
            yield from whole(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None and held.num_rows:
        yield from whole(held)


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PASSAGE) -> DataFrame:
    """The columns of repeated_paragraphs() for the runs of `size` words or more that documents share, across and inside lines.

    Words are equal, white space and the case of A-Z aside. Every run of `size` words has a first occurrence: the smallest id, then place; what these
    cover in a document, as maximal spans of words, stays, a row each. Other occurrences are removed: a row is a maximal span of words whose runs
    have first occurrences in one span that stays, which cluster names. So a text that repeats a few words throughout is one row, not one a word.
    Each word of a run that documents share is in a row. para_no is the line that a span begins in; start and n_chars count code points from the
    text's beginning; keep_id and keep_para_no are those of the span that stays. Spans of one document may overlap where they belong to different
    clusters. Runs that repeat within one document only, null and shorter texts and rows without id give nothing, nor does an empty table. Rows that
    repeat an id are one document; its ids are integers. Long texts are read whole; further columns of df, whatever their names, play no part.
    """
    with Scratch(df.sparkSession) as scratch:
        return _passages(df, id_col, text_col, size, scratch).drop("t").withColumnRenamed("id", id_col)


def _islands(spans: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """spans with island, a number by group for spans whose runs follow each other without a gap."""
    along = Window.partitionBy(*by).orderBy(low, high)
    begins = F.coalesce(F.col(low) > F.max(high).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    return spans.withColumn("begins", begins).withColumn("island", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")


def _passages(df: DataFrame, id_col: str, text_col: str, size: int, scratch: Scratch) -> DataFrame:
    anchor = size - size // 2
    docs = df.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).where("id is not null")
    run, schema = _run_keys(size, anchor)
    shared = scratch.store(docs.mapInArrow(run, schema).groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key"))
    # The filter passes a few more keys than needed, or, where very many are shared, all: rows more, but no others found.
    needed = df.sparkSession.sparkContext.broadcast(id_filter(shared, "key"))
    run, schema = _stretches(size, anchor, needed)
    order = ["key", "id", "t", "word"]
    spans = docs.withColumn("t", F.xxhash64("text")).mapInArrow(run, schema).repartition("key").sortWithinPartitions(*order)
    spans = scratch.store(spans.mapInArrow(tidied(_repeats), ", ".join(f"{c} long" for c in [*_SPAN, *_KEEP])), release=True)

    # What stays: the first occurrences, each once, as maximal spans of their documents.
    kept_at = ["keep_id", "keep_t"]
    first = spans.select(*_KEEP, (F.col("keep_low") + F.col("high") - F.col("low")).alias("keep_high")).groupBy(*kept_at, "keep_low").agg(
        F.max("keep_high").alias("keep_high"), *[F.max(c).alias(c) for c in ("keep_start", "keep_stop", "keep_line")]
    )
    first = scratch.store(_islands(first, kept_at, "keep_low", "keep_high"))
    stay = first.groupBy(*kept_at, "island").agg(
        *[F.min(c).alias(c) for c in ("keep_low", "keep_start", "keep_line")], F.max("keep_high").alias("keep_high"), F.max("keep_stop").alias("keep_stop")
    )
    stay = scratch.store(stay.withColumn("n_words", F.col("keep_high") - F.col("keep_low") + size - 1))

    # What goes: spans by the span that stays, merged where their runs follow each other.
    mine = [*kept_at, "kept"]
    named = spans.join(first.select(*kept_at, "keep_low", F.col("island").alias("kept")), [*kept_at, "keep_low"])
    gone = _islands(named.select("id", "t", *mine, "low", "high", "start", "stop", "line"), ["id", "t", *mine], "low", "high")
    gone = gone.groupBy("id", "t", *mine, "island").agg(*[F.min(c).alias(c) for c in ("low", "start", "line")], F.max("high").alias("high"), F.max("stop").alias("stop"))
    gone = gone.withColumn("n_words", F.col("high") - F.col("low") + size - 1).drop("island")
    gone = gone.join(stay.select(*kept_at, F.col("island").alias("kept"), "keep_low", "keep_line"), mine)
    name = F.lower(F.hex(F.xxhash64("keep_id", "keep_t", "keep_low")))

    def rows(found: DataFrame, own: str, removed: bool) -> DataFrame:
        return found.select(
            F.col(f"{own}id").alias("id"), F.col(f"{own}t").alias("t"), F.col(f"{own}line").alias("para_no"), F.col(f"{own}start").alias("start"),
            (F.col(f"{own}stop") - F.col(f"{own}start")).alias("n_chars"), "n_words", name.alias("cluster"), "keep_id", F.col("keep_line").alias("keep_para_no"), F.lit(removed).alias("removed"),
        )

    out = checkpoint(rows(gone, "", True).unionByName(rows(stay, "keep_", False)))
    needed.unpersist()
    return out


def repeated_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated paragraphs, then passages, told apart by kind. Both may cover the same words. Nulls, empty and long texts, rows that repeat, empty
    tables and names as in repeated_paragraphs() and repeated_passages()."""
    lines, passages = repeated_paragraphs(df, id_col, text_col), repeated_passages(df, id_col, text_col)
    return lines.withColumn("kind", F.lit("paragraph")).unionByName(passages.withColumn("kind", F.lit("passage")))
