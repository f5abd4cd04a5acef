"""N-gram Jaccard join by parity sketches.

A set's parity sketch flips, for each of its shingles, one bit that the shingle's hash names; equal
shingles of two sets cancel, so the Hamming distance of their sketches is at most their symmetric
difference D. Sets of sizes a <= b with Jaccard similarity >= 3/4 have D <= (a + b) / 7.

Candidates. Sizes fall into bands [2^l, 2^(l+1)); a pair meets in the band of its smaller set. In a band
the sketch has 2^(l+1) blocks, very wide and sparse, each kept as one 64-bit XOR of its shingles'
hashes. At most D blocks differ, so sets with over D non-empty blocks share one. Of a set's
blocks the D + 1 rarest are enough, in an order that all sets share (the prefix principle): shared
passages are left out as long as anything rarer is there. The order needs no exact counts, so a bounded list of
the most frequent shingles makes it. A set with too few non-empty blocks also meets by single shingles.

Links. Sets that meet are first linked to the smallest of those they meet. A narrow sketch of
1024 bits discards pairs by its Hamming distance; the others are verified on whole sets. Only where
sets that met are still in different components are pairs between these components tried, the
likeliest first, larger sets by a sketch that grows with them too. Thus the components are those of all links, though no group is expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytes_kit import buffers, mix64, order_within, shingles, slices, tidied, words
from lectern.llm.common import Scratch, checkpoint, col, fresh
from lectern.llm.exact_dedup import winners
from lectern.llm.linking import MET, id_filter, in_filter, link_components, meet_by_members, sharper, verified

SHINGLE = 5
#: Similarity of at least NUM / DEN; the bounds in this module hold for 3 / 4 and above.
NUM, DEN = 75, 100
SKETCH_LONGS = 16
#: Sets from this size on also have a sketch that grows with them: 4 to 8 bits for each shingle, as the narrow one has at least for smaller sets.
WIDE_FROM = 256
#: The most frequent shingles that order the blocks: what is broadcast has at most so many rows.
MOST_FREQUENT = 1 << 18
#: Digests with more than this share of the rows are settled by a broadcast of 1/SUPPORT rows.
SUPPORT = 0.001
PIECE = 1 << 20


def distinct_shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, flat, and the offsets by text."""
    data, ends = buffers(texts)
    hashes, _, _, at = words(data, ends)
    flat, at = shingles(hashes, at, size)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = order_within(owner, flat)
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    flat, owner = flat[new], owner[new]
    return flat, np.searchsorted(owner, np.arange(len(texts) + 1))


def _per_text(flat: np.ndarray, at: np.ndarray, reduce: np.ufunc, empty: int) -> np.ndarray:
    out = np.full(len(at) - 1, empty, np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = reduce.reduceat(flat, at[:-1][some])
    return out


def sketches(flat: np.ndarray, at: np.ndarray, longs: int) -> np.ndarray:
    """Parity sketches of 64 * longs bits, a row of longs each; so many rows at a time that the bits' counts stay small."""
    n, bits = len(at) - 1, 64 * longs
    out = np.zeros((n, longs), np.int64)
    step = max(1, (1 << 18) // bits)
    for low in range(0, n, step):
        high = min(n, low + step)
        owner = np.repeat(np.arange(high - low), np.diff(at[low : high + 1]))
        flips = np.bincount(owner * bits + (flat[at[low] : at[high]] % np.uint64(bits)).astype(np.int64), minlength=(high - low) * bits)
        out[low:high] = np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(np.int64).reshape(high - low, longs)
    return out


def wide_sketches(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """For sets that the narrow sketch is too small for: parity sketches of 2 ** (band + 2) bits."""
    out: list[bytes | None] = [None] * (len(at) - 1)
    for i in np.flatnonzero(np.diff(at) >= WIDE_FROM):
        bits = 4 << int(_band(np.array([at[i + 1] - at[i]]))[0])
        flips = np.bincount((flat[at[i] : at[i + 1]] % np.uint64(bits)).astype(np.int64), minlength=bits)
        out[i] = np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()
    return pa.array(out, pa.binary())


class _Frequent:
    """The most frequent shingles of a task, by counters that lose at most what they share when full."""

    def __init__(self, most: int = MOST_FREQUENT):
        self.most, self.keys, self.counts = most, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray) -> None:
        keys, counts = np.unique(flat, return_counts=True)
        again = (counts > 1) | np.isin(keys, self.keys, assume_unique=True)
        keys = np.concatenate([self.keys, keys[again]])
        counts = np.concatenate([self.counts, counts[again]])
        self.keys, where = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(where, weights=counts).astype(np.int64)
        if len(self.keys) > self.most:
            keep = np.argpartition(self.counts, -self.most)[-self.most :]
            keep.sort()
            self.keys, self.counts = self.keys[keep], self.counts[keep]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _summarise(size: int):
    names = ["id", "n", "digest", *[f"s{i}" for i in range(SKETCH_LONGS)], "shingle", "freq"]
    kinds = pa.schema([*[(c, pa.int64()) for c in names], ("wide", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _Frequent()
        for batch in batches:
            for start, n in slices(batch.column(1), PIECE):
                part = batch.slice(start, n)
                flat, at = distinct_shingles(part.column(1), size)
                frequent.add(flat)
                digest = _digest(flat, at)
                sketch = sketches(flat, at, SKETCH_LONGS)
                columns = [part.column(0), pa.array(np.diff(at)), pa.array(_signed(digest)), *[pa.array(sketch[:, i].copy()) for i in range(SKETCH_LONGS)]]
                nothing = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, nothing, nothing, wide_sketches(flat, at)], schema=kinds)
        nothing = pa.nulls(len(frequent.keys), pa.int64())
        yield pa.RecordBatch.from_arrays([nothing] * (3 + SKETCH_LONGS) + [pa.array(_signed(frequent.keys)), pa.array(frequent.counts), pa.nulls(len(frequent.keys), pa.binary())], schema=kinds)

    return tidied(run), ", ".join(f"{c} long" for c in names) + ", wide binary"


def _band(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1


def _keys(flat: np.ndarray, at: np.ndarray, band: np.ndarray, most: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the most + 1 rarest blocks of each text in its band; a negative `most`: none."""
    n_texts = len(at) - 1
    owner = np.repeat(np.arange(n_texts), np.diff(at))
    live = most[owner] >= 0
    flat, owner = flat[live], owner[live]
    if not len(flat):
        return owner, flat
    mixed = mix64(flat ^ mix64(band.astype(np.uint64) + np.uint64(0x51ED))[owner])
    block = ((mixed >> np.uint64(32)) * (np.uint64(2) << band[owner].astype(np.uint64))) >> np.uint64(32)
    place = (owner.astype(np.uint64) << np.uint64(32)) | block
    order = np.argsort(place)
    place = place[order]
    heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    signature = np.bitwise_xor.reduceat(mix64(mixed[order] + np.uint64(1)), heads)
    weight = np.minimum.reduceat(_weights(flat, keys, weights)[order], heads).astype(np.uint64)
    text = (place[heads] >> np.uint64(32)).astype(np.int64)
    key = mix64(signature ^ mix64(((place[heads] & np.uint64(0xFFFFFFFF)) << np.uint64(6)) | band[text].astype(np.uint64)))
    by_rarity = order_within(text, (weight << np.uint64(56)) | (key >> np.uint64(8)))
    text, key = text[by_rarity], key[by_rarity]
    rank = np.arange(len(text)) - np.searchsorted(text, np.arange(n_texts))[text]
    chosen = rank <= most[text]
    short = (np.bincount(text, minlength=n_texts) <= most)[owner]
    singles = mix64(mixed[short] + np.uint64(7))  # too few non-empty blocks for the bound: these meet by single shingles too
    return np.concatenate([text[chosen], owner[short]]), np.concatenate([key[chosen], singles])


def _weights(flat: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(flat), np.uint8)
    spot = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
    return np.where(keys[spot] == flat, weights[spot], np.uint8(0))


def _bounds(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each size's band, its largest D there, and its largest D in the band below (-1: no partner is there)."""
    band = _band(np.maximum(n, 1))
    own = (DEN - NUM) * (n + n * DEN // NUM) // (DEN + NUM)
    low = np.left_shift(1, band)
    below = np.where(-(-n * NUM // DEN) < low, (DEN - NUM) * (n + np.minimum(n, low - 1)) // (DEN + NUM), -1)
    return band, np.where(n > 0, own, -1), np.where(n > 0, below, -1)


def _emit_keys(size: int, frequent, settled):
    kinds = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights = frequent.value
        digests, kept = settled.value
        for batch in batches:
            for start, n in slices(batch.column(1), PIECE):
                part = batch.slice(start, n)
                ids = part.column(0)
                flat, at = distinct_shingles(part.column(1), size)
                digest = _digest(flat, at)
                usable = ~ids.is_null().to_numpy(zero_copy_only=False)
                number = ids.fill_null(0).to_numpy(zero_copy_only=False)
                if len(digests):
                    spot = np.minimum(np.searchsorted(digests, digest), len(digests) - 1)
                    usable &= ~((digests[spot] == digest) & (kept[spot] != number))
                band, own, below = _bounds(np.diff(at))
                for level, most in ((band, own), (np.maximum(band - 1, 0), below)):
                    text, key = _keys(flat, at, level, np.where(usable, most, -1), keys, weights)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(key)), pa.array(number[text])], schema=kinds)

    return tidied(run), "key long, id long"


def _digest(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix64(_per_text(mix64(flat), at, np.add, 0) ^ mix64(np.diff(at).astype(np.uint64)))


def _packed(needed):
    kinds = pa.schema([("id", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids = batch.column(0)
            hit = ~ids.is_null().to_numpy(zero_copy_only=False) & in_filter(needed.value, ids.fill_null(0).to_numpy(zero_copy_only=False))
            some = batch.filter(pa.array(hit))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([pack((t or "").encode()) for t in some.column(1).to_pylist()], pa.binary())], schema=kinds)

    return tidied(run), "id long, blob binary"


_SKETCH = [f"s{i}" for i in range(SKETCH_LONGS)]


def _linked(pairs: DataFrame, docs: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) that link, by their whole sets. Only texts that the pairs may need leave the scan."""
    context = docs.sparkSession.sparkContext
    needed = context.broadcast(id_filter(pairs.select(F.explode(F.array("u", "v")).alias("id")), "id"))
    run, schema = _packed(needed)
    texts = scratch.store(docs.mapInArrow(run, schema))
    return verified(pairs, texts, lambda some: distinct_shingles(some, size), NUM, DEN)


def _most_frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and their weights: at most MOST_FREQUENT, cut off at a frequency that a histogram gives."""
    level = F.floor(F.log2("freq") * 8).cast("int")
    room, cut = MOST_FREQUENT, None
    for row in counted.where("freq > 1").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        room -= row["count"]
        if room < 0:
            break
        cut = row["level"]
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    top = counted.where((F.col("freq") > 1) & (level >= cut)).toArrow()  # as columns: rows as objects are many times larger
    keys = top["shingle"].to_numpy().view(np.uint64)
    weights = np.clip(8 * np.log2(top["freq"].to_numpy().astype(np.float64)), 1, 255).astype(np.uint8)
    order = np.argsort(keys)
    return keys[order], weights[order]


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of df.

    Words are runs without white space, A-Z in lower case; a set holds the distinct runs of `size`
    words, or the whole text if it has fewer words. Texts without words, and null texts, have an empty
    set and link with nothing. component_id is the smallest id reachable by links of similarity
    3/4 or more. Rows that repeat an id are one node. A row without id links with nothing and has a
    null component_id. Ids are integers. Texts are compared whole, however long; equal texts are one class. An empty table gives an empty
    result. Further columns of df, whatever their names, play no part.
    """
    with Scratch(df.sparkSession) as scratch:
        return _components(df, id_col, text_col, size, scratch)


def _components(df: DataFrame, id_col: str, text_col: str, size: int, scratch: Scratch) -> DataFrame:
    spark = df.sparkSession
    docs = df.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))

    run, schema = _summarise(size)
    seen = scratch.store(docs.mapInArrow(run, schema))
    summary = seen.where("n is not null")
    counted = scratch.store(seen.where("shingle is not null").groupBy("shingle").agg(F.sum("freq").alias("freq")))
    frequent = spark.sparkContext.broadcast(_most_frequent(counted))

    live = summary.where("n > 0 and id is not null")
    heavy = scratch.store(winners(live.select("id", "digest"), "id", "digest", SUPPORT).select("digest", "keep_id"))
    alike = heavy.toArrow()
    digests = alike["digest"].to_numpy().view(np.uint64)
    order = np.argsort(digests)
    settled = spark.sparkContext.broadcast((digests[order], alike["keep_id"].to_numpy()[order]))

    tagged = live.select("id", "n", "digest").join(F.broadcast(heavy), "digest", "left")
    light = tagged.where("keep_id is null").drop("keep_id")
    classes = light.groupBy("digest").agg(F.min("id").alias("rep"))
    columns = ["id", "rep", "n"]
    info = light.join(classes, "digest").select(columns).unionByName(tagged.where("keep_id is not null").withColumnRenamed("keep_id", "rep").select(columns))
    alone = summary.where("n = 0 or id is null").withColumn("rep", F.col("id")).select(columns)
    info = scratch.store(info.unionByName(alone))
    nodes = live.join(F.broadcast(heavy), "digest", "left").where("keep_id is null or keep_id = id").select("id", "n", *_SKETCH)

    run, schema = _emit_keys(size, frequent, settled)
    keyed = docs.mapInArrow(run, schema)
    met = scratch.store(keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(tidied(meet_by_members), MET), release=True)

    found = link_components(
        met, nodes, _SKETCH, lambda pairs: _linked(pairs, docs, size, scratch), scratch, NUM, DEN,
        info.select("id", "rep").distinct(), lambda pairs: sharper(pairs, live.select("id", "n", "wide"), scratch, NUM, DEN),
    )
    done = info.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    out = checkpoint(done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")))
    frequent.unpersist()
    settled.unpersist()
    return out


def keep_one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows of df whose id is the smallest of their component, and those without id. Null and empty texts stay.

    Rows that repeat an id stay or go together. An empty table gives an empty result. df may have columns of any name.
    """
    found = jaccard_components(df, id_col, text_col, size)
    (name,) = fresh(df, "gone")
    gone = found.where(F.col("component_id") != col(id_col)).select(col(id_col).alias(name)).distinct()
    return df.join(gone, col(id_col).cast("long") == col(name), "left_anti")
