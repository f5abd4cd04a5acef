"""From rows that share a key to the components of all their links, without expanding a group into pairs.

The rows of a key meet its smallest member only; pairs that link make first components. Then, only
where members of one key are still in different components, the pairs between these are tried. Every pair
that shares a key and links is thus within one component.

Groups with the same members count once. In a group only rows outside its largest component are compared, with
all others of a size that allows a link, by their parity sketches; what is left of them is tried against a sharper sketch, then verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bytes_kit import mix64, tidied
from lectern.llm.common import Scratch
from lectern.llm.components import components

MET = "a long, b long, big boolean"
#: Bits of the filter that picks the rows a comparison may need: a megabyte, however many ids there are.
FILTER_BITS = 1 << 23


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for each place that an id of the column has; other ids may share places."""
    x = F.col(column)
    place = x.bitwiseXOR(F.shiftrightunsigned(x, 23)).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    maps = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    bits = np.zeros(FILTER_BITS, bool)
    for row in maps.collect():
        some = np.unpackbits(np.frombuffer(row["m"], np.uint8), bitorder="little").astype(bool)
        bits[(row["k"] - 1) * len(some) : row["k"] * len(some)] = some
    return bits


def in_filter(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    return bits[((x ^ (x >> np.uint64(23))) & np.uint64(FILTER_BITS - 1)).astype(np.int64)]


def verified(pairs: DataFrame, texts: DataFrame, sets, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose sets have a similarity of num / den or more.

    texts: (id, blob), compressed texts, which are smaller than their sets; sets(array of texts) gives the sorted
    sets, flat, and their offsets. Blobs meet by sort-merge joins at every size: the smaller side may be large.
    """
    import zstandard

    kinds = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    right, left = texts.withColumnsRenamed({"id": "v", "blob": "y"}), texts.withColumnsRenamed({"id": "u", "blob": "x"})
    both = pairs.join(right.hint("merge"), "v").join(left.hint("merge"), "u").select("u", "v", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                n = part.num_rows
                some = [unpack(b) for c in (2, 3) for b in part.column(c).to_pylist()]
                flat, at = sets(pa.array(some, pa.binary()).cast(pa.string()))
                shared = np.array([len(np.intersect1d(flat[at[i] : at[i + 1]], flat[at[n + i] : at[n + i + 1]], assume_unique=True)) for i in range(n)], np.int64)
                sizes = np.diff(at)
                hit = pa.array(shared * den >= (sizes[:n] + sizes[n:] - shared) * num)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(hit), part.column(1).filter(hit)], schema=kinds)

    return both.mapInArrow(tidied(run), "u long, v long").distinct()
#: Rows of one key that are held back to compare whole groups; longer groups are passed on in pieces.
HELD = 1 << 20


def meet_by_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """meet() with groups named by their members, so that those with the same members are one; one that is too large to be held, by its key."""
    return meet(batches, by_members=True)


def meet(batches: Iterator[pa.RecordBatch], by_members: bool = False) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and id: (a, b, false), b met a, the smallest of its group; (key, b, true): b is in a group of three or more."""
    seen: set[int] = set()
    held_key, held_id, open_key, open_first = np.zeros(0, np.int64), np.zeros(0, np.int64), None, None

    def rows(a, b, big):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), big))], names=["a", "b", "big"])

    def whole(key, ids):
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(heads, len(key)))
        first = np.repeat(ids[heads], sizes)
        other = first != ids
        pairs = np.unique(np.stack([first[other], ids[other]], axis=1), axis=0)
        yield rows(pairs[:, 0].copy(), pairs[:, 1].copy(), False)
        members = mix64(np.add.reduceat(mix64(ids.view(np.uint64)), heads) + sizes.astype(np.uint64)).view(np.int64)
        new = np.zeros(len(heads), bool)
        for g in np.flatnonzero(sizes >= 3):
            if int(members[g]) not in seen:
                seen.add(int(members[g]))
                new[g] = True
        if len(seen) > 1 << 20:
            seen.clear()
        pick = np.repeat(new, sizes)
        yield rows((np.repeat(members, sizes) if by_members else key)[pick], ids[pick], True)

    for batch in batches:
        key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if open_key is not None:
            more = int(np.searchsorted(key, open_key, "right"))
            some = np.unique(ids[:more])
            yield rows(np.full(len(some), open_first), some, False)
            yield rows(np.full(len(some), open_key), some, True)
            key, ids = key[more:], ids[more:]
            if not len(key):
                continue
            open_key = None
        key, ids = np.concatenate([held_key, key]), np.concatenate([held_id, ids])
        if not len(key):
            continue
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids = key[fresh], ids[fresh]
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield from whole(key[:last], ids[:last])
        held_key, held_id = key[last:], ids[last:]
        if len(held_key) > HELD:
            open_key, open_first = held_key[0], held_id[0]
            yield rows(np.full(len(held_id) - 1, open_first), held_id[1:], False)
            yield rows(held_key, held_id, True)
            held_key, held_id = held_key[:0], held_id[:0]
    if len(held_key):
        yield from whole(held_key, held_id)


#: Rows of one key's largest component that are compared in one task; larger groups are cut into chunks, to each of which the group's other rows go.
CHUNK = 1 << 12
#: Rows that are compared at a time, and pairs of them.
BLOCK, PAIRS = 1 << 15, 1 << 18


def _differ(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows a[i], b[j] that differ in at most so many bits, and in how many; most pairs are given up early."""
    at, bits = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k in range(0, a.shape[1], 4):
        apart = a[i[at], k : k + 4] ^ b[j[at], k : k + 4]
        bits = bits + np.bitwise_count(apart.view(np.uint64)).sum(axis=1, dtype=np.int64)
        fits = bits <= most[at]
        at, bits = at[fits], bits[fits]
    return at, bits


def _most(both: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sets of sizes m and n with similarity num / den differ in at most (den - num)(m + n) / (den + num) elements, their parity sketches in at most as many bits."""
    return both * (den - num) // (den + num)


def _possible(n_sketch: int, num: int, den: int):
    """Of pairs (u, v) with both sides' (n, sketch...) those that may link."""
    kinds = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            m, n = columns[:, 2], columns[:, 3 + n_sketch]
            columns = columns[np.minimum(m, n) * den >= np.maximum(m, n) * num]
            both = columns[:, 2] + columns[:, 3 + n_sketch]
            every = np.arange(len(columns))
            at, _ = _differ(columns[:, 3 : 3 + n_sketch], every, columns[:, 4 + n_sketch :], every, _most(both, num, den))
            yield pa.RecordBatch.from_arrays([pa.array(columns[at, c].copy()) for c in (0, 1)], schema=kinds)

    return run


def _sharper(num: int, den: int):
    """Of pairs (u, v) with both sides' (n, wide) those that may link: a wide sketch of twice the size is folded to the other's."""
    kinds = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def longs(found: pa.Array, at: np.ndarray, size: int) -> np.ndarray:
        return np.frombuffer(b"".join(found.take(pa.array(at)).to_pylist()), np.int64).reshape(len(at), size // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(c).fill_null(0).to_numpy() for c in (2, 4))
            sizes = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy() for c in (3, 5)]
            low, high = np.minimum(*sizes), np.maximum(*sizes)
            good = (low == 0) | ((high != low) & (high != 2 * low))
            for p, q in {(int(p), int(q)) for p, q in zip(*(s[~good] for s in sizes), strict=True)}:
                some = np.flatnonzero((sizes[0] == p) & (sizes[1] == q))
                for at in np.array_split(some, max(1, len(some) * (p + q) >> 24)):
                    x, y = longs(batch.column(3), at, p), longs(batch.column(5), at, q)
                    x, y = (w if w.shape[1] * 8 == min(p, q) else w[:, : w.shape[1] // 2] ^ w[:, w.shape[1] // 2 :] for w in (x, y))
                    every = np.arange(len(at))
                    good[at[_differ(x, every, y, every, _most(m[at] + n[at], num, den))[0]]] = True
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in (0, 1)], schema=kinds)

    return run


def sharper(pairs: DataFrame, nodes: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """The pairs (u, v) that may link by the wide sketches of nodes (id, n, wide or null), of which only those that are needed leave the scan."""
    needed = pairs.sparkSession.sparkContext.broadcast(id_filter(pairs.select(F.explode(F.array("u", "v")).alias("id")), "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(needed.value, batch.column(0).to_numpy())))

    some = scratch.store(nodes.mapInArrow(tidied(run), "id long, n long, wide binary"))
    for side in ("u", "v"):
        pairs = pairs.join(some.withColumnsRenamed({"id": side, "n": f"n_{side}", "wide": f"w_{side}"}).hint("merge"), side)
    return scratch.store(pairs.select("u", "v", "n_u", "w_u", "n_v", "w_v").mapInArrow(tidied(_sharper(num, den)), "u long, v long").distinct())


def _across(num: int, den: int, best: bool):
    """(u, v, part): pairs of rows in different components of a group that may link.

    From rows (bucket, i, j, side, id, component, n, sketch...), sorted by bucket, i and j, which name a piece of a group. Side 0: of the group's largest
    component; of the others 1 meet all of the piece, 2 only those of side 3. best: where a row has many likely partners in a component, the likeliest
    one only; part says so.
    """
    kinds = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("part", pa.bool_())])

    def compare(block):
        new = np.concatenate([[True], (block[1:, :3] != block[:-1, :3]).any(axis=1)])
        piece = np.cumsum(new) - 1
        order = np.lexsort((block[:, 6], piece))
        block, piece = block[order], piece[order]
        side, ids, component, n = (block[:, k].copy() for k in (3, 4, 5, 6))
        sketch = block[:, 7:]
        # A row's partners are those of its piece whose size is near its own: a range of the order.
        place = (piece << 40) | n
        low = np.searchsorted(place, (piece << 40) | -(-n * num // den))
        high = np.searchsorted(place, (piece << 40) | (n * den // num), "right")
        first = np.flatnonzero((side == 1) | (side == 2))
        ends = np.cumsum(high[first] - low[first])
        starts = 0
        while starts < len(first):
            stop = max(starts + 1, int(np.searchsorted(ends, (ends[starts - 1] if starts else 0) + PAIRS, "right")))
            some = first[starts:stop]
            width = high[some] - low[some]
            i = np.repeat(some, width)
            j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low[some], width)
            starts = stop
            fits = (component[i] != component[j]) & ((side[j] == 0) | (side[j] == 3) | ((side[j] == 1) & (ids[i] < ids[j])))
            fits &= np.where(side[i] == 2, side[j] == 3, side[j] != 3)
            i, j = i[fits], j[fits]
            both = n[i] + n[j]
            at, bits = _differ(sketch, i, sketch, j, _most(both, num, den))
            i, j, far = i[at], j[at], bits / np.maximum(both[at], 1)
            part = np.zeros(len(i), bool)
            if best and len(i):
                order = np.lexsort((ids[j], far, component[j], i))
                i, j = i[order], j[order]
                head = np.concatenate([[True], (i[1:] != i[:-1]) | (component[j[1:]] != component[j[:-1]])])
                heads = np.flatnonzero(head)
                many = np.diff(np.append(heads, len(i))) > FEW
                keep = head | ~np.repeat(many, np.diff(np.append(heads, len(i))))
                part = np.repeat(many, np.diff(np.append(heads, len(i))))[keep]
                i, j = i[keep], j[keep]
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            yield np.stack([a, b, part.astype(np.int64)], axis=1)

    def told(found):
        rows = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy()), pa.array(rows[:, 2] > 0)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, found = [], 0, []
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            waiting += batch.num_rows
            if waiting < BLOCK:
                continue
            block = np.concatenate(held)
            edges = np.flatnonzero((block[1:, :3] != block[:-1, :3]).any(axis=1))
            last = int(edges[-1]) + 1 if len(edges) else 0
            if last:
                found += compare(block[:last])
            held, waiting = [block[last:]], len(block) - last
            if sum(map(len, found)) > PAIRS:
                yield told(found)
                found = []
        if waiting:
            found += compare(np.concatenate(held))
        yield told(found)

    return run


#: A row tries so many partners of one component at once.
FEW = 2


def link_components(
    met: DataFrame,
    nodes: DataFrame,
    sketch: list[str],
    linked: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    num: int,
    den: int,
    stand_ins: DataFrame | None = None,
    sharper: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(id, component) for the nodes that link.

    met: what meet() gives. nodes: (id, n, parity sketch in longs). linked(pairs (u, v)) gives those that link.
    stand_ins: (id, rep), the node that an id stands for. sharper(pairs): those that may link by a larger sketch.

    What is joined grows with the input, so joins are sort-merge joins at every size.
    """
    stars = met.where("not big").select("a", "b").distinct()
    if stand_ins is not None:
        for side in ("a", "b"):
            stars = stars.join(stand_ins.withColumnsRenamed({"id": side, "rep": f"r{side}"}).hint("merge"), side).drop(side).withColumnRenamed(f"r{side}", side)
    stars = stars.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    told = ["n", *sketch]
    for side in ("u", "v"):
        stars = stars.join(nodes.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in told]).hint("merge"), side)
    stars = stars.select("u", "v", *[f"{side}_{c}" for side in ("u", "v") for c in told])
    tried = scratch.store(stars.mapInArrow(tidied(_possible(len(sketch), num, den)), "u long, v long").distinct())
    passed = sharper or (lambda pairs: pairs)
    links = scratch.store(linked(passed(tried)), release=True)
    found = scratch.store(components(links))

    groups = met.where("big").select(F.col("a").alias("bucket"), F.col("b").alias("id"))
    if stand_ins is not None:
        groups = groups.join(stand_ins.hint("merge"), "id").select("bucket", F.col("rep").alias("id"))
    groups = groups.distinct()
    # The first round tries the likeliest pairs, the second, where a row had several likely partners in a component and still isn't in it, all.
    for best in (True, False):
        groups = groups.join(found.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        groups = scratch.store(groups)
        sizes = groups.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
        mixed = sizes.groupBy("bucket").agg(F.max(F.struct("m", "component")).alias("most"), F.count(F.lit(1)).alias("k"), F.sum("m").alias("m")).where("k > 1")
        mixed = mixed.select("bucket", F.col("most.component").alias("largest"), F.col("most.m").alias("inside"), (F.col("m") - F.col("most.m")).alias("outside"))
        apart = groups.join(mixed.hint("merge"), "bucket")
        spread = apart.select("bucket", "id", "component", F.explode(_pieces()).alias("p")).select("bucket", "p.*", "id", "component")
        spread = spread.join(nodes.select("id", *told).hint("merge"), "id").select("bucket", "i", "j", "side", "id", "component", *told)
        order = ["bucket", "i", "j"]
        likely = spread.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidied(_across(num, den, best)), "u long, v long, part boolean")
        likely = scratch.store(likely.groupBy("u", "v").agg(F.max("part").alias("part")))
        more = not likely.where("part").isEmpty()
        rest = scratch.store(likely.select("u", "v").join(tried.hint("merge"), ["u", "v"], "left_anti"))
        if not rest.isEmpty():
            late = scratch.store(linked(passed(rest)), release=True)
            tried = tried.unionByName(rest)
            if not late.isEmpty():
                links = links.unionByName(late)
                found = scratch.store(components(links))
        if not more:
            break
        groups = groups.join(mixed.select("bucket").hint("merge"), "bucket", "left_semi").select("bucket", "id")
    return found


def _pieces() -> Column:
    """The pieces (i, j, side) of its group that a row goes to: rows of the largest component to one chunk of these, others to all chunks and to pairs of chunks of the others."""
    chunks, others = (F.greatest(F.lit(1), F.ceil(F.col(c) / CHUNK)).cast("long") for c in ("inside", "outside"))
    own = F.xxhash64("id")
    mine = F.pmod(own, others)
    piece = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("long").alias("side"))
    inside = F.array(piece(F.pmod(own, chunks), F.lit(-1), F.lit(0)))
    # In a group that is cut, rows outside are of side 2 where they meet the largest component, which is of side 3 there.
    cut = (chunks > 1) | (others > 1)
    inside = F.when(cut, F.array(piece(F.pmod(own, chunks), F.lit(-1), F.lit(3)))).otherwise(inside)
    each = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda c: piece(c, F.lit(-1), F.lit(2)))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), others - 1),
        lambda o: piece(F.least(o, mine), F.greatest(o, mine), F.when(o == mine, 1).otherwise(F.when(mine < o, 2).otherwise(3))),
    )
    outside = F.when(cut, F.concat(each, pairs)).otherwise(F.array(piece(F.lit(0), F.lit(-1), F.lit(1))))
    return F.when(F.col("component") == F.col("largest"), inside).otherwise(outside)
