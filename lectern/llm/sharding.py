"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard; at each node every child draws -ln(u)/weight from a hash of
the row's key and the child's name, and the smallest draw wins, so a child gets rows in proportion
to its weight. A child's draw depends on nothing but the key, its name and its weight: when weights
change, rows move only into a child whose weight rose or out of one whose weight fell, and inside an
unchanged subtree nothing moves. A new shard comes as a region of its own, so it takes rows only
into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import col, fresh, running_base, sub_buckets


@dataclass(frozen=True)
class Node:
    """A named node; a leaf carries its shard number. The weight of an inner node is the sum of its children's."""

    name: str
    weight: float = 0.0
    children: tuple[Node, ...] = ()
    shard: int | None = None

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def topology(n_shards: int, base: int = 16, racks: int = 2, per_rack: int = 4) -> Node:
    """The first `base` shards fill regions of racks * per_rack shards; each further shard is a region of its own."""
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    regions, first = [], 0
    inside = min(n_shards, base)
    while first < inside:
        some, start = [], first
        for _ in range(racks):
            leaves = tuple(Node(f"s{i}", 1.0, (), i) for i in range(first, min(first + per_rack, inside)))
            if leaves:
                some.append(Node(f"k{first}", children=leaves))
            first += len(leaves)
        regions.append(Node(f"r{start}", children=tuple(some)))
    regions += [Node(f"r{i}", children=(Node(f"k{i}", children=(Node(f"s{i}", 1.0, (), i),)),)) for i in range(base, n_shards)]
    return Node("root", children=tuple(regions))


def shard_of(key: Column, tree: Node) -> Column:
    """The shard that a key descends to. A null key draws like any other value."""
    return _descend(key, tree)


def _descend(key: Column, node: Node) -> Column:
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.total > 0]
    if not live:
        raise ValueError(f"no child of {node.name} has a weight")
    if len(live) == 1:
        return _descend(key, live[0])
    draws = F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)])
    won = F.array_min(draws)["i"]
    out = _descend(key, live[-1])
    for i in range(len(live) - 2, -1, -1):
        out = F.when(won == i, _descend(key, live[i])).otherwise(out)
    return out


def _draw(key: Column, child: Node) -> Column:
    """Exponential with rate weight, from 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11)
    return -F.log((bits.cast("double") + 1.0) / F.lit(float(2**53 + 1))) / F.lit(child.total)


def assign_shards(
    df: DataFrame, n_shards: int, key_col: str = "doc_id", text_col: str = "text", tree: Node | None = None, grown: Node | None = None
) -> DataFrame:
    """df with size, text_crc32, law, shard, slot and grown_shard.

    size is the text's UTF-8 bytes plus 1, text_crc32 that of the text (a null text counts as
    empty). slot counts from 0 without gaps in each shard, in an order that key and text fix; rows
    that repeat both take neighbouring slots. A null key is a key. Long texts count whole; an empty table gives an empty result. Columns of
    df with the new names are replaced, unless they are key or text.
    """
    tree, grown = tree or topology(n_shards), grown or topology(n_shards + 1)
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    df = df.drop(*[c for c in df.columns if c.lower() in new and c not in (key_col, text_col)])
    text = F.coalesce(col(text_col), F.lit(""))
    sub, base, n = fresh(df, "sub_", "base_", "n_")
    buckets = sub_buckets(df.count(), 8)
    placed = df.withColumns(
        {
            "size": F.octet_length(text).cast("long") + 1,
            "text_crc32": F.crc32(F.encode(text, "UTF-8")),
            "law": F.lit("key"),
            "shard": shard_of(col(key_col), tree),
            "grown_shard": shard_of(col(key_col), grown),
            sub: F.pmod(F.xxhash64(col(key_col), F.lit("slot")), F.lit(buckets)),
        }
    )
    counts = df.select(
        shard_of(col(key_col), tree).alias("shard"), F.pmod(F.xxhash64(col(key_col), F.lit("slot")), F.lit(buckets)).alias(sub)
    ).groupBy("shard", sub).agg(F.count(F.lit(1)).alias(n))
    starts = running_base(counts, ["shard"], [sub], n, base).drop(n)
    order = Window.partitionBy("shard", sub).orderBy(col(key_col), "text_crc32", "size")
    numbered = placed.withColumn("slot", F.row_number().over(order) - 1).join(starts, ["shard", sub])
    return numbered.withColumn("slot", col(base) + F.col("slot")).select(*[c for c in map(col, df.columns)], *new)
