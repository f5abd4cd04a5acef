"""op9's taken words by a plain version that shares no code with it."""

import math
import re
import struct
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
import xxhash

from lectern.llm import mixing, queries


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(first, *seeds):
    """Spark's xxhash64 of a long or text and whole numbers, each seeded by what was before."""
    h = 42
    for part in (first, *(struct.pack("<i", s) for s in seeds)):
        if part is not None:
            data = part.encode() if isinstance(part, str) else struct.pack("<q", part) if isinstance(part, int) else part
            h = xxhash.xxh64(data, seed=h).intdigest()
    return signed(h)


def dec(x, digits=15):
    return Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


def targets(sizes, weights, total, cap):
    """Shares of the total by weight; a source over its cap keeps that, and the rest is dealt anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left = {}, total * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in out]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]


def taken(docs):
    """{id: words}: large documents by what is left, then one systematic sample a source."""
    n_buckets = max(1, math.ceil(math.sqrt(len(docs)) / 32))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    by = defaultdict(lambda: defaultdict(list))
    for i, _, source in docs:
        spot = hashed(i, mixing.SEED)
        by[source][math.floor(math.log2(size[i] + 1) * 4), spot % n_buckets].append((size[i], spot, i))
    sums = {s: sum(x[0] for rows in b.values() for x in rows) for s, b in by.items()}
    goal, copies = targets(sums, (5, 2, 1), 1.5, 2.0), {}
    for source, buckets in by.items():
        key = "=" + source if source is not None else ""
        offset = dec((hashed(key, mixing.SEED) % (1 << 64) >> 11) / 2**53)
        heads = {b for b, rows in buckets.items() if min(rows)[0] * mixing.HEADS > sums[source]}
        large = sorted(((r[0], *b, k + 1, r[2]) for b in heads for k, r in enumerate(sorted(buckets[b]))), reverse=True)
        left, words, at = goal[source], float(sums[source]), 0.0
        for n, _, _, _, i in large:
            rate = max(0.0, min(2.0, left / words)) if words > 0 else 0.0
            copies[i] = math.floor(at + rate + float(offset)) - math.floor(at + float(offset))
            left, words, at = left - copies[i] * n, words - n, at + rate
        base, rate = dec(at), dec(max(0.0, min(2.0, left / words)) if words > 0 else 0.0)
        for b in sorted(set(buckets) - heads):
            for _, _, i in sorted(buckets[b]):
                copies[i] = math.floor(base + rate + offset) - math.floor(base + offset)
                base += rate
    return {i: copies[i] * size[i] for i in copies}, goal


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_taken_words(spark, folder):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
    want, goal = taken(docs)
    source = {i: s for i, _, s in docs}
    rows = queries.op9_mixing(spark, f"/root/testdata/{folder}").collect()
    assert {r.doc_id: r.taken for r in rows} == want
    assert all(math.isclose(r.target, goal[source[r.doc_id]], rel_tol=1e-9) for r in rows)
