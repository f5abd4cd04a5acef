"""op7 and op8 against plain versions that share no code with them."""

import math
import struct
import zlib
from collections import defaultdict

import numpy as np
import xxhash

from lectern.llm import language_id, queries


def hashed(key, name):
    """Spark's xxhash64 of a long and a string: each value's hash seeds the next."""
    first = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
    return xxhash.xxh64(name.encode(), seed=first).intdigest()


def drawn(key, names, weights):
    draw = [-math.log(((hashed(key, n) >> 11) + 1) / (2**53 + 1)) / w for n, w in zip(names, weights, strict=True)]
    return draw.index(min(draw))


def shard(key, grown):
    """Two regions of two racks of four shards; a further shard is a region by itself."""
    region = drawn(key, ["r0", "r8", *(["r16"] if grown else [])], [8.0, 8.0, 1.0][: 2 + grown])
    if region == 2:
        return 16
    rack = drawn(key, [f"k{8 * region}", f"k{8 * region + 4}"], [4.0, 4.0])
    first = 8 * region + 4 * rack
    return first + drawn(key, [f"s{i}" for i in range(first, first + 4)], [1.0] * 4)


def test_shards_are_those_of_the_weighted_tree(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    slots = defaultdict(set)
    rows = queries.op7_sharding(spark, sf_dir).collect()
    for r in rows:
        t = texts[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "key", shard(r.doc_id, 0), shard(r.doc_id, 1))
        slots[r.shard].add(r.slot)
    assert len(rows) == len(texts) and all(s == set(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(rows)


def plainly(model, text):
    """The language and score by loops over windows, positions and filters."""
    data, sums, total = text.encode(), np.zeros(len(model.languages)), 0.0
    for low in range(0, len(data), language_id.WINDOW):
        window = data[low : low + language_id.WINDOW]
        vectors = [model.embed[b].astype(float) for b in window] + [np.zeros(language_id.EMBED)] * (language_id.WINDOW - len(window))
        pooled = []
        for width, kernel, bias in zip(language_id.WIDTHS, model.filters, model.biases, strict=True):
            seen = [np.concatenate(vectors[p : p + width]) @ kernel for p in range(language_id.WINDOW - width + 1)]
            pooled += list(np.maximum(np.max(seen, axis=0) + bias, 0))
        logits = np.array(pooled) @ model.out + model.out_bias
        p = np.exp(logits - logits.max())
        letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC3 for b in window) + 1e-3
        sums, total = sums + letters * p / p.sum(), total + letters
    return model.languages[sums.argmax()], sums.max() / total


def test_languages_are_those_of_a_plain_network(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    some = docs.select("doc_id", "text").orderBy("doc_id").limit(25).where("length(text) < 6000")
    got = language_id.predict(some, model).collect()
    for r in got:
        lang, score = plainly(model, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4
    assert len(got) > 10
