"""op4's features and updates by plain versions that share no code with them."""

import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa

from lectern.llm import quality

MASK, BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def kind(b):
    return 0 if b == 32 or 9 <= b <= 13 else 1 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 2


def plain_features(text):
    """{bucket: value}: tokens are runs of one kind of bytes; words and shapes give 1- and 2-grams."""
    data, tokens, at = (text or "").encode(), [], 0
    while at < len(data):
        stop = at
        while stop < len(data) and kind(data[stop]) == kind(data[at]):
            stop += 1
        if kind(data[at]):
            tokens.append((at, stop))
        at = stop
    streams = ([], [])
    for i, (a, b) in enumerate(tokens):
        t = data[a:b]
        word = mixed((sum((x + (32 if 65 <= x <= 90 else 0) + 1) * pow(BASE, k, 1 << 64) for k, x in enumerate(t)) + len(t)) & MASK)
        again = int(i > 0 and streams[0][-1] == word)
        upper = [65 <= x <= 90 for x in t]
        shape = upper[0] + 2 * (sum(upper) > 1) + 4 * any(48 <= x <= 57 for x in t) + 8 * min(len(t) // 4, 7) + 64 * again + 128 * (b < len(data) and data[b] > 32)
        streams[0].append(word)
        streams[1].append(mixed(((word ^ again if kind(t[0]) == 2 else shape) + 0xA11) & MASK))
    count = Counter()
    for stream, salt in zip(streams, (11, 23), strict=True):
        for i, x in enumerate(stream):
            count[mixed((x + salt) & MASK) >> (64 - quality.BUCKET_BITS)] += 1
            if i:
                count[mixed((x + (stream[i - 1] ^ (salt + 1)) * BASE) & MASK) >> (64 - quality.BUCKET_BITS)] += 1
    total = sum(count.values())
    return {k: math.sqrt(n / total) for k, n in count.items()}


TEXTS = ["The cat, the CAT sat.", "", None, "x" * 40 + " 12ab 12ab !! !! Été été...", " \t\n", "One.", "a b a b A B", "漢字 漢字 \U0001f600!", "ends" * 3, "Begins here"]


def test_features_are_those_of_loops():
    owner, bucket, value = quality.features(pa.array(TEXTS, pa.string()))
    got = [{} for _ in TEXTS]
    for o, b, v in zip(owner.tolist(), bucket.tolist(), value.tolist(), strict=True):
        got[o][b] = v
    for text, mine in zip(TEXTS, got, strict=True):
        want = plain_features(text)
        assert mine.keys() == want.keys() and all(math.isclose(mine[k], want[k], rel_tol=1e-6) for k in want)


def test_updates_are_those_of_the_published_rule():
    draw = np.random.default_rng(5)
    rows = [(np.sort(draw.choice(60, 6, replace=False)), draw.random(6).astype(np.float32)) for _ in range(40)]
    labels = draw.integers(0, 2, 40).astype(float)
    model = quality.fit(rows, labels, epochs=3)
    z, n, alpha, beta, l1, l2 = Counter(), Counter(), 1.0, 1.0, 0.002, 0.02

    def weight(k):
        if k == "bias":
            return -z[k] / ((beta + math.sqrt(n[k])) / alpha)
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    turns = np.random.default_rng(7)
    for _ in range(3):
        for i in turns.permutation(40):
            x = dict(zip(rows[i][0].tolist(), rows[i][1].astype(float).tolist(), strict=True)) | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - labels[i]) * v
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    assert math.isclose(model.bias, weight("bias"), rel_tol=1e-9)
    assert all(math.isclose(float(model.weights[k]), weight(k), rel_tol=1e-5, abs_tol=1e-9) for k in range(60)) and not model.weights[60:].any()


def test_scores_are_sigmoids_of_sparse_dots():
    draw = np.random.default_rng(6)
    model = quality.Model(draw.normal(size=1 << quality.BUCKET_BITS).astype(np.float32), 0.25)
    for text, got in zip(TEXTS, model.scores(pa.array(TEXTS, pa.string())), strict=True):
        dot = sum(float(model.weights[k]) * v for k, v in plain_features(text).items())
        assert math.isclose(got, 1 / (1 + math.exp(-dot - 0.25)), rel_tol=1e-5)


def test_the_driver_gets_weights_alone(spark, monkeypatch):
    """The features of the rows to fit on stay with the executors, where the model is fitted in the order of the ids' hashes."""
    texts = [(i, f"{'good words here' if i % 2 else 'BAD 123 !!'} {i}", i % 2) for i in range(200)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, q) for i, _, q in texts], "doc_id long, quality int")
    own = labels.where(~quality.held_out(labels.doc_id)).selectExpr("doc_id", "quality", "xxhash64(doc_id) h").orderBy("h").collect()
    owner, bucket, value = quality.features(pa.array([texts[r.doc_id][1] for r in own]))
    rows = [(bucket[owner == i], value[owner == i]) for i in range(len(own))]
    want = quality.fit(rows, np.array([float(r.quality) for r in own]))
    here, fit = os.getpid(), quality.fit

    def elsewhere(*args):
        assert os.getpid() != here, "fitted in the driver"
        return fit(*args)

    monkeypatch.setattr(quality, "fit", elsewhere)
    got = quality.train(docs, labels)
    assert np.allclose(got.weights, want.weights, atol=1e-6) and abs(got.bias - want.bias) < 1e-9
