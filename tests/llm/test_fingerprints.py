import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import fingerprints as P


def edits(docs):
    """id -> (chars, edited text, next text) by descending id, nulls last."""
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    out = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 3
        out[i] = (len(t), t[: len(t) - cut] + nxt[:cut], nxt)
    return out


@pytest.mark.parametrize("per_range", [3, 2000])
def test_edited_texts(spark, monkeypatch, per_range):
    monkeypatch.setattr(P, "ROWS_A_RANGE", per_range)
    monkeypatch.setattr(P, "CELLS", 4)
    draw = random.Random(2)
    ids = draw.sample(range(-500, 10**12), 25) + list(range(40))
    docs = [(i, " ".join(draw.choice(["é\U0001f600", "the", "of", "x" * 5]) for _ in range(draw.randrange(0, 30)))) for i in ids] + [(None, "last of all")]
    docs[3] = (docs[3][0], None)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = edits(docs)
    prints = {r.doc_id: r.fingerprint for r in P.fingerprints(df).withColumn("fingerprint", P.as_text(F.col("fingerprint"))).collect()}
    both = spark.createDataFrame([(i, w[1]) for i, w in want.items()], "doc_id long, text string")
    edited = {r.doc_id: r.fingerprint for r in P.fingerprints(both).withColumn("fingerprint", P.as_text(F.col("fingerprint"))).collect()}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    nxt = {a[0]: b[0] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
    out = P.with_edited(df).collect()
    assert len(out) == len(docs)
    for r in out:
        n, text, _ = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(text.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[r.doc_id], edited[r.doc_id])
        assert r.near_edited == like(r.fingerprint, r.edited_fingerprint) and r.near_next == like(r.fingerprint, prints[nxt[r.doc_id]])


def test_simhash_by_hand(spark):
    df = spark.createDataFrame([(1, "a b a b c"), (2, "a  b\ta b c"), (3, ""), (4, None), (5, "one")], "doc_id long, text string")
    hashes = df.select("doc_id", P.terms(F.col("text")).alias("t")).collect()
    got = {r.doc_id: r.fingerprint for r in P.fingerprints(df).collect()}
    for r in hashes:
        bits = sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in r.t) > len(r.t))
        assert got[r.doc_id] % (1 << 64) == bits
    assert got[1] == got[2] and got[3] == got[4] == 0


def test_odd_rows(odd_docs, no_docs, spark):
    out = P.with_edited(odd_docs).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert P.with_edited(no_docs).count() == 0
    alone = P.with_edited(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1.0


def test_near_pairs_match_brute_force(spark):
    draw = random.Random(9)
    base = [draw.getrandbits(64) for _ in range(30)]
    values = set(base)
    for b in base:
        for _ in range(6):
            v = b
            for j in draw.sample(range(64), draw.randrange(1, 6)):
                v ^= 1 << j
            values.add(v)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed] + [(None,), (signed[0],)], "fingerprint long")
    far = lambda a, b: bin((a ^ b) % (1 << 64)).count("1")
    want = {(a, b, far(a, b)) for a in signed for b in signed if a < b and far(a, b) <= 3}
    for spare in (1, 2, 3):
        pairs = P.near_pairs(df, 3, spare).collect()
        assert {(r.a, r.b, r.distance) for r in pairs} == want and len(pairs) == len(want) > 30
    assert {(r.a, r.b) for r in P.near_pairs(df, 1, 3).collect()} == {(a, b) for a, b, d in want if d == 1}


def test_near_counts_match_brute_force(spark):
    draw = random.Random(3)
    hot = draw.getrandbits(64)
    values = [hot] * 200 + [hot ^ (1 << 63) ^ (1 << j) for j in range(40)] + [draw.getrandbits(64) for _ in range(50)] + [0, 1, (1 << 64) - 1]
    rows = [(i, f"{v:016x}", "x") for i, v in enumerate(values)] + [(-1, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string, count_ string")
    want = {f"{v:016x}": sum(0 < bin(v ^ w).count("1") <= 3 for w in set(values)) for v in values} | {None: 0}
    got = P.with_near_counts(df)
    assert got.columns == [*df.columns, "near_fingerprints"]
    assert sorted((r.doc_id, r.near_fingerprints) for r in got.collect()) == sorted((i, want[f]) for i, f, _ in rows)
    assert want[f"{hot:016x}"] == 40 and P.with_near_counts(df.limit(0)).count() == 0


def test_query_counts_all_near_fingerprints(spark, sf_dir):
    from lectern.llm.queries import queries

    rows = queries()["op10_fingerprints"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    values = {int(r.fingerprint, 16) for r in rows}
    for r in rows:
        own = int(r.fingerprint, 16)
        assert r.near_fingerprints == sum(0 < (own ^ v).bit_count() <= P.RADIUS for v in values)
