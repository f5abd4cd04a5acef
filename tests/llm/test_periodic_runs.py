import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from lectern.llm import periodic_runs, queries


def brute_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w)):
        k = 0
        while k + q < len(w):
            s = k
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            n = k - s + q
            if k > s and n >= max(least, times * q) and all(any(w[s + j] != w[s + j + r] for j in range(n - r)) for r in range(1, q)):
                out.append((s, n, q))
            k = max(k, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(draw):
    n, letters = draw.randrange(0, 70), draw.choice([1, 2, 3, 5])
    w = [draw.choice("abcdé"[:letters]) for _ in range(n)]
    if n > 4 and draw.random() < 0.6:
        a, p = draw.randrange(n), draw.randrange(1, 9)
        for i in range(a + p, min(n, a + p * draw.randrange(2, 9))):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (4, 3), (9, 2)])
def test_runs_match_brute_force(least, times, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 4)
    draw = random.Random(least * times)
    texts = [some_words(draw) for _ in range(600)]
    runs, out = periodic_runs._batch(pa.array([" \n".join(w) for w in texts]), least, times)
    for w, got, text in zip(texts, runs, out, strict=True):
        want = brute_runs(w, least, times)
        number = {x: i for i, x in enumerate(sorted(set(w)))}
        assert periodic_runs.runs_of([number[x] for x in w], least, times) == want
        assert [(r["start"], r["length"], r["period"]) for r in got] == want and text.decode() == collapsed(w, want)


def test_long_texts_of_one_period_are_one_run():
    for period, n in ((1, 60_000), (8, 60_000), (4999, 20_000)):
        runs, _ = periodic_runs._batch(pa.array([" ".join(f"w{i % period}" for i in range(n))]), 6, 4)
        assert [tuple(r.values()) for r in runs[0]] == [(0, n, period)]


def test_odd_rows_and_none(spark, odd_docs, no_docs):
    df = odd_docs.withColumnRenamed("size", "Runs")
    out = periodic_runs.find_runs(df).collect()
    assert len(out) == odd_docs.count() and {"runs", "collapsed", "`odd.name", "kept"} <= set(out[0].asDict()) and "Runs" not in out[0].asDict()
    assert all(r.collapsed == " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.runs == [] for r in out)
    assert periodic_runs.find_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(no_docs, times=1)


def edited(i, text):
    w, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    return w


def check(docs, rows):
    assert sorted(docs) == sorted(r.doc_id for r in rows)
    for r in rows:
        w = edited(r.doc_id, docs[r.doc_id])
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()


def test_query_matches_brute_force(spark, tmp_path):
    draw = random.Random(5)
    docs = {i: " ".join(some_words(draw)) for i in range(500)} | {501: None, 502: "", 503: " \t", 504: "one", 505: "a a a a " * 9}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    check(docs, rows)
    assert sum(r.n_runs for r in rows) > 100


def test_query_on_given_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    docs = {i: t for i, t in docs.items() if len((t or "").split()) < 1500}
    check(docs, [r for r in queries.op13_periodic_runs(spark, sf_dir).collect() if r.doc_id in docs])
