import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from lectern.llm import queries, source_divergence

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string"


def brute(docs, least, prior, scale, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs = [(terms(t), lang or "", source or "") for _, t, lang, source, *_ in docs]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for w, lang, source in docs:
        df[lang].update(set(w))
        n[lang, source].update(w)
    out = []
    for lang in df:
        kept = sorted(t for t, k in df[lang].items() if k >= least)
        sources = sorted(s for g, s in n if g == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + scale * (count[t] + prior) // (total + prior * len(kept)) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            best = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(best)]
    return sorted(out)


def rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def made():
    draw = random.Random(3)
    some = ["a", "B", "the", "été", "É", "naïve", "x1y", "漢字", "don't", "ABC", "\U0001f600", "z" * 300]
    docs = []
    for i in range(400):
        lang = draw.choice(["en", "en", "fr", None, ""])
        source = draw.choice(["s1", "s2", "S3", None, "é", "s10"])
        text = None if draw.random() < 0.05 else draw.choice([" ", "\n", ", "]).join(draw.choices(some, k=draw.randrange(0, 40), weights=range(1, 13)))
        docs.append((i, text, lang, source))
    return [*docs, (400, None, "de", "only"), (401, "few words", "es", "p"), (402, "1 2 3", "es", "q"), (402, "1 2 3", "es", "q"), (None, "the été " * 3000, "en", "s1")]


def test_matches_brute_force(spark, made, monkeypatch):
    df = spark.createDataFrame(made, SCHEMA).repartition(3)
    assert rows(source_divergence.divergence(df, least_docs=20, top=4)) == brute(made, 20, 5, 10**9, 4)
    monkeypatch.setattr(source_divergence, "BLOCK_BYTES", 40)
    monkeypatch.setattr(source_divergence, "BUCKET_ROWS", 10)
    monkeypatch.setattr(source_divergence, "SOURCES", 2)
    monkeypatch.setattr(source_divergence, "CELLS", 16)
    monkeypatch.setattr(source_divergence, "MOST_COUNTED", 8)
    assert rows(source_divergence.divergence(df, least_docs=20, top=4)) == brute(made, 20, 5, 10**9, 4)
    assert rows(source_divergence.divergence(df, least_docs=1, prior=1, scale=10**12)) == brute(made, 1, 1, 10**12, 50)


def test_odd_rows_and_none(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert rows(source_divergence.divergence(odd_docs.withColumnsRenamed({"n": "term", "id": "place", "slot": "value"}), least_docs=1)) == brute(docs, 1, 5, 10**9, 50)
    assert rows(source_divergence.divergence(odd_docs)) == brute(docs, 30, 5, 10**9, 50)
    assert source_divergence.divergence(no_docs).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_matches_its_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{folder}/documents.parquet'")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    want = sorted(con.sql(queries.OP12_SQL).df()[columns].itertuples(index=False, name=None))
    got = rows(queries.op12_source_divergence(spark, f"/root/testdata/{folder}"))
    assert got == want and len(got) > 1000
