import random
import re

import duckdb
import pytest

from lectern.llm import decontamination, queries

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def said(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, items, size):
    out = []
    for i, t, *_ in docs:
        w, hit, named = said(t), set(), set()
        for item, text in items:
            b = said(text)
            for s in range(max(len(b) - size, 0) + 1 if b else 0):
                x = b[s : s + size]
                for k in range(len(w) - len(x) + 1):
                    if w[k : k + len(x)] == x:
                        hit |= set(range(k, k + len(x)))
                        named |= {str(item)} - {"None"}
        out.append((i, len(w), len(hit), sorted(named)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def made():
    draw = random.Random(7)
    word = lambda: draw.choice(["É", "été", "Ab", "x9", "漢", "the", "of", "to", "a" * 50])
    text = lambda n: draw.choice(["", "... "]) + draw.choice([" ", ", ", "-"]).join(word() for _ in range(n))
    items = [(i, text(draw.choice([1, 2, 3, 4, 6, 9, 14]))) for i in range(30)]
    items += [(31, None), (32, ""), (33, " ?! "), (None, items[4][1]), (34, items[6][1]), (34, items[7][1]), (35, "never said words")]
    docs = []
    for i in range(120):
        t = text(draw.randrange(0, 30))
        for _ in range(draw.randrange(0, 3)):
            t += " " + (draw.choice(items)[1] or "").upper().replace("ÉTÉ", "été") + draw.choice([" ", "\n", "; "]) + text(draw.randrange(0, 9))
        docs.append((i, t))
    return [*docs, (200, None), (201, ""), (202, "..!"), (202, docs[3][1]), (None, docs[5][1]), (203, " ".join(x for _, x in docs))], items


@pytest.mark.parametrize("size", [1, 3, 5, 10])
def test_hits_match_brute_force(spark, made, size, monkeypatch):
    docs, items = made
    df, tests = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, size)
    assert rows(decontamination.contamination(df, tests, size)) == want and sum(r[2] for r in want) > 100
    if size == 5:  # nothing is broadcast
        monkeypatch.setattr(decontamination, "MOST_BYTES", -1)
        monkeypatch.setattr(decontamination, "MOST_ROWS", -1)
        assert rows(decontamination.contamination(df, tests, size)) == want


@pytest.mark.parametrize("slack", [0, 1, 2])
def test_whole_items_match_brute_force(spark, made, slack):
    docs, items = made
    count = {}
    asked = {x for _, t in items for x in said(t)}
    for _, t in docs:
        for x in said(t):
            count[x] = count.get(x, 0) + (x in asked)
    want = set()
    for i, t in docs:
        w = said(t)
        for item, text in items:
            b = said(text)
            if b and all(count.get(x) for x in b):
                first = min(range(len(b)), key=lambda o: (count[b[o]], o))
                for k, x in enumerate(w):
                    near = lambda o: any(0 <= k - first + o + d < len(w) and w[k - first + o + d] == b[o] for d in range(-slack, slack + 1))  # noqa: E731, B023
                    if x == b[first] and all(near(o) for o in range(len(b)) if o != first):
                        want.add((i, None if item is None else str(item), k - first, len(b)))
    df, tests = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.id, r.item, r.start, r.n_words) for r in decontamination.find_items(df, tests, slack).collect()]
    assert set(got) == want and len(want) > 50


def test_odd_rows_and_none(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "text here for all"), (2, "word0x0 word1x1"), (3, "café 漢字"), (4, None)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    clash = odd_docs.withColumnsRenamed({"size": "row", "n": "pos", "slot": "t", "id": "item_id", "score": "n_hit"})
    assert rows(decontamination.contamination(clash, tests)) == brute(docs, items, 10)
    assert decontamination.contamination(no_docs, tests).count() == 0 and decontamination.find_items(no_docs, tests).count() == 0
    assert rows(decontamination.contamination(odd_docs, tests.limit(0))) == brute(docs, [], 10)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_matches_its_sql(spark, folder):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '/root/testdata/{folder}/{name}.parquet'")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(con.sql(queries.OP11_SQL).df()[columns].itertuples(index=False, name=None))
    got = sorted(tuple(r[c] for c in columns) for r in queries.op11_decontamination(spark, f"/root/testdata/{folder}").collect())
    assert got == want and any(r[5] for r in got)
