"""Queries that read their whole tables."""

from collections import Counter

from lectern.plans import QUERIES, analytics


def test_collected_sets_have_documents_of_all_ids(spark, sf_dir):
    rows = [(r.category, r.doc_id) for r in QUERIES["agg_collect_set"](spark, sf_dir).collect()]
    assert len(rows) == len(set(rows)) and {i % 7 for _, i in rows} == set(range(7))


def test_neighbours_are_found_among_long_accented_and_foreign_words(spark, tmp_path):
    texts = ["immigration imm1gration chinese chinesé a b", "citizen citizens citzen été étés x" + "y" * 400, "a ab immigration", None, "x" + "y" * 399]
    spark.createDataFrame([(i, x, "fr" if i % 2 else "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    count = Counter(w for x in texts if x for w in x.lower().split())

    def near(a, b):
        a, b = sorted((a, b), key=len)
        return a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))))

    want = set()
    for a in count:
        order = sorted((b for b in count if near(a, b)), key=lambda b: (-count[b], b))
        want |= {(a, b, count[b], i + 1) for i, b in enumerate(order[:10])}
    got = {(r.word, r.other, r.n_other, r.rank) for r in QUERIES["ocr_neighbors"](spark, str(tmp_path)).collect()}
    assert got == want and ("immigration", "imm1gration", 1, 1) in got and ("chinese", "chinesé", 1, 1) in got


def test_cosine_top_k_asks_for_every_twentieth_vector_in_any_blocks(spark, sf_dir, monkeypatch):
    rows = lambda: {(r.query, r.vec_id, r["rank"]) for r in QUERIES["cosine_top_k"](spark, sf_dir).collect()}
    want = rows()
    ids = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}
    assert {q for q, *_ in want} == {i for i in ids if i % 20 == 0} and len(want) == 10 * len({q for q, *_ in want})
    monkeypatch.setattr(analytics, "QUERY_BLOCK", 4)
    assert rows() == want


def test_permutation_test_draws_all_replicates(spark, sf_dir):
    assert QUERIES["permutation_test"](spark, sf_dir).first()["replicates"] == 20_000


def test_top_k_takes_ties_by_key_and_leaves_vectors_without_a_direction_out(spark):
    from lectern.operators import models

    same = [(i, [1.0, 2.0]) for i in range(40, 60)]
    df = spark.createDataFrame([*same, (1, [0.0, 0.0]), (2, None), (3, [2.0, 4.0]), (4, [-1.0, -2.0]), (5, [1.0, 2.1])], "id long, v array<double>").repartition(3)
    asked = df.where("id in (3, 1, 41)").selectExpr("id as query", "v as qv")
    for block in (4096, 3):
        got = {(r.query, r["rank"]): r.id for r in models.cosine_top_k(df, asked, "id", "v", 3, block).collect()}
        assert got == {(3, 1): 40, (3, 2): 41, (3, 3): 42, (41, 1): 3, (41, 2): 40, (41, 3): 42}
    assert models.cosine_top_k(df, asked.limit(0), "id", "v", 3).count() == 0
