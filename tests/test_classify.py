import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lectern.operators import classify, models


def texts(n, seed=0):
    """Rows of three classes, each with words of its own besides common ones."""
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        c = int(draw.integers(3))
        own = [f"{'abc'[c]}{k}" for k in draw.integers(0, 4, draw.integers(0, 3))]
        out.append((i, "xyz"[c], [str(w) for w in draw.permutation(own + [f"w{k}" for k in draw.integers(0, 12, 6)])], 1.0 + i % 2))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    made = texts(240)
    return made, spark.createDataFrame([*made, (999, "x", [], 1.0), (998, "y", None, 1.0)], "id long, label string, w array<string>, weight double").repartition(3)


def dense(made, train, least):
    """TF-IDF by plain loops: (vocabulary, values by row)."""
    df = {}
    for _, _, w, _ in train:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    vocabulary = sorted(x for x in df if df[x] >= least)
    out = np.zeros((len(made), len(vocabulary)))
    for i, (_, _, w, _) in enumerate(made):
        for j, x in enumerate(vocabulary):
            out[i, j] = w.count(x) * (math.log((1 + len(train)) / (1 + df[x])) + 1)
        norm = np.linalg.norm(out[i])
        out[i] /= norm or 1
    return vocabulary, out


def test_tfidf_as_rows_and_as_vectors(spark, rows):
    made, df = rows
    df = df.where("id < 900")
    vocabulary, want = dense(made, made, 8)
    got = {(r.key, r.term): r.x for r in classify.tfidf(df, "id", "w", classify.idf_table(df, "id", "w", 8)).collect()}
    assert got.keys() == {(i, vocabulary[j]) for i, j in zip(*np.nonzero(want), strict=True)}
    assert all(math.isclose(x, want[i, vocabulary.index(t)], rel_tol=1e-12) for (i, t), x in got.items())
    features = classify.tfidf_features(df, "w", 8)
    order = [features.stages[0].vocabulary.index(t) for t in vocabulary]
    vectors = {r.id: np.array(r.v)[order] for r in features.transform(df).select("id", vector_to_array("features").alias("v")).collect()}
    assert all(np.allclose(vectors[i], want[i]) for i in range(len(made)))


def test_top_terms_are_those_of_dense_contributions(spark, rows):
    made, df = rows
    df = df.where("id < 900")
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    features = classify.tfidf_features(train, "w", 3)
    model = classify.fit(features.transform(train), "label", ["x", "y", "z"], reg=0.005)
    terms = features.stages[0].vocabulary
    x = classify.tfidf(df, "id", "w", classify.idf_table(train, "id", "w", 3))
    weights = classify.coefficients(model, terms, spark)
    got = classify.shap_top_terms(x.where("key % 4 <> 0"), 180, x.where("key % 4 = 0"), 60, weights, 5).collect()
    vocabulary, values = dense(made, [m for m in made if m[0] % 4], 3)
    held = np.array([m[0] % 4 == 0 for m in made])
    matrix = model.model.coefficientMatrix.toArray()[:, [terms.index(t) for t in vocabulary]]
    off = values[held] - values[~held].mean(axis=0)
    for c, label in enumerate("xyz"):
        mine = [j for j in range(len(vocabulary)) if matrix[:, j].argmax() == c and matrix[c, j] > 0]
        mean, size = (off * matrix[c]).mean(axis=0), np.abs(off * matrix[c]).mean(axis=0)
        best = sorted(mine, key=lambda j: (-round(mean[j], 12), vocabulary[j]))[:5]
        told = sorted((r for r in got if r.label == label), key=lambda r: r["rank"])
        assert [r.term for r in told] == [vocabulary[j] for j in best] and best
        assert np.allclose([r.shap for r in told], mean[best]) and np.allclose([r.shap_abs for r in told], size[best])


def test_penalties_are_chosen_on_the_other_fold_and_folds_are_averaged(spark, rows, tmp_path):
    _, df = rows
    features = models.ngram_features(df.where("id < 900"), "w", 2, 1000)
    ready = features.transform(df.where("id < 900"))
    classes, grid = ["x", "y", "z"], [0.9, 0.01]
    folds = classify.fold_grid(ready, "id", "label", classes, grid, 3, "weight", "accuracy")
    assert len(folds.scores) == 6 and folds.penalties == [0.01] * 3  # the other penalty leaves no weights
    for f in range(3):
        tried = {r: s for fold, r, s in folds.scores if fold == f}
        assert tried[0.01] > tried[0.9] + 0.1
    one = {r.id: np.array(r.p) for r in folds.probabilities(ready, "p").select("id", "p").collect()}
    each = [{r.id: np.array(r.p) for r in m.probabilities(ready, "p").select("id", "p").collect()} for m in folds.models]
    assert all(np.allclose(one[i], np.mean([e[i] for e in each], axis=0)) and math.isclose(one[i].sum(), 1) for i in one)
    classify.save(folds, f"{tmp_path}/m", spark)
    again = classify.load(f"{tmp_path}/m", spark)
    assert again.scores == folds.scores and {r.id: r.p for r in again.probabilities(ready, "p").collect()} == {i: list(p) for i, p in one.items()}


def test_one_class_needs_no_model_and_missing_classes_get_no_probability(spark, rows, tmp_path):
    _, df = rows
    ready = models.ngram_features(df.where("id < 900"), "w", 2, 1000).transform(df.where("id < 900"))
    alone = classify.fit(ready.where("label = 'y'"), "label", ["x", "y", "z"])
    assert alone.model is None and {tuple(r.p) for r in alone.probabilities(ready, "p").collect()} == {(0.0, 1.0, 0.0)}
    assert ready.limit(1).transform(lambda d: alone.probabilities(d, "p")).select(classify.chosen("p", ["x", "y", "z"])).first()[0] == "y"
    two = classify.fit(ready.where("label <> 'y'"), "label", ["x", "y", "z"])
    assert all(r.p[1] == 0 and math.isclose(r.p[0] + r.p[2], 1) for r in two.probabilities(ready, "p").collect())
    assert classify.fit(ready.limit(0), "label", ["x", "y"]).known == ["x"]
    classify.save(classify.Folds([alone], [0.1]), f"{tmp_path}/m", spark)
    assert classify.load(f"{tmp_path}/m", spark).models[0].known == ["y"]


def test_word_probabilities_are_softmax_sums(spark):
    draw = np.random.default_rng(1)
    matrix, vectors = draw.normal(size=(7, 4)), draw.normal(size=(5, 4)) * 30
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id int, v array<double>")
    got = {r.id: (r.a, r.b) for r in models.word_probabilities(df, "v", ["id"], matrix, {"a": [0, 2], "b": [6]}).collect()}
    for i, v in enumerate(vectors):
        p = np.exp(matrix @ v - (matrix @ v).max())
        p /= p.sum()
        assert np.allclose(got[i], [np.log(p[[0, 2]].sum()), np.log(p[6])])


@pytest.mark.parametrize("small", [0, 10_000])
def test_tfidf_moves_each_count_twice_at_most(spark, rows, monkeypatch, small):
    monkeypatch.setattr(classify, "SMALL", small)
    df = spark.createDataFrame([(i, ["a", "b", "a", "", "b", "a"][: i % 7] or None) for i in range(40)], "id long, w array<string>")
    idf = df.sparkSession.createDataFrame([("a", 1.5), ("b", 2.5)], "term string, idf double")
    x = classify.tfidf(df, "id", "w", idf)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 1 and "Exchange hashpartitioning(key#" in plan and ", term#" not in plan.split("Exchange hashpartitioning(key", 1)[1].split(")")[0]
    got = {(r.key, r.term): r.x for r in x.collect()}
    for i in range(40):
        w = ["a", "b", "a", "", "b", "a"][: i % 7]
        raw = {t: w.count(t) * v for t, v in (("a", 1.5), ("b", 2.5)) if t in w}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        assert {t: v for (k, t), v in got.items() if k == i} == pytest.approx({t: v / norm for t, v in raw.items()})


def test_rows_with_one_key_count_together(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, ["b"])], "id long, w array<string>")
    idf = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "term string, idf double")
    got = {(r.key, r.term): r.x for r in classify.tfidf(df, "id", "w", idf).collect()}
    assert got == pytest.approx({(1, "a"): 2 / math.sqrt(5), (1, "b"): 1 / math.sqrt(5), (2, "b"): 1.0})
