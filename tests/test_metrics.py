import math

import numpy as np
import pytest

from lectern.operators import metrics


@pytest.fixture(scope="module")
def judged(spark):
    draw = np.random.default_rng(9)
    rows = []
    for i in range(300):
        p = draw.dirichlet([1, 2, 1])
        rows.append((i, "abc"[int(draw.choice(3, p=p))], "abc"[int(p.argmax())], *map(float, p), float(draw.integers(1, 4))))
    return rows, spark.createDataFrame([*rows, (900, None, "a", 0.3, 0.3, 0.4, 1.0)], "id long, y string, g string, a double, b double, c double, w double")


def plain(y, g, w, k):
    t, p, h = w[y == k].sum(), w[g == k].sum(), w[(y == k) & (g == k)].sum()
    return h / p if p else 0, h / t if t else 0, 2 * h / (t + p), t


def test_report(judged):
    rows, df = judged
    y, g, w = (np.array([r[i] for r in rows]) for i in (1, 2, 6))
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in metrics.report(df, "y", "g", "w").collect()}
    each = np.array([plain(y, g, w, k) for k in "abc"])
    assert all(np.allclose(got[k], each[i]) for i, k in enumerate("abc"))
    assert np.allclose(got["macro avg"][:3], each[:, :3].mean(axis=0)) and np.allclose(got["weighted avg"][:3], np.average(each[:, :3], axis=0, weights=each[:, 3]))
    assert np.allclose(got["accuracy"][:3], w[y == g].sum() / w.sum()) and len(got) == 6


def test_classes_that_are_never_right_or_never_true(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "c")], "y string, g string")
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in metrics.report(df, "y", "g").collect()}
    assert got["a"] == (0, 0, 0, 2) and got["b"] == (0, 0, 0, 0) and got["c"] == (1, 1, 1, 1)
    one = {r.metric: r.value for r in metrics.task_metrics(df.where("y = 'c'"), "cola", "y", "g").collect()}
    assert one == {"mcc": 0.0}


def test_tasks(spark, judged):
    rows, df = judged
    y, g = (np.array([r[i] for r in rows]) for i in (1, 2))
    assert {r.metric: r.value for r in metrics.task_metrics(df, "sst-2", "y", "g").collect()} == {"acc": (y == g).mean()}
    two = spark.createDataFrame([(int(a == "a"), int(b == "a")) for a, b in zip(y, g, strict=True)], "y int, g int")
    mcc = metrics.task_metrics(two, "cola", "y", "g").first().value
    assert math.isclose(mcc, np.corrcoef(y == "a", g == "a")[0, 1])
    corr = {r.metric: r.value for r in metrics.task_metrics(df, "sts-b", "a", "b").collect()}
    a, b = (np.array([r[i] for r in rows] + [0.3]) for i in (3, 4))
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    assert math.isclose(corr["pearson"], np.corrcoef(a, b)[0, 1]) and math.isclose(corr["spearmanr"], np.corrcoef(rank(a), rank(b))[0, 1])
    with pytest.raises(ValueError, match="no known task"):
        metrics.task_metrics(df, "other", "y", "g")


def test_metrics_by_name(judged):
    rows, df = judged
    df = df.where("id < 900")
    y, g, w = (np.array([r[i] for r in rows]) for i in (1, 2, 6))
    p = np.array([r[3:6] for r in rows])
    names = ["accuracy", "weighted_accuracy", "f1", "macro_f1", "per_class_f1", "cfm", "calibration-log-even-4", "calibration-brier-adaptive-5", "refinement-log", "refinement-brier"]
    got = {r.metric: r.value for r in metrics.compute(df, names, "y", "g", ["a", "b", "c"], "id", "w", {k: k for k in "abc"}).collect()}
    assert math.isclose(got["accuracy"], (y == g).mean()) and math.isclose(got["weighted_accuracy"], w[y == g].sum() / w.sum()) and math.isclose(got["f1"], got["weighted_accuracy"])
    assert all(math.isclose(got[f"f1-{k}"], plain(y, g, w, k)[2]) for k in "abc") and math.isclose(got["macro_f1"], np.mean([plain(y, g, w, k)[2] for k in "abc"]))
    assert all(got.get(f"cfm-{s}-{t}", 0) == ((y == s) & (g == t)).sum() for s in "abc" for t in "abc")
    b = p[:, 1]
    assert math.isclose(got["refinement-brier"], np.average(b * (1 - b), weights=w)) and math.isclose(got["refinement-log"], np.average(-(p * np.log(np.maximum(p, 1e-6))).sum(axis=1), weights=w))
    at = np.searchsorted(np.percentile(b, [20, 40, 60, 80]), b, "right")
    root = sum(w[at == k].sum() * (np.average(b[at == k], weights=w[at == k]) - np.average((y == "b")[at == k], weights=w[at == k])) ** 2 for k in range(5)) / w.sum()
    assert math.isclose(got["calibration-brier-adaptive-5"], math.sqrt(root)) and got["calibration-log-even-4"] >= 0
    two = {r.metric: r.value for r in metrics.compute(df.where("y <> 'c' and g <> 'c'"), ["f1"], "y", "g", ["a", "b"], "id", "w").collect()}
    both = (y != "c") & (g != "c")
    assert math.isclose(two["f1"], plain(y[both], g[both], w[both], "b")[2])
    for bad in ("other", "calibration-log", "refinement-x"):
        with pytest.raises(ValueError):
            metrics.compute(df, [bad], "y", "g", ["a", "b"], "id", probs={"b": "b"})
