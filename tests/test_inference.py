import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.tails import t_tail
from lectern.operators import effects, models, permutation, stats


def test_t_tail_against_closed_forms_and_known_values(spark):
    # Two-sided tails from printed tables of Student's t.
    known = [(12.706204736, 1, 0.05), (4.302652730, 2, 0.05), (2.570581836, 5, 0.05), (2.228138852, 10, 0.05), (2.042272456, 30, 0.05), (1.983971519, 100, 0.05), (3.169272673, 10, 0.01), (1.961463, 10_000, 0.0498494)]
    rows = [(t, float(n), p) for t, n, p in known[:7]]
    for t in (0.001, 0.3, 1.0, 2.5, 9.0, 60.0, 1e6):
        rows += [(t, 1.0, 1 - 2 / math.pi * math.atan(t)), (-t, 2.0, 1 - t / math.sqrt(2 + t * t))]
        a = math.atan(t / math.sqrt(5))
        rows.append((t, 5.0, 1 - 2 / math.pi * (a + math.sin(a) * (math.cos(a) + 2 / 3 * math.cos(a) ** 3))))
        if t < 30:  # a normal tail and the first two terms of its expansion
            z, n = t, 1e6
            half = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * ((z**3 + z) / (4 * n) + (3 * z**7 - 5 * z**5 - 5 * z**3 - 3 * z) / (96 * n * n))
            rows.append((t, n, math.erfc(z / math.sqrt(2)) + 2 * half))
    df = spark.createDataFrame(rows, "t double, df double, p double")
    for r in df.withColumn("got", t_tail(F.col("t"), F.col("df"))).collect():
        assert math.isclose(r.got, r.p, rel_tol=1e-6, abs_tol=2e-10), r
    odd = spark.createDataFrame([(float("nan"), 3.0), (None, 3.0), (1.0, None), (1.0, 0.0), (0.0, 4.0), (float("inf"), 4.0)], "t double, df double")
    assert [r[0] for r in odd.select(t_tail(F.col("t"), F.col("df"))).collect()] == [None, None, None, None, 1.0, 0.0]


def test_star_needs_p_below_the_share_of_alpha(spark):
    draw = np.random.default_rng(0)
    rows = [(k, float(x), k * x + float(draw.normal()) * 5) for k in range(4) for x in range(12)]
    got = stats.starred(stats.slope_by(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "y", "x"), 28).collect()
    assert all(r.star == (r.p < 0.05 / 28) for r in got) and {r.star for r in got} == {True, False}


def dummies(y, x, g, h, w):
    """Least squares with a dummy for each level and errors robust by n / (n - rank)."""
    levels = [np.array([[float(v == u) for u in sorted(set(f))] for v in f]) for f in (g, h)]
    design, root = np.column_stack([x, *levels]), np.sqrt(w)[:, None]
    inverse = np.linalg.pinv((design * w[:, None]).T @ design)
    b = inverse @ (design * w[:, None]).T @ y
    scores = design * (w * (y - design @ b))[:, None]
    n, rank = len(y), np.linalg.matrix_rank(design * root)
    cov = inverse @ scores.T @ scores @ inverse * n / (n - rank)
    k = x.shape[1]
    return b[:k], np.sqrt(np.diag(cov))[:k], n - rank


@pytest.mark.parametrize("weighted,parts", [(False, 1), (True, 1), (True, 2)])
def test_two_way_effects_equal_dummies(spark, weighted, parts):
    draw = np.random.default_rng(8)
    n = 300
    g = draw.integers(0, 12, n)
    h = draw.integers(0, 5, n) + 100 * (g % parts)  # levels of different parts never meet
    x = draw.normal(size=(n, 2)) + (g % 5)[:, None]
    y = x @ [1.5, -0.5] + g * 0.3 - h * 0.01 + draw.normal(size=n) * (1 + np.abs(x[:, 0]))
    w = draw.integers(1, 5, n).astype(float) if weighted else np.ones(n)
    rows = [(float(y[i]), float(x[i, 0]), float(x[i, 1]), f"g{g[i]}", int(h[i]), float(w[i])) for i in range(n)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, "g1", 1, 1.0), (1.0, 1.0, 1.0, None, 1, 1.0)], "y double, a double, b double, g string, h int, w double")
    want = dummies(y, x, g, h, w)
    got = effects.two_way(df, "y", ["a", "b"], "g", "h", "w" if weighted else None).collect()
    assert np.allclose([r.estimate for r in got], want[0], rtol=1e-8) and np.allclose([r.robust_se for r in got], want[1], rtol=1e-8)
    assert {r.freedom for r in got} == {want[2]} and {r.n for r in got} == {n} and all(0 <= r.p <= 1 and 0 < r.r2 < 1 for r in got)


def test_two_way_says_what_it_cannot_fit(spark):
    rows = [(float(i), float(i % 4), i % 3, i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "y double, x double, g int, h int")
    with pytest.raises(ValueError, match="depend"):
        effects.two_way(df, "y", ["x"], "g", "h")
    with pytest.raises(ValueError, match="no rows"):
        effects.two_way(df.limit(0), "y", ["x"], "g", "h")


def test_group_means_take_no_window_and_null_groups_count(spark):
    draw = np.random.default_rng(2)
    rows = [(["a", "b", None][i % 3], float(draw.normal()), float(draw.normal()), 1.0 + i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, y double, x double, w double")
    got = stats.within_slope(df, "g", "y", "x", "w").first()
    y, x, w = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    b, se, _ = dummies(y, x[:, None], np.arange(90) % 3, np.zeros(90), w)
    assert math.isclose(got.slope, b[0], rel_tol=1e-9) and math.isclose(got.robust_se, se[0], rel_tol=1e-9) and got.n == 90


def test_replicates_have_exact_sizes_and_the_exact_distribution(spark, monkeypatch):
    values = [0.1, 0.4, 0.4, 0.9, 1.6, 2.5, 3.6, 4.9, 6.4]
    first = [3, 6, 7, 8]
    df = spark.createDataFrame([(v, int(i in first)) for i, v in enumerate(values)] + [(None, 1), (1.0, None), (1.0, 2)], "v double, g int")
    diffs = [np.mean([values[i] for i in c]) - np.mean([values[i] for i in range(9) if i not in c]) for c in itertools.combinations(range(9), 4)]
    seen = np.mean([values[i] for i in first]) - np.mean([values[i] for i in range(9) if i not in first])
    exact = np.mean(np.array(diffs) >= seen - 1e-12)
    for leaf in (8192, 1):  # one leaf; a leaf a value, so that the tree deals them
        monkeypatch.setattr(permutation, "LEAF", leaf)
        r = permutation.permutation_test(df, "v", "g", 20_000).first()
        assert (r.least_first, r.most_first, r.n_first, r.n_second, r.replicates) == (4, 4, 4, 5, 20_000)
        assert math.isclose(r.seen, seen) and abs(r.p_value - exact) < 4 * math.sqrt(exact * (1 - exact) / 20_000)
    cells = df.where("v is not null and g < 2").groupBy(F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sums = np.array([x.total for x in permutation.permuted_sums(cells, 4, 20_000, 1).collect()])
    want = np.array([sum(values[i] for i in c) for c in itertools.combinations(range(9), 4)])
    assert abs(sums.mean() - want.mean()) < 4 * want.std() / math.sqrt(20_000) and abs(sums.std() / want.std() - 1) < 0.03


def test_permutation_on_the_other_side_and_without_a_group(spark):
    df = spark.createDataFrame([(float(i), int(i < 10)) for i in range(40)], "v double, g int")
    r = permutation.permutation_test(df, "v", "g", 500).first()
    assert r.seen < 0 and r.p_value == 0 and (r.least_first, r.most_first) == (10, 10)
    none = permutation.permutation_test(df.where("g = 1"), "v", "g", 500).first()
    assert none.seen is None and none.p_value is None and (none.n_first, none.n_second) == (10, 0)


def test_ranks_of_ties_are_their_mean(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate([3.0, 1.0, 3.0, 2.0, 3.0, 1.0])], "x double, i int")
    assert {r.i: r.r for r in stats.average_ranks(df, "x", "r").collect()} == {0: 5, 1: 1.5, 2: 5, 3: 3, 4: 5, 5: 1.5}


def test_specs_give_standard_errors(spark):
    draw = np.random.default_rng(3)
    x, g = draw.normal(size=(900, 2)), draw.integers(0, 3, 900)
    y = (draw.random(900) < 1 / (1 + np.exp(-(x @ [1.0, -0.5] + 0.3 + (g == 1) * (0.5 - x[:, 0]))))).astype(float)
    rows = [(float(a), float(b), "uvw"[k], float(c)) for (a, b), k, c in zip(x, g, y, strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, "u", 1.0)], "a double, b double, g string, y double")
    got = {(r.spec, r.term): r for r in models.interaction_specs(df, "y", "a", "g", "w", {"one": [], "two": ["b"]}).collect()}
    u, v = (g == 0).astype(float), (g == 1).astype(float)
    design, b = np.column_stack([x[:, 0], u, v, u * x[:, 0], v * x[:, 0], x[:, 1], np.ones(900)]), np.zeros(7)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ b))
        h = (design * (p * (1 - p))[:, None]).T @ design
        b += np.linalg.solve(h, design.T @ (y - p))
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    for term, e, s in zip(("a", "g_u", "g_v", "a:g_u", "a:g_v", "b", "(Intercept)"), b, se, strict=True):
        r = got["two", term]
        assert math.isclose(r.estimate, e, rel_tol=1e-5) and math.isclose(r.se, s, rel_tol=1e-5)
        assert math.isclose(r.p, math.erfc(abs(e / s) / math.sqrt(2)), rel_tol=1e-3, abs_tol=1e-9)
    assert len(got) == 13
    with pytest.raises(ValueError, match="no level"):
        models.interaction_specs(df, "y", "a", "g", "x", {"one": []})
    with pytest.raises(ValueError, match="depend"):
        models.interaction_specs(df.withColumn("c", 2 * F.col("b")), "y", "a", "g", "w", {"one": ["b", "c"]})
