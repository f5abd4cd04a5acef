import math

import numpy as np
import pytest

from lectern.operators import calibration as cal


@pytest.fixture(scope="module")
def scored(spark):
    draw = np.random.default_rng(4)
    rows = []
    for i in range(700):
        z = draw.normal(size=3) * [1.5, 1, 0.5]
        p = np.exp(z) / np.exp(z).sum() if i % 3 else np.array([0.5, 0.25, 0.25])  # a third of all rows tie
        rows.append((i, int(draw.choice(3, p=p)), *map(float, p), float(draw.integers(1, 4))))
    return rows, spark.createDataFrame(rows, "id long, y int, p0 double, p1 double, p2 double, w double").repartition(5)


def test_places_are_gapless_in_order(spark, scored):
    rows, df = scored
    got = {(r.y, r.id): (r.place, r.among) for r in cal.ordered_places(df, ["p0", "id"], ["y"]).collect()}
    for y in range(3):
        mine = sorted((r[2], r[0]) for r in rows if r[1] == y)
        assert [got[y, i] for _, i in mine] == [(k, len(mine)) for k in range(len(mine))]
    assert cal.ordered_places(df.limit(0), ["p0"]).count() == 0


def test_multiclass_bins_follow_predicted_mass(scored):
    rows, df = scored
    p, y, w = np.array([r[2:5] for r in rows]), np.array([r[1] for r in rows]), np.array([r[5] for r in rows])
    top = p.argmax(axis=1)
    mass = np.bincount(top, weights=w, minlength=3)
    least = max(len(rows) // 50, int(1.5 * (mass > 0).sum()))
    want = {}
    for c in range(3):
        bins = math.ceil(mass[c] / least)
        mine = np.array(sorted(np.flatnonzero(top == c), key=lambda i: (p[i, c], i)))
        cuts = [b * len(mine) // bins for b in range(bins)] + [len(mine)]
        for b in range(bins):
            i = mine[cuts[b] : cuts[b + 1]]
            apart = np.average(p[i], axis=0, weights=w[i]) - np.average(np.eye(3)[y[i]], axis=0, weights=w[i])
            want[str(c), b] = (len(i), np.abs(apart).mean())
    got = {(str(r.predicted), r.bin): (r.n, r.error) for r in cal.calibration_bins_multiclass(df, "y", {0: "p0", 1: "p1", 2: "p2"}, "id", "w").collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_few_rows_have_few_bins(spark):
    df = spark.createDataFrame([(1, 1, 0.7), (2, 0, 0.2)], "id long, y int, p double")
    assert [(r.n, round(r.error, 6)) for r in cal.calibration_bins(df, "y", "p", "id").collect()] == [(2, 0.05)]
    assert sorted(r.n for r in cal.calibration_bins(df, "y", "p", "id", bins=9).collect()) == [1, 1]


@pytest.mark.parametrize("adaptive", [True, False])
def test_brier_parts_add_up(scored, adaptive):
    rows, df = scored
    p, y, w = np.array([r[2] for r in rows]), np.array([float(r[1] == 1) for r in rows]), np.array([r[5] for r in rows])
    bins = 7
    edges = np.percentile(p, 100 * np.arange(1, bins) / bins) if adaptive else np.arange(1, bins) / bins
    at = np.searchsorted(edges, p, "right")
    calibration = sum(w[at == b].sum() * (np.average(p[at == b], weights=w[at == b]) - np.average(y[at == b], weights=w[at == b])) ** 2 for b in set(at)) / w.sum()
    got = cal.brier_parts(df.selectExpr("*", "y = 1 as hit"), "hit", "p0", "id", "w", bins, adaptive).first()
    assert abs(got.loss - np.average((p - y) ** 2, weights=w)) < 1e-12 and abs(got.calibration - calibration) < 1e-12
    assert abs(got.calibration + got.refinement + got.within - got.loss) < 1e-12 and abs(got.root - math.sqrt(calibration)) < 1e-12
    assert abs(got.sharpness - np.average(p * (1 - p), weights=w)) < 1e-12


def test_log_parts_add_up(scored):
    rows, df = scored
    p, y, w = np.array([r[2:5] for r in rows]), np.array([r[1] for r in rows]), np.array([r[5] for r in rows])
    parts = cal.log_parts(df, "y", {0: "p0", 1: "p1", 2: "p2"}, "id", "w")
    got = {r["class"]: r for r in parts.collect()}
    loss = -np.log(p[np.arange(len(y)), y])
    assert abs(sum(r.loss for r in got.values()) - np.average(loss, weights=w)) < 1e-12
    for c, r in got.items():
        assert abs(r.calibration + r.refinement + r.within - r.loss) < 1e-12 and abs(r.mass - w[y == c].sum()) < 1e-9
        at, hit = np.searchsorted(np.percentile(p[:, c], np.arange(10, 100, 10)), p[:, c], "right"), (y == c).astype(float)
        want = 0
        for b in set(at):
            mp, my = (np.average(x[at == b], weights=w[at == b]) for x in (p[:, c], hit))
            want += w[at == b].sum() / w.sum() * (my * math.log(my / mp) if my else 0)
        assert abs(r.calibration - want) < 1e-12
    one = cal.log_calibration(parts).first()
    assert abs(one.calibration - sum(math.sqrt(max(0, r.calibration)) * r.mass for r in got.values()) / w.sum()) < 1e-12
    sure = cal.entropy_refinement(df, ["p0", "p1", "p2"], "w").first().refinement
    assert abs(sure - np.average(-(p * np.log(p)).sum(axis=1), weights=w)) < 1e-12
