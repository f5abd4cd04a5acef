"""Least squares with two sets of fixed effects and errors robust to unequal variances.

Effects are found by demeaning in turn by each factor, on one row a cell (pair of levels) with the cell's sums: rows are read once before and twice
after. Only k x k sums over all rows come to the driver, for k regressors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.tails import t_tail
from lectern.storage import checkpoint


def _means(cells: DataFrame, factor: str, other: str, effects: DataFrame | None, n: int) -> DataFrame:
    """(factor, e0..): the weighted means by level of what the other factor's effects leave."""
    some = cells if effects is None else cells.join(effects, other)
    left = [F.col(f"s{i}") - (F.col("w") * F.col(f"e{i}") if effects is not None else F.lit(0.0)) for i in range(n)]
    return some.groupBy(factor).agg(*[(F.sum(x) / F.sum("w")).alias(f"e{i}") for i, x in enumerate(left)])


def _components(cells: DataFrame) -> int:
    """How many parts of the cells share no level with another: each takes one constant."""
    links = cells.select("g", "h")
    marks = checkpoint(links.select("g").distinct().withColumn("mark", F.xxhash64("g")))
    while True:
        by_h = links.join(marks, "g").groupBy("h").agg(F.min("mark").alias("mark"))
        after = checkpoint(links.join(by_h, "h").groupBy("g").agg(F.min("mark").alias("mark")))
        if not after.join(marks.withColumnRenamed("mark", "was"), "g").where("mark <> was").take(1):
            return after.select("mark").distinct().count()
        marks = after


def two_way(df: DataFrame, y: str, xs: list[str], first: str, second: str, weight: str | None = None, tolerance: float = 1e-11, rounds: int = 500) -> DataFrame:
    """A row for each regressor: term, estimate, robust_se, t, p, n, freedom, r2, with effects of the levels of two factors taken out.

    Equal to least squares on xs and a dummy for each level. Errors are those of White with n / freedom, freedom being n less all coefficients,
    constants of unconnected parts counted. Rows with a null in any of the columns are left out. Demeaning ends when no effect moves by more than
    `tolerance` of its variable's spread; ValueError if it doesn't within `rounds`, if regressors depend on each other and the effects, or without
    degrees of freedom.
    """
    names, k = [y, *xs], len(xs)
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    rows = df.select(F.col(first).alias("g"), F.col(second).alias("h"), w.alias("w"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]).na.drop()
    cells = checkpoint(rows.groupBy("g", "h").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"v{i}")).alias(f"s{i}") for i in range(k + 1)]))
    spread = [F.stddev_pop(f"v{i}") for i in range(k + 1)]
    n, total, *scale = rows.agg(F.count(F.lit(1)), F.sum("w"), *spread).first()
    if not n:
        raise ValueError("no rows without nulls")
    effects = checkpoint(_means(cells, "h", "g", None, k + 1))
    for _ in range(rounds):
        by_g = _means(cells, "g", "h", effects, k + 1)
        after = checkpoint(_means(cells, "h", "g", by_g, k + 1))
        was = effects.select("h", *[F.col(f"e{i}").alias(f"was{i}") for i in range(k + 1)])
        moved = after.join(was, "h").agg(*[F.max(F.abs(F.col(f"e{i}") - F.col(f"was{i}"))) for i in range(k + 1)]).first()
        effects = after
        if all(m <= tolerance * (s or 1.0) for m, s in zip(moved, scale, strict=True)):
            break
    else:
        raise ValueError(f"demeaning hasn't settled in {rounds} rounds")
    by_g = checkpoint(_means(cells, "g", "h", effects, k + 1)).withColumnsRenamed({f"e{i}": f"a{i}" for i in range(k + 1)})
    left = rows.join(by_g, "g").join(effects, "h").select("w", F.col("v0").alias("y"), *[(F.col(f"v{i}") - F.col(f"a{i}") - F.col(f"e{i}")).alias(f"r{i}") for i in range(k + 1)])

    def products(scaled: Column, several: range) -> list[Column]:
        return [F.sum(scaled * F.col(f"r{i}") * F.col(f"r{j}")) for i in several for j in several]

    found = left.agg(*products(F.col("w"), range(k + 1)), F.sum(F.col("w") * F.col("y")), F.sum(F.col("w") * F.col("y") * F.col("y"))).first()
    cross, mean, square = np.array(found[:-2], float).reshape(k + 1, k + 1), found[-2] / total, found[-1]
    bread = cross[1:, 1:]
    size = np.sqrt(total) * np.array([s or 1.0 for s in scale[1:]])
    if np.linalg.matrix_rank(bread / np.outer(size, size), tol=1e-9, hermitian=True) < k:
        raise ValueError("regressors depend on each other or on the effects")
    estimate = np.linalg.solve(bread, cross[1:, 0])
    rest = F.col("r0") - sum((F.lit(float(b)) * F.col(f"r{i + 1}") for i, b in enumerate(estimate)), F.lit(0.0))
    scaled = (F.col("w") * rest) ** 2
    *meat, lost = left.agg(*products(scaled, range(1, k + 1)), F.sum(F.col("w") * rest * rest)).first()
    levels = [cells.select(c).distinct().count() for c in "gh"]
    freedom = n - k - sum(levels) + _components(cells)
    if freedom <= 0:
        raise ValueError("no degrees of freedom")
    inverse = np.linalg.inv(bread)
    se = np.sqrt(np.diag(inverse @ np.array(meat, float).reshape(k, k) @ inverse) * n / freedom)
    r2 = 1 - lost / (square - total * mean * mean)
    told = [(c, float(b), float(s), float(b / s) if s else None, n, freedom, float(r2)) for c, b, s in zip(xs, estimate, se, strict=True)]
    out = df.sparkSession.createDataFrame(told, "term string, estimate double, robust_se double, t double, n long, freedom long, r2 double")
    return out.withColumn("p", t_tail(F.col("t"), F.col("freedom")))
