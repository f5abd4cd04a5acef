"""Regressions and tests. Closed forms are aggregates; the rest uses pyspark.ml or one Python task a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.tails import t_tail
from lectern.operators.calibration import ordered_places
from lectern.operators.joins import SMALL
from lectern.storage import checkpoint


def slope_by(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Ordinary least squares by group: n, slope, intercept, standard error of the slope, t and its two-sided p."""
    out = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
    )
    rest = F.try_divide(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.col("n") - 2)
    se = F.sqrt(F.try_divide(F.greatest(rest, F.lit(0.0)), F.col("sxx")))
    out = out.withColumn("se", F.when(F.col("n") > 2, se)).withColumn("t", F.try_divide("slope", "se")).drop("sxx", "syy", "sxy")
    return out.withColumn("p", t_tail(F.col("t"), F.col("n") - 2))


def starred(slopes: DataFrame, tests: int, alpha: float = 0.05) -> DataFrame:
    """slopes with star: whether p is below alpha divided by the number of tests."""
    return slopes.withColumn("star", F.col("p") < alpha / tests)


def within_slope(df: DataFrame, group: str, y: str, x: str, w: str) -> DataFrame:
    """The weighted slope with fixed effects of the group, as one row: slope, n, robust_se, t; by deviations from weighted group means.

    The standard error is robust to unequal variances, with n / (n - groups - 1) for the degrees of freedom. Squared residuals are
    sums of powers of the deviations, so one pass after the means is enough. Means are aggregates, broadcast where groups are few; a null group is one of its own.
    """
    rows = df.select(F.col(group).alias("g"), F.col(w).cast("double").alias("w"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    weighted = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(f"m{c}")
    means = checkpoint(rows.groupBy("g").agg(weighted("y"), weighted("x")))
    means = F.broadcast(means) if means.count() <= SMALL else means
    on = F.col("g").eqNullSafe(F.col("g_"))
    dev = rows.join(means.withColumnRenamed("g", "g_"), on).select("g", "w", (F.col("y") - F.col("my")).alias("dy"), (F.col("x") - F.col("mx")).alias("dx"))
    wx = F.col("w") * F.col("dx")
    powers = {"xy": wx * F.col("dy"), "xx": wx * F.col("dx"), "x2y2": (wx * F.col("dy")) ** 2, "x3y": wx * wx * F.col("dx") * F.col("dy"), "x4": (wx * F.col("dx")) ** 2}
    sums = dev.groupBy("g").agg(*[F.sum(e).alias(c) for c, e in powers.items()], F.count(F.lit(1)).alias("n"))
    sums = sums.agg(*[F.sum(c).alias(c) for c in powers], F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    slope = F.col("xy") / F.col("xx")
    spread = F.greatest(F.col("x2y2") - 2 * slope * F.col("x3y") + slope * slope * F.col("x4"), F.lit(0.0))
    freedom = F.col("n") - F.col("groups") - 1
    se = F.when(freedom > 0, F.sqrt(spread * F.col("n") / freedom) / F.col("xx"))
    return sums.select(slope.alias("slope"), "n", se.alias("robust_se"), F.try_divide(slope, se).alias("t"))


def zscore(df: DataFrame, keys: list[str], x: str, out: str = "z") -> DataFrame:
    """By the sample's standard deviation. Means come from an aggregation, so no window gathers the table."""
    stats = df.groupBy(*keys).agg(F.avg(x).alias("m_"), F.stddev_samp(x).alias("s_"))
    joined = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    return joined.withColumn(out, F.try_divide(F.col(x) - F.col("m_"), F.col("s_"))).drop("m_", "s_")


def average_ranks(df: DataFrame, x: str, out: str) -> DataFrame:
    """df with ranks from 1, ties at their mean: places in ranges of the order, where equal values needn't meet in one task."""
    placed = ordered_places(df.select(x, F.xxhash64(*df.columns).alias("salt_")), [x, "salt_"])
    return df.join(placed.groupBy(x).agg((F.avg("place") + 1).alias(out)), x)


def beta_interval(df: DataFrame, keys: list[str], alpha: str, beta: str, draws: int = 100_000) -> DataFrame:
    """95% limits of beta distributions from draws, a pandas batch at a time."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", low double, high double"

    def run(batches):
        import numpy as np

        for b in batches:
            got = [np.percentile(np.random.default_rng(1).beta(x, y, draws), [2.5, 97.5]) for x, y in zip(b[alpha], b[beta], strict=True)]
            out = b[keys].copy()
            out["low"], out["high"] = [g[0] for g in got], [g[1] for g in got]
            yield out

    return df.mapInPandas(run, schema)


def logistic_by(df: DataFrame, key: str, y: str, xs: list[str], rounds: int = 25) -> DataFrame:
    """A logistic regression for each group by Newton's method, on aggregates that a group's rows were reduced to.

    Rows of one group are first counted by (y, xs), so a large group with few distinct rows is small.
    """
    cells = df.groupBy(key, y, *xs).agg(F.count(F.lit(1)).alias("n"))
    kind = dict(df.dtypes)[key]

    def run(name, pdf):
        import numpy as np
        import pandas as pd

        x = np.column_stack([np.ones(len(pdf)), pdf[xs].to_numpy(float)])
        t, w, b = pdf[y].to_numpy(float), pdf["n"].to_numpy(float), np.zeros(len(xs) + 1)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(len(b))
            b = b + np.linalg.solve(h, x.T @ (w * (t - p)) - 1e-6 * b)
        return pd.DataFrame([[name[0], *b]], columns=[key, "intercept", *[f"b_{c}" for c in xs]])

    return cells.groupBy(key).applyInPandas(run, f"{key} {kind}, intercept double, " + ", ".join(f"b_{c} double" for c in xs))
