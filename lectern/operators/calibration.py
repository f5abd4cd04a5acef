"""Calibration: equal-count and quantile bins of predicted probabilities, their errors, and what a loss is made of.

Places in an order come from one range partitioning with the key among the order's columns, so that equal probabilities don't meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scores import argmax_label
from lectern.storage import checkpoint

#: Rows of a bin, about.
BIN_ROWS = 50
EPSILON = 1e-6


def ordered_places(df: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """df with place, from 0 in each group by the order's columns, and among, the group's rows; stored.

    The rows are dealt by ranges of (group, order): a row's place is that in its partition and the rows of the group in the partitions before, of
    which only counts meet. The order should end with a key, or places among equal rows are any.
    """
    group = group or []
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = checkpoint(dealt.select("*", F.spark_partition_id().alias("part_"), own.alias("own_")))
    sizes = stored.groupBy("part_", *group).agg(F.count(F.lit(1)).alias("n_"), F.min("own_").alias("first_"))
    all_of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = all_of.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part_", *group, "first_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"), F.sum("n_").over(all_of).alias("among"))
    placed = stored.join(starts, ["part_", *group]).withColumn("place", F.col("own_") - F.col("first_") + F.col("start_"))
    return placed.drop("part_", "own_", "first_", "start_")


def equal_count_bin(place: Column, among: Column, bins: Column) -> Column:
    """Of `bins` bins of which number b begins at floor(b * among / bins), the one of this place."""
    return F.floor(((place + 1) * bins - 1) / among).cast("long")


def _mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def calibration_bins(df: DataFrame, label: str, p: str, key: str, weight: str | None = None, bins: int | None = None, more: int = 0) -> DataFrame:
    """By bin of equal counts in order of p: n, weight, mean p, share of label 1 and the difference; n // 50 + more bins (one at least) if not given."""
    some = df.select(F.col(p).alias("p"), F.col(label).cast("double").alias("y"), F.col(key).alias("key"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    count = F.lit(bins) if bins else F.greatest(F.floor(F.col("among") / BIN_ROWS) + more, F.lit(1))
    placed = ordered_places(some, ["p", "key"])
    binned = placed.withColumn("bin", equal_count_bin(F.col("place"), F.col("among"), F.least(count, F.col("among"))))
    means = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), _mean(F.col("p"), F.col("w")).alias("mean_p"), _mean(F.col("y"), F.col("w")).alias("share"))
    return means.withColumn("error", F.abs(F.col("share") - F.col("mean_p")))


def calibration(df: DataFrame, label: str, p: str, bins: int, key: str) -> DataFrame:
    """By bin of a given number, the place in order of p times bins over the rows: rows, mean p, share of label 1."""
    placed = ordered_places(df.select(F.col(p).alias("p"), F.col(label).cast("double").alias("y"), F.col(key).alias("key")), ["p", "key"])
    binned = placed.withColumn("bin", F.floor(F.col("place") * bins / F.col("among")).cast("long"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("share"))


def calibration_bins_multiclass(df: DataFrame, label: str, probs: dict[str, str], key: str, weight: str | None = None, least: int | None = None) -> DataFrame:
    """By predicted class and bin: n, weight and the mean absolute difference of shares and mean probabilities over all classes.

    Rows are dealt by the class with the largest probability, the first on ties; a class gets ceil(its weight / least) bins of equal counts in order of its
    probability, with least the larger of n // 50 and 1.5 times the number of predicted classes. The score is the mean error of the bins.
    """
    columns = [F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(probs.values())]
    truth = [(F.col(label) == F.lit(k)).cast("double").alias(f"y{i}") for i, k in enumerate(probs)]
    wide = df.select(F.col(key).alias("key"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), *columns, *truth)
    wide = wide.withColumn("predicted", argmax_label({k: F.col(f"p{i}") for i, k in enumerate(probs)}))
    wide = wide.withColumn("own", F.greatest(*[F.col(f"p{i}") for i in range(len(probs))]) if len(probs) > 1 else F.col("p0"))
    mass = {r["predicted"]: (r["n"], r["w"]) for r in wide.groupBy("predicted").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect()}  # a row a class
    if least is None:
        least = max(sum(n for n, _ in mass.values()) // BIN_ROWS, int(1.5 * sum(w > 0 for _, w in mass.values())))
    bins = F.lit(1)
    for k, (n, w) in mass.items():
        bins = F.when(F.col("predicted") == k, F.lit(max(1, min(n, math.ceil(w / max(least, 1)))))).otherwise(bins)
    placed = ordered_places(wide, ["own", "key"], ["predicted"])
    binned = placed.withColumn("bin", equal_count_bin(F.col("place"), F.col("among"), bins))
    apart = sum((F.abs(_mean(F.col(f"p{i}"), F.col("w")) - _mean(F.col(f"y{i}"), F.col("w"))) for i in range(len(probs))), F.lit(0.0)) / len(probs)
    return binned.groupBy("predicted", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), apart.alias("error"))


def _by_class(df: DataFrame, label: str, probs: dict[str, str], key: str, weight: str | None) -> DataFrame:
    """A row for each row and class: key, w, class, y (1 if it is the label), p."""
    each = [F.struct(F.lit(k).alias("class"), (F.col(label) == F.lit(k)).cast("double").alias("y"), F.col(c).cast("double").alias("p")) for k, c in probs.items()]
    return df.select(F.col(key).alias("key"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), F.inline(F.array(*each)))


def quantile_binned(rows: DataFrame, bins: int, adaptive: bool = True) -> DataFrame:
    """rows (class, p, key, ...) with bin: between the class's exact quantiles k / bins of p, interpolated, or in even steps of p; a bin holds its lower end."""
    if not adaptive:
        return rows.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    placed = ordered_places(rows, ["p", "key"], ["class"])
    steps = F.sequence(F.lit(1), F.lit(bins - 1)) if bins > 1 else F.array().cast("array<int>")
    at = F.transform(steps, lambda k: k * (F.col("among") - 1) / bins)
    # A row says something of those quantiles whose place is less than one from its own.
    near = F.filter(at, lambda x: F.abs(x - F.col("place")) < 1)
    cuts = placed.select("class", "p", F.explode(near).alias("x")).groupBy("class", "x").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    cuts = cuts.groupBy("class").agg(F.collect_list(F.col("low") + (F.col("high") - F.col("low")) * (F.col("x") - F.floor("x"))).alias("cuts"))
    return placed.join(F.broadcast(cuts), "class", "left").withColumn("bin", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("p"))), F.lit(0))).drop("cuts")


def brier_parts(df: DataFrame, label: str, p: str, key: str, weight: str | None = None, bins: int = 10, adaptive: bool = True) -> DataFrame:
    """One row whose parts add up to the weighted Brier loss: calibration, refinement, within (what rows of a bin lie apart); also root, the square root
    of calibration, and sharpness, the mean of p * (1 - p). Bins as in quantile_binned()."""
    rows = _by_class(df.withColumn("label_", F.col(label).cast("int")), "label_", {1: p}, key, weight)
    binned = quantile_binned(rows, bins, adaptive)
    w, y, q = F.col("w"), F.col("y"), F.col("p")
    by = binned.groupBy("bin").agg(
        F.sum("w").alias("w"), _mean(q, w).alias("mp"), _mean(y, w).alias("my"), _mean(q * q, w).alias("pp"), _mean(q * y, w).alias("py"), _mean(y * y, w).alias("yy")
    )
    apart = F.col("mp") - F.col("my")
    refined, loss = F.col("yy") - F.col("my") ** 2, F.col("pp") - 2 * F.col("py") + F.col("yy")
    total = lambda x: F.sum(x * F.col("w")) / F.sum("w")
    parts = by.agg(
        total(loss).alias("loss"), total(apart * apart).alias("calibration"), total(refined).alias("refinement"),
        total(loss - apart * apart - refined).alias("within"), total(F.col("mp") - F.col("pp")).alias("sharpness"),
    )
    return parts.withColumn("root", F.sqrt("calibration"))


def log_parts(df: DataFrame, label: str, probs: dict[str, str], key: str, weight: str | None = None, bins: int = 10, adaptive: bool = True, epsilon: float = EPSILON) -> DataFrame:
    """By class: loss (its share of the weighted log loss) = calibration + refinement + within, with root, the square root of calibration, and mass, the
    class's true weight (a class alone may be calibrated below 0, as its bins don't hold the other classes; its root is then 0); the loss of all classes is the sum, the calibration of all the mean root by mass. Probabilities count as epsilon at least."""
    w, y, q = F.col("w"), F.col("y"), F.greatest(F.col("p"), F.lit(epsilon))
    binned = quantile_binned(_by_class(df, label, probs, key, weight), bins, adaptive)
    by = binned.groupBy("class", "bin").agg(F.sum("w").alias("w"), _mean(q, w).alias("mp"), _mean(y, w).alias("my"), _mean(-y * F.ln(q), w).alias("loss"))
    told = lambda x: F.col("my") * F.ln(F.greatest(F.col("my"), F.lit(epsilon)) / x)
    total = lambda x: F.sum(x * F.col("w")) / F.sum("w")
    calibration, refinement = told(F.col("mp")), -told(F.lit(1.0))
    parts = by.groupBy("class").agg(
        total(F.col("loss")).alias("loss"), total(calibration).alias("calibration"), total(refinement).alias("refinement"),
        total(F.col("loss") - calibration - refinement).alias("within"), F.sum(F.col("my") * F.col("w")).alias("mass"),
    )
    return parts.withColumn("root", F.sqrt(F.greatest("calibration", F.lit(0.0))))


def log_calibration(parts: DataFrame) -> DataFrame:
    """One row from log_parts(): the loss, and the classes' roots averaged by their true mass."""
    return parts.agg(F.sum("loss").alias("loss"), (F.sum(F.col("root") * F.col("mass")) / F.sum("mass")).alias("calibration"))


def entropy_refinement(df: DataFrame, probs: list[str], weight: str | None = None, epsilon: float = EPSILON) -> DataFrame:
    """The weighted mean entropy of the predicted probabilities."""
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    h = sum((-F.col(c) * F.ln(F.greatest(F.col(c), F.lit(epsilon))) for c in probs), F.lit(0.0))
    return df.agg((F.sum(h * w) / F.sum(w)).alias("refinement"))
