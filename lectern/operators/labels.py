"""Annotations: agreement, splits, assignment and evaluation. Random orders are orders of a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: int, *columns: str) -> Column:
    """The same order in any engine and at any partitioning."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def krippendorff_alpha(ratings: DataFrame, item: str, worker: str, response: str, order: str | None = None) -> DataFrame:
    """Nominal agreement as one row; of repeated ratings by a worker the last counts."""
    if order:
        ratings = ratings.groupBy(item, worker).agg(F.max_by(response, order).alias(response))
    counts = ratings.groupBy(item, response).agg(F.count(F.lit(1)).alias("c"))
    items = counts.groupBy(item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).where("n > 1")
    observed = items.agg(F.sum((F.col("n") * F.col("n") - F.col("sq")) / 2 / (F.col("n") - 1)).alias("d"), F.sum("n").alias("n"))
    totals = counts.join(items.select(item), item).groupBy(response).agg(F.sum("c").alias("c"))
    totals = totals.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    expected = totals.select(((F.col("n") * F.col("n") - F.col("sq")) / 2 / (F.col("n") * (F.col("n") - 1))).alias("de"))
    return observed.crossJoin(expected).select((1 - F.col("d") / F.col("n") / F.col("de")).alias("alpha"))


def nearest(df: DataFrame, column: str, options: list[str], overrides: dict[str, str] | None = None) -> DataFrame:
    """df with `nearest`: the option at least edit distance, the first on ties; overrides come first."""
    best = F.array_min(F.array(*[F.struct(F.levenshtein(column, F.lit(o)).alias("d"), F.lit(i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(options)]))
    out = best["o"]
    for wrong, right in (overrides or {}).items():
        out = F.when(F.col(column) == wrong, right).otherwise(out)
    return df.withColumn("nearest", out)


def numbered(df: DataFrame, group: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """df with rn, its place from 1 in each group, by an order that goes through the buckets in turn.

    Each bucket is a window of its own; only one row a bucket meets to add up where each begins.
    """
    some = df.withColumn("b_", bucket)
    sizes = some.groupBy(*group, "b_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "b_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    own = F.row_number().over(Window.partitionBy(*group, "b_").orderBy(*order))
    return some.withColumn("rn", own).join(starts, [*group, "b_"]).withColumn("rn", F.col("rn") + F.col("start_")).drop("b_", "start_")


def ranked(df: DataFrame, key: str, seed: int, within: list[str] | None = None) -> DataFrame:
    """df with rn, its place in the hash order (of each group)."""
    place = shuffle_key(seed, key)
    return numbered(df, within or [], F.substring(place, 1, 3), [place, F.col(key)])


def split_n_way(rn: Column, n: Column, pieces: int) -> Column:
    """Pieces of equal size by place; the last takes the remainder."""
    return F.least(F.floor((rn - 1) / F.greatest(F.floor(n / pieces), F.lit(1))), F.lit(pieces - 1)).cast("long")


def repeated_folds(df: DataFrame, key: str, folds: int, test_share: float) -> DataFrame:
    """Each row once a fold, with whether it is in that fold's test part; folds are drawn independently."""
    each = df.select(key).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    place = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("fold").cast("string")))
    n = df.select(F.count(F.lit(1)).alias("n_"))
    placed = numbered(each, ["fold"], F.substring(place, 1, 3), [place, F.col(key)]).crossJoin(F.broadcast(n))
    return placed.select(key, "fold", (F.col("rn") <= F.floor(F.col("n_") * test_share)).cast("int").alias("test"))


def round_robin(df: DataFrame, key: str, teams: list[list[str]], seed: int) -> DataFrame:
    """(key, annotator): items go around the teams in hash order, each to all members of its team."""
    table = F.array(*[F.array(*map(F.lit, t)) for t in teams])
    placed = ranked(df.select(key), key, seed)
    return placed.select(key, F.explode(F.get(table, ((F.col("rn") - 1) % len(teams)).cast("int"))).alias("annotator"))


def f1_by_class(df: DataFrame, true: str, pred: str, weight: str) -> DataFrame:
    """(label, f1): weighted; 0 without true positives."""
    sides = df.select(F.explode(F.array(F.struct(F.col(true).alias("label"), F.lit(1).alias("t")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("t")))).alias("s"), (F.col(true) == F.col(pred)).alias("hit"), F.col(weight).alias("w"))
    sums = sides.groupBy(F.col("s.label").alias("label")).agg(F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)).alias("tp2"), F.sum("w").alias("all"))
    return sums.select("label", (F.col("tp2") / F.col("all")).alias("f1"))


def f1_scores(df: DataFrame, true: str, pred: str, weight: str, positive: object = 1) -> DataFrame:
    """One row (binary, micro, macro, weighted): F1 of the positive label, 0 without its true positives; over all rows; the mean over labels; that by true weight."""
    sides = F.array(F.struct(F.col(true).alias("label"), F.lit(True).alias("t")), F.struct(F.col(pred).alias("label"), F.lit(False).alias("t")))
    each = df.select(F.explode(sides).alias("s"), (F.col(true) == F.col(pred)).alias("hit"), F.col(weight).cast("double").alias("w"))
    some = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    sums = each.groupBy(F.col("s.label").alias("label")).agg(some(F.col("hit")).alias("tp2"), F.sum("w").alias("both"), some(F.col("s.t")).alias("true"))
    f1 = F.col("tp2") / F.col("both")
    return sums.agg(
        F.coalesce(F.max(F.when(F.col("label") == positive, f1)), F.lit(0.0)).alias("binary"), (F.sum("tp2") / F.sum("both")).alias("micro"),
        F.avg(f1).alias("macro"), (F.sum(f1 * F.col("true")) / F.sum("true")).alias("weighted"),
    )


def draw_terms(counts: DataFrame, term: str, count: str, least: int, n: int, seed: int, known: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """n terms, first in hash order, of those with at least `least` uses that are in `known` and not in `excluded`."""
    some = counts.where(F.col(count) >= least)
    if known is not None:
        some = some.join(known.select(term), term, "left_semi")
    if excluded is not None:
        some = some.join(excluded.select(term), term, "left_anti")
    return some.orderBy(shuffle_key(seed, term), term).limit(n)
