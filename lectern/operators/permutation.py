"""Permutation tests with groups of exact size in every replicate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different values of a leaf, and the most leaves.
LEAF, LEAVES = 8192, 4096
#: Rows up to which the draws are defined.
MOST = 10**9


def permuted_sums(cells: DataFrame, n_first: int, replicates: int, seed: int) -> DataFrame:
    """(rep, taken, total): of the rows (value, n), how many each replicate puts into the first group, which is n_first, and the sum of their values.

    Values are dealt to leaves of a binary tree. A replicate's share of the first group goes down it by hypergeometric draws, which every task
    repeats for its own path from the seeds of the nodes; in a leaf it goes from value to value. All replicates are drawn at once as vectors.
    """
    leaves = min(LEAVES, max(1, math.ceil(cells.count() / LEAF)))
    dealt = cells.withColumn("leaf", F.pmod(F.xxhash64("value"), F.lit(leaves)).cast("int"))
    rows = {r["leaf"]: r["n"] for r in dealt.groupBy("leaf").agg(F.sum("n").alias("n")).collect()}  # a row a leaf, LEAVES at most
    before = [0]
    for i in range(leaves):
        before.append(before[-1] + rows.get(i, 0))
    if before[-1] >= MOST:
        raise ValueError(f"{before[-1]} rows; draws are defined below {MOST}")

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        leaf, need = int(key[0]), np.full(replicates, n_first, np.int64)
        low, high = 0, leaves
        while high - low > 1:
            mid = (low + high) // 2
            left, right = before[mid] - before[low], before[high] - before[mid]
            taken = np.random.default_rng([seed, low, high]).hypergeometric(left, right, need) if left and right else need if left else 0 * need
            low, high, need = (low, mid, taken) if leaf < mid else (mid, high, need - taken)
        draw, total, all_taken = np.random.default_rng([seed, leaf]), np.zeros(replicates), need.copy()
        pdf, rest = pdf.sort_values("value"), int(pdf["n"].sum())
        for value, n in zip(pdf["value"].tolist(), pdf["n"].tolist(), strict=True):
            if n == rest:
                taken = need
            elif n == 1:
                taken = (draw.random(replicates) * rest < need).astype(np.int64)
            else:
                taken = draw.hypergeometric(n, rest - n, need)
            total += value * taken
            need, rest = need - taken, rest - n
        return pd.DataFrame({"rep": np.arange(1, replicates + 1), "taken": all_taken, "total": total})

    parts = dealt.groupBy("leaf").applyInPandas(run, "rep int, taken long, total double")
    return parts.groupBy("rep").agg(F.sum("taken").alias("taken"), F.sum("total").alias("total"))


def permutation_test(df: DataFrame, value: str, group: str, replicates: int = 20_000, seed: int = 42) -> DataFrame:
    """One row: seen, the mean of group 1 less that of group 0; p_value, the share of replicates whose difference is at least as far on seen's side of 0;
    replicates; n_first and n_second, the groups' sizes; least_first and most_first, the least and the largest first group of a replicate.

    Replicates deal all rows anew to groups of the given sizes. Rows with a null value or another group are left out; p_value is null without both groups.
    """
    rows = df.select(F.col(value).cast("double").alias("value"), F.col(group).alias("g")).where(F.col("value").isNotNull() & F.col("g").isin(0, 1))
    cells = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") == 1).alias("first"))
    n, first, total, one = cells.agg(F.sum("n"), F.sum("first"), F.sum(F.col("value") * F.col("n")), F.sum(F.col("value") * F.col("first"))).first()
    schema = "seen double, p_value double, replicates long, n_first long, n_second long, least_first long, most_first long"
    if not n or first in (0, n):
        return df.sparkSession.createDataFrame([(None, None, replicates, first or 0, (n or 0) - (first or 0), None, None)], schema)
    seen = one / first - (total - one) / (n - first)
    diff = F.col("total") / first - (F.lit(total) - F.col("total")) / (n - first)
    near = 1e-9 * max(abs(seen), abs(total) / n)  # sums of the same values differ in their last digits
    as_far = diff >= seen - near if seen > 0 else diff <= seen + near
    sums = permuted_sums(cells.select("value", "n"), first, replicates, seed)
    return sums.agg(
        F.lit(seen).alias("seen"), F.avg(as_far.cast("double")).alias("p_value"), F.count(F.lit(1)).alias("replicates"), F.lit(first).cast("long").alias("n_first"),
        F.lit(n - first).cast("long").alias("n_second"), F.min("taken").alias("least_first"), F.max("taken").alias("most_first"),
    )
