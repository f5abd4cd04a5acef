"""Metrics by name: from one table of counts by true and predicted class, or from scores; reports and the metrics of known tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import calibration, stats

# The metrics of public benchmark tasks.
TASKS = {
    "cola": ("mcc",), "sst-2": ("acc",), "mrpc": ("acc", "micro_f1", "macro_f1", "acc_and_macro_f1"), "sts-b": ("pearson", "spearmanr", "corr"),
    "qqp": ("acc", "micro_f1", "macro_f1", "acc_and_macro_f1"), "mnli": ("acc",), "mnli-mm": ("acc",), "qnli": ("acc",), "rte": ("acc",), "wnli": ("acc",), "hans": ("acc",),
}


def confusion(df: DataFrame, label: str, predicted: str, weight: str | None = None) -> DataFrame:
    """(true, predicted, n): the weight of rows by class and predicted class; rows without either are left out."""
    w = (F.col(weight) if weight else F.lit(1)).cast("double")
    some = df.select(F.col(label).cast("string").alias("true"), F.col(predicted).cast("string").alias("predicted"), w.alias("w")).na.drop()
    return some.groupBy("true", "predicted").agg(F.sum("w").alias("n"))


def by_class(cells: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from confusion(): 0 where a class is never predicted, or never true."""
    sides = F.array(F.struct(F.col("true").alias("label"), F.col("n").alias("t"), F.lit(0.0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0.0).alias("t"), F.col("n").alias("p")))
    each = cells.select(F.inline(sides), F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0.0).alias("hit"))
    sums = each.groupBy("label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), (F.sum("hit") / 2).alias("hit"))
    part = lambda x: F.coalesce(F.try_divide("hit", x), F.lit(0.0))
    return sums.select("label", part(F.col("p")).alias("precision"), part(F.col("t")).alias("recall"), part((F.col("t") + F.col("p")) / 2).alias("f1"), F.col("t").alias("support"))


def report(df: DataFrame, label: str, predicted: str, weight: str | None = None) -> DataFrame:
    """by_class() with rows for the accuracy (in all three), the macro average and the one weighted by support."""
    cells = confusion(df, label, predicted, weight)
    each = by_class(cells)
    names = ("precision", "recall", "f1")
    macro = each.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    weighted = each.agg(F.lit("weighted avg").alias("label"), *[mean(c) for c in names], F.sum("support").alias("support"))
    hit = F.sum(F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0.0)) / F.sum("n")
    accuracy = cells.agg(F.lit("accuracy").alias("label"), *[hit.alias(c) for c in names], F.sum("n").alias("support"))
    return reduce(DataFrame.unionByName, [each, accuracy, macro, weighted])


def _label_metrics(cells: DataFrame) -> DataFrame:
    """One row: acc, micro_f1 (equal to it), macro_f1, acc_and_macro_f1 and mcc, Matthews' coefficient for any number of classes."""
    some = cells.agg(F.sum("n").alias("s"), F.sum(F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0.0)).alias("c"))
    sides = F.array(F.struct(F.col("true").alias("label"), F.col("n").alias("t"), F.lit(0.0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0.0).alias("t"), F.col("n").alias("p")))
    margins = cells.select(F.inline(sides)).groupBy("label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    margins = margins.agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") ** 2).alias("tt"), F.sum(F.col("p") ** 2).alias("pp"))
    one = by_class(cells).agg(F.avg("f1").alias("macro_f1")).crossJoin(some).crossJoin(margins)
    acc = F.col("c") / F.col("s")
    spread = F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))
    mcc = F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("tp"), spread), F.lit(0.0))
    return one.select(acc.alias("acc"), acc.alias("micro_f1"), "macro_f1", ((acc + F.col("macro_f1")) / 2).alias("acc_and_macro_f1"), mcc.alias("mcc"))


def _correlations(df: DataFrame, label: str, predicted: str) -> DataFrame:
    some = df.select(F.col(label).cast("double").alias("y"), F.col(predicted).cast("double").alias("x")).na.drop()
    both = stats.average_ranks(stats.average_ranks(some, "x", "rx"), "y", "ry")
    told = both.agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearmanr"))
    return told.withColumn("corr", (F.col("pearson") + F.col("spearmanr")) / 2)


def _as_rows(one: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))


def task_metrics(df: DataFrame, task: str, label: str, predicted: str) -> DataFrame:
    """(metric, value): those of a known task; classes as labels, or for sts-b scores."""
    if task not in TASKS:
        raise ValueError(f"{task} is no known task")
    names = TASKS[task]
    return _as_rows(_correlations(df, label, predicted) if "corr" in names else _label_metrics(confusion(df, label, predicted)), names)


def compute(
    df: DataFrame, names: list[str], label: str, predicted: str, classes: list[str], key: str, weight: str | None = None, probs: dict[str, str] | None = None,
) -> DataFrame:
    """(metric, value) for metrics by name: accuracy, weighted_accuracy, f1 and weighted_f1 (of the second of two classes, else micro), micro_f1, macro_f1,
    per_class_f1 (f1-<class>), cfm (cfm-<true>-<predicted>, unweighted), calibration-<brier|log>-<adaptive|even>-<bins> and refinement-<brier|log>.

    Probabilities, by class, are needed for the last two; brier is that of the second class.
    """
    plain, weighted = confusion(df, label, predicted), confusion(df, label, predicted, weight)
    named = lambda df, metric, value: df.select((F.lit(metric) if isinstance(metric, str) else metric).alias("metric"), value.alias("value"))
    each = by_class(weighted)
    second = each.where(F.col("label") == classes[1]) if len(classes) == 2 else None

    def told(name: str) -> DataFrame:
        kind, *rest = name.split("-")
        if name in ("accuracy", "weighted_accuracy"):
            return named(_label_metrics(plain if name == "accuracy" else weighted), name, F.col("acc"))
        if name in ("f1", "weighted_f1", "micro_f1"):
            if second is not None:
                return named(second.agg(F.coalesce(F.max("f1"), F.lit(0.0)).alias("f1")), name, F.col("f1"))
            return named(_label_metrics(weighted), name, F.col("micro_f1"))
        if name == "macro_f1":
            return named(_label_metrics(weighted), name, F.col("macro_f1"))
        if name == "per_class_f1":
            return named(each.where(F.col("label").isin(classes)), F.concat(F.lit("f1-"), "label"), F.col("f1"))
        if name == "cfm":
            return named(plain, F.concat_ws("-", F.lit("cfm"), "true", "predicted"), F.col("n"))
        if kind in ("calibration", "refinement") and probs is None:
            raise ValueError(f"{name} needs probabilities")
        if kind == "calibration" and len(rest) == 3 and rest[0] in ("brier", "log") and rest[1] in ("adaptive", "even"):
            if rest[0] == "log":
                return named(calibration.log_calibration(calibration.log_parts(df, label, probs, key, weight, int(rest[2]), rest[1] == "adaptive")), name, F.col("calibration"))
            second_is = df.withColumn("second_", (F.col(label) == classes[1]).cast("int"))
            return named(calibration.brier_parts(second_is, "second_", probs[classes[1]], key, weight, int(rest[2]), rest[1] == "adaptive"), name, F.col("root"))
        if kind == "refinement" and rest == ["log"]:
            return named(calibration.entropy_refinement(df, list(probs.values()), weight), name, F.col("refinement"))
        if kind == "refinement" and rest == ["brier"]:
            p, w = F.col(probs[classes[1]]), (F.col(weight) if weight else F.lit(1.0)).cast("double")
            return named(df.agg((F.sum(w * p * (1 - p)) / F.sum(w)).alias("r")), name, F.col("r"))
        raise ValueError(f"{name} is no known metric")

    return reduce(DataFrame.unionByName, [told(n) for n in names])
