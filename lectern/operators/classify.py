"""Linear classifiers over given classes: degenerate training sets, penalties by development folds, averaged folds, storage; TF-IDF and what terms add."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import counted
from lectern.operators import labels as annotations
from lectern.operators.joins import SMALL
from lectern.storage import checkpoint

@dataclass
class Linear:
    """A model of the classes; those that its training rows lack have probability 0. With one class only there is no model, just that class."""

    classes: list[str]
    known: list[str]
    model: object | None = None

    def probabilities(self, df: DataFrame, out: str) -> DataFrame:
        """df, with a vector `features`, and out: the probability of each class, in order, as an array."""
        if self.model is None:
            return df.withColumn(out, F.array(*[F.lit(float(c in self.known)) for c in self.classes]))
        from pyspark.ml.functions import vector_to_array

        held = df.drop("p_", "raw_", "label_")
        told = self.model.setProbabilityCol("p_").setRawPredictionCol("raw_").setPredictionCol("label_").transform(held)
        p = vector_to_array("p_")
        return told.withColumn(out, F.array(*[p[self.known.index(c)] if c in self.known else F.lit(0.0) for c in self.classes])).drop("p_", "raw_", "label_")


def fit(rows: DataFrame, label: str, classes: list[str], weight: str | None = None, reg: float = 0.01, l1: float = 1.0, rounds: int = 50) -> Linear:
    """A logistic regression, multinomial for over two classes, on rows with a vector `features`; rows of other classes are left out."""
    from pyspark.ml.classification import LogisticRegression

    some = rows.where(F.col(label).isin(classes))
    present = {r[0] for r in some.select(F.col(label)).distinct().collect()}  # a row a class
    known = [c for c in classes if c in present]
    if len(known) < 2:
        return Linear(classes, known or classes[:1])
    number = F.array_position(F.array(*map(F.lit, known)), F.col(label)).cast("double") - 1
    lr = LogisticRegression(labelCol="label_", regParam=reg, elasticNetParam=l1, maxIter=rounds, family="multinomial" if len(known) > 2 else "binomial")
    if weight:
        lr = lr.setWeightCol(weight)
    return Linear(classes, known, lr.fit(some.withColumn("label_", number)))


def chosen(p: str, classes: list[str]) -> Column:
    """The class with the largest probability, the first on ties."""
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(F.col(p), F.array_max(p)).cast("int"))


@dataclass
class Folds:
    """One model a fold, each with its penalty chosen on the fold that it wasn't trained on; scores: (fold, penalty, score) of all that were tried."""

    models: list[Linear]
    penalties: list[float]
    scores: list[tuple[int, float, float]] = field(default_factory=list)

    def probabilities(self, df: DataFrame, out: str) -> DataFrame:
        """df with out, the mean of the models' probabilities, in one scan."""
        names = [f"fold{i}_" for i in range(len(self.models))]
        for name, m in zip(names, self.models, strict=True):
            df = m.probabilities(df, name)
        k = range(len(self.models[0].classes))
        mean = F.array(*[sum((F.col(n)[j] for n in names[1:]), F.col(names[0])[j]) / len(names) for j in k])
        return df.withColumn(out, mean).drop(*names)


def score(df: DataFrame, label: str, p: str, classes: list[str], weight: str | None, metric: str) -> float:
    """Weighted accuracy, or F1: of the second of two classes, else the micro average."""
    w = F.col(weight) if weight else F.lit(1.0)
    judged = df.select(F.col(label).alias("y"), chosen(p, classes).alias("y_hat"), w.cast("double").alias("w"))
    if metric == "accuracy":
        return judged.agg(F.sum(F.when(F.col("y") == F.col("y_hat"), F.col("w")).otherwise(0.0)) / F.sum("w")).first()[0] or 0.0
    row = annotations.f1_scores(judged, "y", "y_hat", "w", classes[1] if len(classes) == 2 else classes[0]).first()
    return (row["binary"] if len(classes) == 2 else row["micro"]) or 0.0


def fold_grid(
    rows: DataFrame, key: str, label: str, classes: list[str], grid: list[float], folds: int = 5, weight: str | None = None, metric: str = "f1",
    l1: float = 1.0, seed: int = 42, threads: int = 4, rounds: int = 50,
) -> Folds:
    """A model for each of `folds` equal parts of the rows, trained on the other parts with the penalty that does best on that part, the largest on ties.

    Rows have a key, a label and a vector `features`; parts go by the order of a hash of the key. Features and parts are stored once, and all
    (fold, penalty) pairs are fitted from there, `threads` jobs at a time.
    """
    needed = rows.select(*dict.fromkeys([key, label, *([weight] if weight else []), "features"]))
    some = annotations.ranked(needed.where(F.col(label).isin(classes)), key, seed)
    n = some.count()
    stored = checkpoint(some.withColumn("fold_", annotations.split_n_way(F.col("rn"), F.lit(n), folds)).drop("rn"))

    def tried(pair: tuple[int, float]) -> tuple[int, float, float, Linear]:
        fold, reg = pair
        model = fit(stored.where(F.col("fold_") != fold), label, classes, weight, reg, l1, rounds)
        return fold, reg, score(model.probabilities(stored.where(F.col("fold_") == fold), "p_mean"), label, "p_mean", classes, weight, metric), model

    with ThreadPoolExecutor(threads) as pool:
        done = list(pool.map(tried, [(f, r) for f in range(folds) for r in grid]))
    best = [max((d for d in done if d[0] == f), key=lambda d: (d[2], d[1])) for f in range(folds)]
    return Folds([d[3] for d in best], [d[1] for d in best], [d[:3] for d in done])


def save(folds: Folds, path: str, spark: SparkSession) -> None:
    """The models below a folder that Spark writes, with what belongs to them in one line of JSON."""
    about = {"penalties": folds.penalties, "scores": folds.scores, "models": [{"classes": m.classes, "known": m.known, "fitted": m.model is not None} for m in folds.models]}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
    for i, m in enumerate(folds.models):
        if m.model is not None:
            m.model.save(f"{path}/model-{i}")


def load(path: str, spark: SparkSession) -> Folds:
    from pyspark.ml.classification import LogisticRegressionModel

    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    models = [Linear(m["classes"], m["known"], LogisticRegressionModel.load(f"{path}/model-{i}") if m["fitted"] else None) for i, m in enumerate(about["models"])]
    return Folds(models, about["penalties"], [tuple(s) for s in about["scores"]])


def idf_table(df: DataFrame, key: str, tokens: str, least: int = 1) -> DataFrame:
    """(term, idf) of the terms in at least `least` rows: ln((1 + n) / (1 + rows with the term)) + 1."""
    n = df.count()
    found = df.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return found.where(F.col("df") >= least).select("term", (F.ln((1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(df: DataFrame, key: str, tokens: str, idf: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns of `keep`, term, x): counts times idf by key, to unit length; rows without known terms have none.

    Terms are counted in their row, and added up by key only if several rows share a key. Counts go to their terms' idf once and back to their key once;
    a small idf is broadcast. idf is read twice: store it.
    """
    counts = df.select(F.col(key).alias("key"), *keep, F.inline(counted(F.col(tokens))))
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        counts = counts.groupBy("key", *keep, "term").agg(F.sum("n").alias("n"))
    idf = F.broadcast(idf) if idf.limit(SMALL + 1).count() <= SMALL else idf.hint("shuffle_hash")
    raw = counts.join(idf, "term").withColumn("x", F.col("n") * F.col("idf"))
    return raw.select("key", *keep, "term", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("key")))).alias("x"))


def tfidf_features(train: DataFrame, tokens: str, least: int = 1, most: int = 1 << 17):
    """A fitted pipeline to the same values as vectors, for training; `most` bounds the vocabulary, the most frequent first."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    counts = CountVectorizer(inputCol=tokens, outputCol="counts_", minDF=float(least), vocabSize=most).fit(train)
    idf = IDF(inputCol="counts_", outputCol="idf_").fit(counts.transform(train))
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1), inputCol="counts_", outputCol="scaled_")
    return PipelineModel([counts, scaled, Normalizer(p=2.0, inputCol="scaled_", outputCol="features")])


def coefficients(model: Linear, vocabulary: list[str], spark: SparkSession) -> DataFrame:
    """(label, term, weight) of the weights that aren't zero; with two classes the first has the opposite weights."""
    matrix = model.model.coefficientMatrix.toArray()
    if len(matrix) == 1:
        matrix = [-matrix[0], matrix[0]]
    told = [(c, t, float(w)) for c, row in zip(model.known, matrix, strict=True) for t, w in zip(vocabulary, row, strict=True) if w]
    return spark.createDataFrame(told, "label string, term string, weight double")


def shap_top_terms(train: DataFrame, n_train: int, test: DataFrame, n_test: int, weights: DataFrame, k: int) -> DataFrame:
    """(label, term, weight, shap, shap_abs, rank): by label the k terms with the largest mean contribution among those whose weight is largest for it.

    A linear model's contribution of a term to a row is weight * (x - the training rows' mean of x). shap is its mean over the n_test rows of test
    (key, term, x), shap_abs the mean of its size. All sums are over terms that occur, the rest in closed form; a label keeps k rows in each task.
    Labels for which a term has no weight have weight 0; of equal weights the first label has the term.
    """
    means = train.groupBy("term").agg((F.sum("x") / n_train).alias("mean"))
    off = test.join(means, "term").groupBy("term").agg(F.sum("x").alias("x"), F.sum(F.abs(F.col("x") - F.col("mean"))).alias("off"), F.count(F.lit(1)).alias("n"))
    both = means.join(off, "term", "left").na.fill(0, ["x", "off", "n"])
    both = both.select("term", (F.col("x") / n_test - F.col("mean")).alias("shift"), ((F.col("off") + (n_test - F.col("n")) * F.col("mean")) / n_test).alias("size"))
    told = owned(weights).join(both, "term").select("label", "term", "weight", F.round(F.col("weight") * F.col("shift"), 12).alias("shap"), (F.col("weight") * F.col("size")).alias("shap_abs"))
    return best_terms(told, k)


def owned(weights: DataFrame) -> DataFrame:
    """(label, term, weight): each term with a weight over 0 at the label whose weight is largest, the first of equal ones."""
    first = Window.partitionBy("term").orderBy(F.desc("weight"), "label")
    return weights.withColumn("r_", F.row_number().over(first)).where("r_ = 1 and weight > 0").drop("r_")


def best_terms(told: DataFrame, k: int) -> DataFrame:
    """The k rows of a label with the largest shap, with their rank."""
    best = Window.partitionBy("label").orderBy(F.desc("shap"), "term")
    return told.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mean_terms(x: DataFrame, held: Column, sizes: DataFrame, n_train: int, n_test: int, k: int) -> DataFrame:
    """(label, term, weight, shap, rank) as of shap_top_terms, of the model whose weights are a label's mean x less that of all.

    x has (key, label, term, x), sizes (label, n) of the training rows. The sums by term, label and part are taken in one pass and stored; all else comes of them.
    """
    sums = checkpoint(x.groupBy("term", "label", held.alias("held")).agg(F.sum("x").alias("x")))
    part = lambda c: F.sum(F.when(c, F.col("x")).otherwise(0.0))
    both = sums.groupBy("term").agg((part(~F.col("held")) / n_train).alias("mean"), (part(F.col("held")) / n_test).alias("seen"))
    # A class without the term has weight -mean, never the largest of a term's.
    weights = sums.where("not held").join(F.broadcast(sizes), "label").join(both, "term").select("label", "term", F.round(F.col("x") / F.col("n") - F.col("mean"), 12).alias("weight"))
    told = owned(weights).join(both, "term").select("label", "term", "weight", F.round(F.col("weight") * (F.col("seen") - F.col("mean")), 12).alias("shap"))
    return best_terms(told, k)
