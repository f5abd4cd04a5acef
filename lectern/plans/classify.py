"""Queries of classifiers and of the terms that tell classes apart. Documents are the texts, their language the class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import words
from lectern.operators import classify, models
from lectern.plans.registry import Tables, i64, query, r6
from lectern.storage import checkpoint

_TEST = "doc_id % 5 = 0"


def tokened(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("lang").alias("label"), words(F.lower("text")).alias("w"))


@query("tfidf_top_terms", """
with d as (select doc_id, lang as label, doc_id % 5 = 0 as held, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') as w from documents),
n as (select count(*) filter (where not held) as train, count(*) filter (where held) as test from d), f as (select term, count(*) as df from (select unnest(list_distinct(w)) as term from d where not held) group by 1 having count(*) >= 5),
i as (select term, ln((1.0 + train) / (1 + df)) + 1 as idf from f cross join n), c as (select doc_id, label, held, term, count(*) as tf from (select doc_id, label, held, unnest(w) as term from d) group by all),
x as (select doc_id, label, held, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by doc_id)) as x from c join i using (term)),
m as (select term, sum(x) filter (where not held) / max(train) as mean, coalesce(sum(x) filter (where held), 0) / max(test) as seen from x cross join n group by 1), z as (select label, count(*) as n from d where not held group by 1),
w as (select z.label, m.term, coalesce(sum(x.x), 0) / max(z.n) - max(m.mean) as weight from z cross join m left join x on x.label = z.label and x.term = m.term and not x.held group by 1, 2),
o as (select * from w qualify row_number() over (partition by term order by round(weight, 12) desc, label) = 1), s as (select label, term, weight, round(weight * (seen - mean), 12) as shap from o join m using (term) where weight > 0)
select label, cast(rank as bigint) as rank, term, round(shap, 9) as shap from (select *, row_number() over (partition by label order by shap desc, term) as rank from s) where rank <= 10
""")  # fmt: skip
def tfidf_top_terms(t: Tables) -> DataFrame:
    """Of a linear model whose weights are a language's mean TF-IDF less that of all, the terms that add most on held-out texts."""
    d = tokened(t)
    train, test = d.where(f"not ({_TEST})"), d.where(_TEST)
    idf = checkpoint(classify.idf_table(train, "doc_id", "w", 5))
    x = classify.tfidf(d, "doc_id", "w", idf, ("label",))
    sizes = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    top = classify.mean_terms(x, F.col("key") % 5 == 0, sizes, train.count(), test.count(), 10)
    return top.select("label", i64(F.col("rank")).alias("rank"), "term", F.round("shap", 9).alias("shap"))


@query("shap_top_terms")
def shap_top_terms(t: Tables) -> DataFrame:
    """The same of a multinomial L1 model, fitted on the texts that aren't held out."""
    d = tokened(t)
    train, test = d.where(f"not ({_TEST})"), d.where(_TEST)
    features = classify.tfidf_features(train, "w", 5)
    classes = sorted(r[0] for r in t.documents.select("lang").distinct().collect() if r[0] is not None)
    model = classify.fit(checkpoint(features.transform(train).select("label", "features")), "label", classes, reg=0.002)
    weights = classify.coefficients(model, features.stages[0].vocabulary, t.spark)
    idf = checkpoint(classify.idf_table(train, "doc_id", "w", 5))
    # Norms are over all terms; of the values only those of terms with a weight are kept.
    known = F.broadcast(weights.where("weight > 0").select("term").distinct())
    x, held = checkpoint(classify.tfidf(d, "doc_id", "w", idf).join(known, "term", "left_semi")), F.col("key") % 5 == 0
    top = classify.shap_top_terms(x.where(~held), train.count(), x.where(held), test.count(), weights, 10)
    return top.select("label", i64(F.col("rank")).alias("rank"), "term", r6(F.col("shap")).alias("shap"), r6(F.col("shap_abs")).alias("shap_abs"))


@query("fold_classifier")
def fold_classifier(t: Tables) -> DataFrame:
    """Quality by n-grams: penalties chosen by three development folds, the folds' probabilities averaged over the texts that are held out."""
    d = t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", F.col("quality").cast("string").alias("label"), words(F.lower("text")).alias("w"))
    train, test = d.where(f"not ({_TEST})"), d.where(_TEST)
    features = models.ngram_features(train, "w", 5, 1 << 14)
    folds = classify.fold_grid(features.transform(train), "doc_id", "label", ["0", "1"], [0.1, 0.02, 0.004], 3)
    return folds.probabilities(features.transform(test), "p").select("doc_id", "label", r6(F.col("p")[1]).alias("p"), classify.chosen("p", ["0", "1"]).alias("predicted"))
