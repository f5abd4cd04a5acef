from collections import Counter

import corpus_pipeline

from lectern.llm import exact_dedup, jaccard_join


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen["quality_classifier"]
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").join(before, "doc_id", "left_semi")
    assert ids(good).keys() - ids(after).keys() == set() and 0 < after.count() < before.count()
    before, after = seen["exact_dedup"]
    assert ids(after) == Counter(r.doc_id for r in exact_dedup.exact_dedup(before).where("kept").collect())
    before, after = seen["ngram_jaccard_join"]
    assert ids(after) == Counter(r.doc_id for r in jaccard_join.jaccard_components(before).where("doc_id = component_id").collect())
    before, after = seen["mixing"]
    assert ids(after).keys() <= ids(before).keys() and max(ids(after).values()) <= 2
    before, after = seen["byte_bpe"]
    assert ids(after) == ids(before) and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(after.columns)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50


def test_stages_on_odd_rows_and_on_none(spark, odd_docs, no_docs, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            assert after.columns == docs.columns
        assert after.count() <= (2 if name == "mixing" else 1) * docs.count()
        docs = after
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, folder).count() == 0
