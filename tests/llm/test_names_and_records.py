import json

from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import chat_format, fingerprints, jaccard_join


def test_one_per_group_of_tables_with_the_operators_own_names(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text, 7), (2, text, 8), (3, None, 9)], "doc_id long, text string, gone int")
    df = df.withColumns({c: F.lit(0) for c in ("component", "bucket", "component_id", "n_shingles", "Gone_")})
    got = jaccard_join.keep_one_per_group(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.gone) for r in got.collect()) == [(1, 7), (3, 9)]


def test_stages_take_clashing_names(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    docs = docs.withColumns({c: F.lit(1) for c in ("gone", "bucket", "component", "copies", "taken", "key", "digest", "keep_id", "predicted")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 10


def test_counts_replace_a_column_of_their_name(spark):
    df = spark.createDataFrame([("00000000000000ff", 5), ("00000000000000fe", 6), (None, 7)], "fingerprint string, Near_Fingerprints int")
    got = fingerprints.with_near_counts(df)
    assert got.columns == ["fingerprint", "near_fingerprints"] and sorted(r.near_fingerprints for r in got.collect()) == [0, 1, 1]


def test_records_of_unknown_layout_are_counted(spark):
    record = {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]}
    rows = [(1, json.dumps(record)), (1, json.dumps({"foo": 1})), (2, json.dumps({"foo": 1})), (3, json.dumps(record)), (2, None)]
    turns = chat_format.turns_of_records(spark.createDataFrame(rows, "conv_id long, record string"), "conv_id", "record")
    got = {r.conv_id: r for r in chat_format.format_chat(turns).collect()}
    assert [got[i].unknown_records for i in (1, 2, 3)] == [1, 2, 0] and got[1].formatted == got[3].formatted and got[2].formatted is None


def test_further_layouts(spark):
    rows = [(1, {"messages": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}]}), (2, {"prompt": "hi", "chosen": "yes", "rejected": "no"})]
    turns = chat_format.turns_of_records(spark.createDataFrame([(i, json.dumps(r)) for i, r in rows], "conv_id long, record string"), "conv_id", "record")
    said = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    assert said == {i: [("user", "hi"), ("assistant", "yes")] for i in (1, 2)}


def test_roles_of_any_signs_read_back(spark):
    roles = ["a\0b", "a\\n", "a\nb", "\\\n", "\\\\n\0\n", "<|im_end|>\n", ""]
    df = spark.createDataFrame([(i, 0, r, "x", "turn_rows") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string, layout string")
    out = chat_format.format_chat(df).select("conv_id", chat_format.read_back(F.col("formatted")).alias("t")).collect()
    assert {r.conv_id: r.t[0].role for r in out} == dict(enumerate(roles))
