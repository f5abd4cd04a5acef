import json

from pyspark.sql import functions as F

from lectern.llm import chat_format as C


def test_unknown_and_empty_records_are_rows_without_text(spark):
    said = {"messages": [{"role": "user", "content": "hi"}]}
    records = [(1, json.dumps(said)), (2, json.dumps({"foo": 1})), (3, None), (4, json.dumps({"messages": []})), (5, "no json")]
    done = C.format_chat(C.turns_of_records(spark.createDataFrame(records, "conv_id long, record string"), "conv_id", "record"))
    got = {r.conv_id: (r.formatted, r.segments) for r in done.collect()}
    assert set(got) == {1, 2, 3, 4, 5} and "hi" in got[1][0] and all(got[i] == (None, None) for i in (2, 3, 4, 5))
    assert done.select(C.read_back(F.col("formatted")).alias("t")).where("t is null").count() == 4


def test_layouts_among_further_known_fields(spark):
    chat = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    parts = [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "image_url", "image_url": {"url": "x"}}]}, {"role": "assistant", "content": "a"}]
    said = [("user", "q"), ("assistant", "a")]
    system = [("system", "s"), *said]
    cases = [
        ({"prompt": "q", "messages": chat}, said), ({"system": "s", "messages": chat}, system), ({"prompt": "q", "prompt_id": "7", "messages": chat, "text": "z"}, said),
        ({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, system), ({"messages": parts}, said),
        ({"instruction": "q", "context": "", "response": "a", "category": "x"}, said), ({"conversation": chat}, said), ({"system": "s", "instruction": "q", "input": "", "output": "a"}, system),
        ({"messages": [{"role": None, "content": "q"}, {"role": "assistant", "content": "a"}]}, [("", "q"), ("assistant", "a")]),
        ({"messages": [{"role": "user", "content": None}, {"role": "assistant", "content": "a"}]}, [("user", ""), ("assistant", "a")]),
        ({"messages": [{"role": "user", "content": ["q", {"text": "r"}]}, {"role": "assistant", "content": 7}]}, [("user", "q\nr"), ("assistant", "7")]),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)], "id long, j string")
    got: dict[int, list] = {}
    for r in C.turns_of_records(df, "id", "j").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_the_turn_table_is_a_mapping_by_its_fingerprint(spark):
    m = next(m for m in C.MAPPINGS if m.columns)
    df = spark.createDataFrame([(1, 0, "user", "x", 5)], "conv_id long, turn long, role string, text string, more int")
    assert C.table_fingerprint(df.schema, m) == C.table_fingerprint(df.drop("more").schema, m) != C.table_fingerprint(df.drop("role").schema, m)
    other = C.Mapping("own", columns=("c", "t", "who", "said"))
    own = spark.createDataFrame([(1, 0, "user", "x")], "c long, t int, who string, said string")
    assert [tuple(r) for r in C.turns_of_table(own, (*C.MAPPINGS, other)).collect()] == [(1, 0, "user", "x", "own")]
