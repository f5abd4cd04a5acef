import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import chat_format as C
from lectern.llm import queries


def records(spark, *items):
    return spark.createDataFrame([(i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(items)], "id long, j string")


def turns(spark, *items):
    out = {}
    for r in C.turns_of_records(records(spark, *items), "id", "j").orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, [r.layout]).append((r.role, r.text))
    return list(out.values())


def test_layouts(spark):
    said = [("user", "q"), ("assistant", "a")]
    got = turns(
        spark,
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": {"x": [1]}},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"},
        {"output": "a", "input": "more", "instruction": "q"},
        {"prompt": "q", "completion": "a", "system": "s"},
        {"prompt": "q", "response": "a"},
        {"prompt": [{"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "a"}]},
        {"question": "q", "answer": "a", "context": None},
        {"data": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}},
        {"dialogue": [{"speaker": "user", "text": "q"}, {"speaker": "bot", "text": "a"}]},
    )
    assert [g[0] for g in got] == ["messages", "conversations", "instruction", "instruction", "prompt_completion", "prompt_response", "prompt_messages", "question_answer", "nested", "dialogue"]
    assert got[3][1:] == [("user", "q\n\nmore"), ("assistant", "a")] and got[4][1:] == [("system", "s"), *said]
    assert all(g[1:] == said for i, g in enumerate(got) if i not in (3, 4))


def test_unknown_layouts_are_counted(spark):
    assert turns(spark, {"foo": 1}, "no json", None, {"messages": []}) == [["unknown", (None, None)]] * 4


def test_table_layouts(spark):
    rows = spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string")
    assert [(r.role, r.text, r.layout) for r in C.turns_of_table(rows).orderBy("turn").collect()] == [("user", "q", "prompt_response"), ("assistant", "a", "prompt_response")]
    flat = spark.createDataFrame([(1, 0, "user", "x", "y")], "conv_id long, turn int, role string, text string, layout string")
    assert C.turns_of_table(flat).collect()[0].layout == "turn_rows"


pieces = st.sampled_from(["<|im_start|>", "<|im_end|>", "\n", "</s>", "[INST]", "[/INST]", "<", "\\", "[", "s>", "|im_end|>", "<\\", "a", "é", "<<SYS>>", "\\n", "user"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.lists(pieces, max_size=3).map("".join), st.lists(pieces, max_size=6).map("".join)), min_size=1, max_size=40))
def test_round_trip(spark, said):
    df = spark.createDataFrame([(1, i, r, t, "x") for i, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string, layout string")
    row = C.format_chat(df).select("formatted", C.read_back(F.col("formatted")).alias("t")).first()
    assert [(x.role, x.text) for x in row.t] == said
    assert row.formatted.count("<|im_start|>") == row.formatted.count("<|im_end|>") == len(said)


def test_odd_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, None), (1, 1, "assistant", "b"), (1, None, "assistant", "last"), (None, 0, "user", "x"), (2, 0, "assistant", "z" * 200_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, layout string")
    out = {r.conv_id: r for r in C.format_chat(df).select("conv_id", C.read_back(F.col("formatted")).alias("t"), C.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in out[1].t] == [("", ""), ("assistant", "b"), ("assistant", "b"), ("assistant", "last")]
    assert out[1].loss == "bblast" and out[None].loss == "" and len(out[2].loss) == 200_000
    assert C.format_chat(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    out = {r.conv_id: r for r in queries.op2_chat_formatting(spark, sf_dir).collect()}
    want = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(out) == set(want)
    for i, said in want.items():
        loss = "".join(t for r, t in said if r == "assistant")
        spoken = "".join(f"{r}\n{t}\n" for r, t in said)
        assert (out[i].n_turns, out[i].loss_chars) == (len(said), len(loss))
        assert out[i].turns_sha256 == hashlib.sha256(spoken.encode()).hexdigest() and out[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
