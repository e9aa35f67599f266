import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyloom.functions import chat as C
from tallyloom.functions import tokens as K
from tallyloom.operators import chat as O


def wide(spark, name, **columns):
    kinds = {k: C.WIDE_SCHEMA[k] for k in columns}
    schema = "name string, " + ", ".join(f"`{k}` {v}" for k, v in kinds.items())
    return spark.createDataFrame([(name, *columns.values())], schema)


def adapt(spark, name, **columns):
    found = O.adapted_examples(wide(spark, name, **columns), "name").collect()
    return tuple(found[0][c] for c in ("instruction", "input", "output")) if found else None


def turns(*pairs):
    return [Row(role=r, content=c) for r, c in pairs]


def test_last_answer_with_history(spark):
    msgs = turns(("system", "S"), ("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2"))
    assert adapt(spark, "allenai/TULU-3-sft-mixture", messages=msgs) == (
        "[System] S\n\nq1\n\na1\n\nq2", "", "a2",
    )


@pytest.mark.parametrize(
    "msgs",
    [[], turns(("user", "only")), turns(("assistant", "first")), turns(("user", ""), ("assistant", "a")),
     turns(("user", "q"), ("assistant", ""))],
)
def test_unusable_messages(spark, msgs):
    assert adapt(spark, "smoltalk", messages=msgs) is None


def test_share_format_maps_unknown_roles_to_user(spark):
    convs = [Row(**{"from": f, "value": v}) for f, v in (("tool", "t"), ("human", "q"), ("gpt", "a"))]
    assert adapt(spark, "x/OpenHermes-2.5", conversations=convs) == ("t\n\nq", "", "a")


def test_flat_schemas(spark):
    assert adapt(spark, "MetaMathQA", query="q", response="r") == ("q", "", "r")
    assert adapt(spark, "OpenMathInstruct-2", problem="p", generated_solution="", expected_answer="4") == ("p", "", "4")
    assert adapt(spark, "ifeval-like-data", prompt="", query="q", answer="a") == ("q", "", "a")
    assert adapt(spark, "alpaca", instruction="i", input=None, output="o") == ("i", "", "o")
    assert adapt(spark, "alpaca", instruction="i", input="x", output="") is None
    assert adapt(spark, "unknown", question="q", answer="a") == ("q", "", "a")


def test_passage(spark):
    row = dict(story="S", questions=["q1", "q2"], answers=Row(input_text=["a1", "a2"]))
    assert adapt(spark, "stanfordnlp/coqa", **row) == ("q1", "S", "a1")
    assert adapt(spark, "coqa", **{**row, "questions": []}) is None
    chat = O.normalised_chats(wide(spark, "coqa", **row)).first()["messages"]
    assert [(m["role"], m["content"]) for m in chat] == [
        ("system", "S"), ("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2")
    ]


def test_tokenizer_normaliser_drops_unknown_roles(spark):
    convs = [Row(**{"from": f, "value": v}) for f, v in (("Tool", "t"), ("HUMAN", "q"), ("chatgpt", "a"))]
    chat = O.normalised_chats(wide(spark, "x", conversations=convs)).first()["messages"]
    assert [(m["role"], m["content"]) for m in chat] == [("user", "q"), ("assistant", "a")]


def test_loss_is_on_the_response_only(spark):
    text = "### Instruction:\nhi\n\n### Response:\nyes"
    row = O.response_rows(spark.createDataFrame([(1, text)], "i int, text string"), 64).first()
    ids = [2 + ord(c) % 30 for c in text]
    at = text.index("yes")
    assert row["input_ids"] == ids + [0] * (64 - len(ids))
    assert row["attention_mask"] == [1] * len(ids) + [0] * (64 - len(ids))
    assert row["labels"] == [-100] * at + ids[at:] + [-100] * (64 - len(ids))
    short = O.response_rows(spark.createDataFrame([(1, text)], "i int, text string"), 8).first()
    assert short["labels"] == [-100] * 8


def test_chat_mask(spark):
    chats = spark.createDataFrame(
        [(1, turns(("user", "q"), ("assistant", "ans")))], f"i int, messages {C.MESSAGES}"
    )
    row = O.chat_tokens(chats, 500).first()
    text = "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nans<|im_end|>\n"
    start = text.index("ans")
    assert row["ids"] == [2 + ord(c) % 30 for c in text] + [1]
    assert [i for i, m in enumerate(row["mask"]) if m] == [start, start + 1, start + 2]
    assert O.chat_tokens(chats, len(text) - 1).count() == 0
    assert O.chat_tokens(chats, len(text)).count() == 1


def test_formats(spark):
    df = spark.createDataFrame([(" i ", " x ", " o "), ("i", " \n", "o")], "a string, b string, c string")
    got = [r[0] for r in df.select(C.instruction_text(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [
        "### Instruction:\ni\n\n### Input:\nx\n\n### Response:\no",
        "### Instruction:\ni\n\n### Response:\no",
    ]


def test_padding(spark):
    row = spark.range(1).select(K.fixed_length_row(K.char_ids(F.lit("abc")), 5).alias("r")).first()["r"]
    assert row["input_ids"] == [9, 10, 11, 0, 0] and row["labels"] == [9, 10, 11, -100, -100]
    empty = spark.range(1).select(K.fixed_length_row(K.char_ids(F.lit("")), 2).alias("r")).first()["r"]
    assert empty["labels"] == [-100, -100]


def test_adapter_choice():
    assert C.adapter_for("x/NO_ROBOTS:train") is C.adapt_messages
    assert C.adapter_for("nothing") is C.adapt_any
