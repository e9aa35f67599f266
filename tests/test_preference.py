import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyloom.functions import preference as P
from tallyloom.operators import preference as O

DIALOGUES = [
    "\n\nHuman: hi\n\nAssistant: hello",
    "\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nAssistant:  d \n",
    "\n\nHuman: touching\n\nAssistant:\n\nAssistant: x",
    "no marker at all ",
    "\n\nAssistant:",
]


def by_rule(text):
    marks = list(re.finditer(r"\n\nAssistant:\s*", text))
    if not marks:
        return text.strip(), ""
    return text[: marks[-1].start()].strip(), text[marks[-1].end() :].strip()


def test_split_at_the_last_marker(spark):
    df = spark.createDataFrame([(t,) for t in DIALOGUES], "t string")
    got = [tuple(r[0]) for r in df.select(P.split_dialogue(F.col("t"))).collect()]
    assert got == [by_rule(t) for t in DIALOGUES]


def test_empty_sides_drop(spark):
    df = spark.createDataFrame([(1, DIALOGUES[0], DIALOGUES[4]), (2, DIALOGUES[1], DIALOGUES[0])],
                               "i int, chosen string, rejected string")
    got = O.dialogue_pairs(df).collect()
    assert [(r["i"], r["chosen"], r["rejected"]) for r in got] == [(2, "d", "hello")]
    assert got[0]["chosen_text"] == got[0]["prompt"] + "\nd"


def test_message_sides(spark):
    kind = "array<struct<role:string,content:string>>"
    side = [Row(role="user", content=" u "), Row(role="assistant", content=" a ")]
    df = spark.createDataFrame([(1, " p ", side, side), (2, None, side, side)],
                               f"i int, prompt string, chosen {kind}, rejected {kind}")
    got = {r["i"]: r for r in O.message_pairs(df).collect()}
    assert got[1]["chosen_text"] == "p\na"
    assert got[2]["chosen_text"] == "User: u\nAssistant: a"


def test_negatives_are_wrong_and_spread(spark):
    rows = [(i, f"q{i}", f"work #### {7 if i % 3 else i}") for i in range(90)]
    df = spark.createDataFrame(rows, "problem_id long, question string, answer string")
    got = O.verifier_examples(df, seed=1, negatives=3).collect()
    gold = {i: str(7 if i % 3 else i) for i in range(90)}
    wrong = [r for r in got if r["label"] == 0]
    assert len(wrong) == 270 and sum(r["label"] for r in got) == 90
    assert all(r["answer"] != gold[r["problem_id"]] for r in wrong)
    assert any(r["answer"] in set(gold.values()) for r in wrong)
    again = O.verifier_examples(df.repartition(7), seed=1, negatives=3).collect()
    key = lambda r: (r["problem_id"], r["slot"])
    assert sorted(got, key=key) == sorted(again, key=key)


def test_one_shared_answer_falls_back_to_numbers(spark):
    df = spark.createDataFrame([(i, "q", "#### 5") for i in range(4)],
                               "problem_id long, question string, answer string")
    wrong = [r["answer"] for r in O.verifier_examples(df, 2).collect() if r["label"] == 0]
    assert len(wrong) == 4 and "5" not in wrong
