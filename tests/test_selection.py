from pyspark.sql import functions as F

from tallyloom.operators import selection as S
from tallyloom.sources import corpora


def test_majority_and_rejection(spark):
    rows = [(1, 0, "b", 0.1, True), (1, 1, "a", 0.9, False), (1, 2, "a", 0.2, True), (1, 3, "b", 0.2, True),
            (2, 0, None, None, True), (3, 0, "x", 0.3, False)]
    table = spark.createDataFrame(rows, "q int, position int, answer string, score double, correct boolean")
    votes = {r["q"]: (r["answer"], r["votes"]) for r in S.majority_answers(table, ["q"]).collect()}
    assert votes == {1: ("b", 2), 3: ("x", 1)}
    best = {r["q"]: (r["position"], r["score"]) for r in S.best_correct(table, ["q"]).collect()}
    assert best == {1: (2, 0.2)}


def test_shared_grams(spark):
    long = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " + long.upper() + " y"), (2, long[:30]), (3, None), (4, "")], "doc_id int, text string")
    items = spark.createDataFrame([(7, long), (8, "short one"), (9, None)], "item_id int, text string")
    assert [tuple(r) for r in S.shared_grams(docs, items, 13).collect()] == [(7, 1, 8, 8)]


def test_wins(spark):
    scores = spark.createDataFrame([("m", t, 0.5 + t / 10) for t in range(4)], "model string, task int, score double")
    base = spark.createDataFrame([(t, 0.6) for t in range(4)], "task int, score double")
    assert [tuple(r) for r in S.task_wins(scores, base, 2).collect()] == [("m", 4, 2, True)]
    assert S.scored_at_least(scores.withColumn("score", F.lit(None).cast("double")), "score", 0).count() == 0


def test_capped(spark):
    table = spark.createDataFrame([(k, i) for i, k in enumerate([5, None, 3, 3, 3, 9, 1])], "k int, i int")
    for cap, want in ((None, 7), (0, 0), (1, 1), (3, 3), (4, 4), (7, 7), (50, 7)):
        got = corpora.capped(table, cap, "k").collect()
        assert len(got) == want
        keys = sorted((-1 if r["k"] is None else r["k"]) for r in got)
        assert keys == [-1, 1, 3, 3, 3, 5, 9][:want]
    assert corpora.capped(table.filter("k is null"), 3, "k").count() == 1
