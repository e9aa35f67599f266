import json
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import checks, prompts
from tallyloom.functions import text as T
from tallyloom.operators import instructions as I
from tallyloom.operators import losses as L
from tallyloom.operators import scoring as S


def test_correlations_of_constants_are_zero(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(5)], "k long, c double, x double")
    assert S.pearson(df, "c", "x").first()[0] == 0.0
    assert S.pearson(df.filter("k < 0"), "c", "x").first()[0] == 0.0
    assert abs(S.pearson(df, "x", "x").first()[0] - 1) < 1e-12


def test_spearman_breaks_ties_by_position(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 3), rng.randint(0, 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, x int, y int").repartition(4)

    def ranks(col):
        out = [0] * 40
        for place, r in enumerate(sorted(rows, key=lambda r: r[col])):
            out[r[0]] = place
        return out

    a, b = ranks(1), ranks(2)
    d = sum((p - q) ** 2 for p, q in zip(a, b))
    assert abs(S.spearman(df, "x", "y", "k").first()[0] - (1 - 6 * d / (40 * (1600 - 1)))) < 1e-9


def test_binary_scores_without_hits(spark):
    df = spark.createDataFrame([(0, 1), (0, 0)], "p int, g int")
    row = S.binary_scores(df, "p", "g").first()
    assert (row["f1"], row["matthews"]) == (0.0, 0.0)
    assert S.accuracy(df.filter("p > 5"), "p", "g").first()["accuracy"] == 0.0


def test_equal_scores_go_to_the_first_choice(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.9)], "item int, c int, s double")
    assert S.best_choice(df, ["item"], "c", F.col("s")).first()["picked"] == 1


def normal(s):
    s = re.sub(r"\b(a|an|the)\b", " ", s.lower())
    s = "".join(c for c in s if c not in set(string.punctuation))
    return re.sub(r"\s+", " ", s).strip()


def f1(pred, gold, by_tokens):
    p, g = normal(pred).split(), normal(gold).split()
    if by_tokens and (not p or not g):
        return float(p == g)
    if not by_tokens and (not pred or not gold):
        return float(pred == gold)
    same = sum((Counter(p) & Counter(g)).values())
    return 2 * same / (len(p) + len(g)) if same else 0.0


PAIRS = [("the cat sat", "a cat"), ("", ""), ("the", "an"), ("x x x y", "x x z"), ("", "x"), ("!", "x"),
         ("an", ""), ("L'été the été", "été"), ("Don't a-b", "dont ab")]


@pytest.mark.parametrize("by_tokens", [True, False])
def test_token_overlap(spark, by_tokens):
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(PAIRS)], "i int, predicted string, gold string")
    got = {r["i"]: r for r in S.token_overlap(df, ["i"], by_tokens).collect()}
    assert len(got) == len(PAIRS)
    for i, (p, g) in enumerate(PAIRS):
        assert abs(got[i]["f1"] - f1(p, g, by_tokens)) < 1e-12, (p, g)
        assert got[i]["em"] == int(normal(p) == normal(g))


def test_no_gold_counts_as_an_empty_one(spark):
    df = spark.createDataFrame([(1, "", []), (2, "x", None), (3, "b c", ["a", "c b"])],
                               "i int, predicted string, golds array<string>")
    got = {r["i"]: r["f1"] for r in S.best_over_golds(df, ["i"], False).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0}


def test_number_answers_keep_the_known_traps(spark):
    cases = ["answer is 42.", "x #### -1,234 y", "12 and 7", "none", "=  5 ", "####5-3"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    rows = df.select(T.number_answer_loose(F.col("t")), T.number_answer_strict(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["42.", "-1234", "7", None, "5", "5-3"]
    assert [r[1] for r in rows] == ["42", "-1234", "7", "", "5", "5"]


def test_error_kinds(spark):
    rows = [("42 maybe 41", "42"), ("it is 45", "42"), ("it is 90", "42"), ("answer is -", "42"), ("42", "42")]
    df = spark.createDataFrame(rows, "output string, gold string")
    assert [r["error"] for r in S.judged_numbers(df).collect()] == [
        "extraction", "arithmetic", "reasoning", "reasoning", None,
    ]


def test_unmatched_predictions_raise(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, p string")
    b = spark.createDataFrame([(1, "x")], "i int, g string")
    with pytest.raises(Exception, match="do not match"):
        S.checked_pairs(a, b, "i").collect()


CHECK_CASES = [
    ("length_constraints:number_words", {"relation": "at least", "num_words": 3}, "it's a b", True),
    ("length_constraints:number_words", {"relation": "about", "num_words": 3}, "a b c", False),
    ("length_constraints:number_words", {"relation": "at least"}, "a b c", False),
    ("length_constraints:number_sentences", {"relation": "less than", "num_sentences": 3}, "A. B! C", False),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "a\n \nb\n\n", True),
    ("detectable_content:number_placeholders", {"num_placeholders": 2}, "[a] [b]", True),
    ("detectable_content:postscript", {}, "x P.S. y", True),
    ("detectable_format:number_bullet_lists", {"num_bullets": 3}, "* a\r\n- b\n• c\n*d", True),
    ("detectable_format:constrained_response", {}, "\tMy answer is no. ", True),
    ("detectable_format:number_highlighted_sections", {"num_highlights": 1}, "*a*", True),
    ("detectable_format:multiple_sections", {"section_spliter": "", "num_sections": 2}, "SECTION 1 SECTION2", True),
    ("detectable_format:multiple_sections", {"section_spliter": "P.(", "num_sections": 1}, "P.( 4", True),
    ("detectable_format:title", {}, "<<t>>", True),
    ("detectable_format:json_format", {}, "```{\"a\": 1}```", True),
    ("detectable_format:json_format", {}, "{\"a\": 1} x", False),
    ("detectable_format:json_format", {}, "1],[2", False),
    ("detectable_format:json_format", {}, "", False),
    ("keywords:existence", {"keywords": ["AB", "c"]}, "abc", True),
    ("keywords:existence", {}, "abc", True),
    ("keywords:frequency", {"relation": "at least", "keyword": "c++", "frequency": 1}, "c++x", True),
    ("keywords:frequency", {"relation": "at least", "keyword": "E", "frequency": 2}, "e ée e", True),
    ("keywords:forbidden_words", {"forbidden_words": ["cat"]}, "Concat cats", True),
    ("keywords:forbidden_words", {"forbidden_words": ["cat"]}, "A CAT.", False),
    ("keywords:letter_frequency", {"letter": "A", "let_relation": "at least", "let_frequency": 2}, "aA", True),
    ("keywords:letter_frequency", {"letter": "a", "relation": "less than", "let_frequency": 0, "frequency": 1}, "b", True),
    ("change_case:capital_word_frequency", {"capital_relation": "at least", "capital_frequency": 4}, "AB I 'S aB CD'", False),
    ("change_case:capital_word_frequency", {"capital_relation": "at least", "capital_frequency": 3}, "AB I 'S aB CD'", True),
    ("change_case:english_capital", {}, "AB 1!", True),
    ("change_case:english_capital", {}, "12", False),
    ("change_case:english_lowercase", {}, "ab é", True),
    ("change_case:english_lowercase", {}, "ab 中", False),
    ("punctuation:no_comma", {}, "a,b", False),
    ("startend:quotation", {}, " “hi” ", True),
    ("startend:quotation", {}, "\"", False),
    ("startend:end_checker", {"end_phrase": "end"}, "the end \n", True),
    ("combination:two_responses", {}, "a ****** b", True),
    ("combination:repeat_prompt", {"prompt_to_repeat": "do it"}, "do it: done", True),
    ("made:up", {}, "x", None),
]


def test_instruction_checks(spark):
    rows = [(i, n, json.dumps(k), r) for i, (n, k, r, _) in enumerate(CHECK_CASES)]
    df = spark.createDataFrame(rows, "i int, n string, k string, r string")
    kw = F.from_json("k", checks.KWARGS)
    got = {r["i"]: r["ok"] for r in df.select("i", checks.check(F.col("n"), F.col("r"), kw).alias("ok")).collect()}
    for i, case in enumerate(CHECK_CASES):
        assert got[i] is case[3], case


def test_unknown_instruction_fails_the_prompt_only(spark):
    kw = f"array<{checks.KWARGS}>"
    df = spark.createDataFrame(
        [(1, "x", ["punctuation:no_comma", "made:up"], None), (2, "x", ["punctuation:no_comma"], None), (3, "x", [], None)],
        f"p int, response string, instruction_ids array<string>, kwargs {kw}",
    )
    checked = I.checked_instructions(df, ["p"])
    row = I.instruction_accuracy(checked, ["p"]).first()
    assert (row["prompts_pass"], row["prompts_total"], row["instructions_total"], row["instruction_accuracy"]) == (2, 3, 2, 1.0)
    assert [(r["instruction_id"], r["n"]) for r in I.unknown_instructions(checked).collect()] == [("made:up", 1)]


def test_gold_index(spark):
    df = spark.createDataFrame(
        [(" b ", "x"), ("", " y "), ("zz", "z"), (None, "none")], "letter string, answer string"
    ).withColumn("choices", F.array(F.lit("x"), F.lit("y")))
    got = [r[0] for r in df.select(prompts.gold_index(F.col("letter"), F.col("choices"), F.col("answer"))).collect()]
    assert got == [1, 1, -1, -1]


def test_perplexities(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", 1.0), ("a", nan), ("a", inf), ("b", nan), ("c", 25.0), ("d", 200.0)], "g string, loss double")
    got = {r["g"]: r for r in L.trainer_perplexity(df, ["g"]).collect()}
    assert abs(got["a"]["perplexity"] - 2.718281828) < 1e-6 and got["a"]["skipped"] == 2
    assert got["b"]["loss"] != got["b"]["loss"] and got["b"]["perplexity"] == inf and got["c"]["perplexity"] == inf
    stage = {r["g"]: r["perplexity"] for r in L.stage_perplexity(df, ["g"]).collect()}
    assert stage["b"] == inf and stage["c"] > 1e10 and abs(stage["d"] / 2.6881171418161356e43 - 1) < 1e-9
    texts = spark.createDataFrame([(0, " \n", 9.0, 9), (1, "one", 9.0, 0), (2, "two words", 2.0, 1), (3, "x y", 50.0, 1)],
                                  "doc_id long, text string, loss double, predicted_tokens int")
    capped = L.token_weighted_perplexity(texts, first=3).first()
    assert abs(capped["perplexity"] - 7.38905609893065) < 1e-9
    assert L.token_weighted_perplexity(texts, first=2).first()["perplexity"] == inf


def test_preference_loss_does_not_overflow(spark):
    df = spark.createDataFrame([(-2000.0, 0.0), (2000.0, 0.0)], "chosen_log_prob double, rejected_log_prob double")
    row = L.preference_metrics(df, 1.0).first()
    assert (row["loss"], row["accuracy"]) == (1000.0, 0.5)


def test_longest_common_sequence(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 80))], [rng.choice("abcd") for _ in range(rng.randint(0, 80))]) for i in range(20)]

    def brute(p, g):
        best = [[0] * (len(g) + 1) for _ in range(len(p) + 1)]
        for i, x in enumerate(p):
            for j, y in enumerate(g):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return 2 * best[-1][-1] / (len(p) + len(g)) if p and g else 0.0

    df = spark.createDataFrame(rows, "i int, p array<string>, g array<string>")
    got = {r["i"]: r["f"] for r in df.select("i", L.longest_common_f1(F.col("p"), F.col("g")).alias("f")).collect()}
    assert all(abs(got[i] - brute(p, g)) < 1e-12 for i, p, g in rows)


def test_sequence_log_prob_is_shifted(spark):
    df = spark.createDataFrame([([-1.0, -2.0, -4.0], [1, 1, 0, 1])], "lp array<double>, m array<int>")
    assert df.select(L.sequence_log_prob(F.col("lp"), F.col("m"))).first()[0] == -5.0


def test_the_json_check_runs_once_a_prompt(spark):
    asked = ["punctuation:no_comma", "detectable_format:json_format", "made:up"]
    df = spark.createDataFrame(
        [(1, '{"a": 1, "a": 2}', asked), (2, "[1, NaN]", asked[:2]), (3, "{]", asked), (4, None, asked), (5, "{}", asked[:1]), (6, "1", None)],
        "p int, response string, instruction_ids array<string>",
    ).withColumn("kwargs", F.lit(None).cast(f"array<{checks.KWARGS}>"))
    checked = I.checked_instructions(df, ["p"])
    got = {(r["p"], r["instruction_id"]): r["followed"] for r in checked.collect()}
    json_id, comma = asked[1], asked[0]
    assert [got.get((p, json_id)) for p in range(1, 7)] == [True, True, False, False, None, None]
    assert [got.get((p, comma)) for p in range(1, 7)] == [False, False, True, False, True, None]
    assert got[1, "made:up"] is None and (6, None) in got and len(got) == 13
    # No copy of a response for each instruction goes through Python.
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython [") == 1 and plan.index("Generate posexplode") < plan.index("EvalPython [")
    assert "EvalPython [" not in I.unknown_instructions(checked)._jdf.queryExecution().executedPlan().toString()
