"""Scores over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators.ordered import totals_by_sort


def share_of(condition: Column) -> Column:
    """Share of true values; 0 for no rows."""
    return F.coalesce(F.avg(condition.cast("int")), F.lit(0.0))


def accuracy(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    return df.agg(
        share_of(F.col(predicted) == F.col(gold)).alias("accuracy"), F.count("*").alias("total")
    )


def exact_match(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    same = T.strip(F.col(predicted).cast("string")) == T.strip(F.col(gold).cast("string"))
    return df.agg(share_of(same).alias("exact_match"), F.count("*").alias("total"))


def grouped_accuracy(df: DataFrame, correct: Column, groups: Sequence[str]) -> DataFrame:
    """Accuracy by group and overall; the overall row has null groups."""
    return df.rollup(*groups).agg(
        share_of(correct).alias("accuracy"),
        F.count_if(correct).alias("correct"),
        F.count("*").alias("total"),
    )


def accuracy_by_sets(
    df: DataFrame, correct: Column, sets: Sequence[Sequence[str]], groups: Sequence[str]
) -> DataFrame:
    """Accuracy over chosen grouping sets."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *groups).agg(
        share_of(correct).alias("accuracy"),
        F.count_if(correct).alias("correct"),
        F.count("*").alias("total"),
    )


def binary_scores(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """F1 of class 1 and the Matthews correlation, in one pass."""
    p, g = F.col(predicted), F.col(gold)
    counts = df.agg(
        F.count_if((p == 1) & (g == 1)).cast("double").alias("tp"),
        F.count_if((p == 0) & (g == 0)).cast("double").alias("tn"),
        F.count_if((p == 1) & (g == 0)).cast("double").alias("fp"),
        F.count_if((p == 0) & (g == 1)).cast("double").alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.select(
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        F.coalesce(F.try_divide(tp * tn - fp * fn, spread), F.lit(0.0)).alias("matthews"),
        F.col("tp").cast("long").alias("tp"),
        F.col("tn").cast("long").alias("tn"),
        F.col("fp").cast("long").alias("fp"),
        F.col("fn").cast("long").alias("fn"),
    )


def class_scores(df: DataFrame, predicted: str, gold: str, classes: int) -> DataFrame:
    """F1 of each class and their mean; a class never seen counts with 0."""
    pairs = df.groupBy(predicted, gold).count()
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col(predicted).cast("long").alias("class"), F.lit("p").alias("side")),
                F.struct(F.col(gold).cast("long").alias("class"), F.lit("g").alias("side")),
            )
        ).alias("_x"),
        (F.col(predicted) == F.col(gold)).alias("_same"),
        "count",
    ).select("_x.*", "_same", "count")
    predicted_side = F.col("side") == "p"
    counts = sides.groupBy("class").agg(
        F.sum(F.when(predicted_side & F.col("_same"), F.col("count")).otherwise(0)).alias("tp"),
        F.sum(F.when(predicted_side & ~F.col("_same"), F.col("count")).otherwise(0)).alias("fp"),
        F.sum(F.when(~predicted_side & ~F.col("_same"), F.col("count")).otherwise(0)).alias("fn"),
    )
    all_classes = df.sparkSession.range(classes).withColumnRenamed("id", "class")
    filled = all_classes.join(counts, "class", "left").fillna(0, ["tp", "fp", "fn"])
    score = F.coalesce(
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)
    )
    scored = filled.select("class", "tp", "fp", "fn", score.alias("f1"))
    return scored.rollup("class").agg(
        F.avg("f1").alias("f1"),
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        F.sum("fn").alias("fn"),
    )


def _correlation(x: str, y: str) -> Column:
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation; 0 without rows or without variance."""
    pair = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    return pair.agg(_correlation("_x", "_y").alias("pearson"))


def spearman(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Correlation of sort positions; equal values keep the order of ``key``."""
    rows = df.select(key, x, y)
    by_x = totals_by_sort(rows, {"rank_x": F.lit(1)}, [F.col(x), F.col(key)])
    by_both = totals_by_sort(by_x, {"rank_y": F.lit(1)}, [F.col(y), F.col(key)])
    return by_both.agg(_correlation("rank_x", "rank_y").alias("spearman"))


def expected_bucket(log_probs: Column) -> Column:
    """Mean bucket number under the softmax of the buckets' log probabilities."""
    top = F.array_max(log_probs)
    weight = F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    moment = F.aggregate(
        F.transform(log_probs, lambda x, i: F.exp(x - top) * i),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    return moment / weight


def token_overlap(
    pairs: DataFrame, keys: Sequence[str], empty_by_tokens: bool
) -> DataFrame:
    """Exact match and token F1 of ``predicted`` against ``gold`` for each key.

    Tokens are counted as rows, so repeats count as often as both sides have them, and
    long texts cost no more than their length. ``empty_by_tokens`` chooses whether
    emptiness is judged on the tokens or on the raw texts.
    """
    p, g = F.col("predicted"), F.col("gold")
    marked = pairs.select(
        *keys,
        (T.qa_normalised(p) == T.qa_normalised(g)).cast("int").alias("_em"),
        (p == "").cast("int").alias("_no_p"),
        (g == "").cast("int").alias("_no_g"),
        F.transform(T.qa_tokens(p), lambda t: F.struct(t.alias("t"), F.lit(1).alias("p"))).alias("_p"),
        F.transform(T.qa_tokens(g), lambda t: F.struct(t.alias("t"), F.lit(0).alias("p"))).alias("_g"),
    )
    flags = ["_em", "_no_p", "_no_g"]
    tokens = marked.select(*keys, *flags, F.explode_outer(F.concat("_p", "_g")).alias("_t"))
    by_token = tokens.groupBy(*keys, F.col("_t.t").alias("_token")).agg(
        *[F.max(f).alias(f) for f in flags],
        F.count_if(F.col("_t.p") == 1).alias("_np"),
        F.count_if(F.col("_t.p") == 0).alias("_ng"),
    )
    totals = by_token.groupBy(*keys).agg(
        *[F.max(f).alias(f) for f in flags],
        F.sum(F.least("_np", "_ng")).alias("_both"),
        F.sum("_np").alias("_np"),
        F.sum("_ng").alias("_ng"),
    )
    if empty_by_tokens:
        no_p, no_g = F.col("_np") == 0, F.col("_ng") == 0
    else:
        no_p, no_g = F.col("_no_p") == 1, F.col("_no_g") == 1
    f1 = (
        F.when(no_p & no_g, 1.0)
        .when(no_p | no_g | (F.col("_both") == 0), 0.0)
        .otherwise(2 * F.col("_both") / (F.col("_np") + F.col("_ng")))
    )
    return totals.select(*keys, F.col("_em").alias("em"), f1.alias("f1"))


def best_over_golds(
    answers: DataFrame, keys: Sequence[str], empty_by_tokens: bool
) -> DataFrame:
    """Best exact match and F1 over ``golds``; a list without a filled gold stands for one
    empty gold."""
    filled = F.when(F.exists("golds", lambda g: T.strip(g) != ""), F.col("golds"))
    spread = answers.select(
        *keys, "predicted", F.posexplode_outer(filled).alias("_no", "_gold")
    ).select(
        *keys,
        "predicted",
        F.coalesce("_no", F.lit(0)).alias("_no"),
        F.coalesce("_gold", F.lit("")).alias("gold"),
    )
    scored = token_overlap(spread, [*keys, "_no"], empty_by_tokens)
    return scored.groupBy(*keys).agg(F.max("em").alias("em"), F.max("f1").alias("f1"))


def answerable_report(scored: DataFrame) -> DataFrame:
    """Exact match and F1 in percent over all, answerable and unanswerable questions."""

    def percent(value: str, which: Column | None) -> Column:
        picked = F.col(value) if which is None else F.when(which, F.col(value))
        return F.coalesce(F.avg(picked) * 100, F.lit(0.0))

    has, no = F.col("has_answer"), ~F.col("has_answer")
    return scored.agg(
        percent("em", None).alias("exact_match"),
        percent("f1", None).alias("f1"),
        percent("em", has).alias("has_exact"),
        percent("f1", has).alias("has_f1"),
        percent("em", no).alias("no_exact"),
        percent("f1", no).alias("no_f1"),
        F.count("*").alias("total"),
        F.count_if(has).alias("has_total"),
        F.count_if(no).alias("no_total"),
    )


def best_choice(
    scores: DataFrame, keys: Sequence[str], choice: str, score: Column
) -> DataFrame:
    """Highest-scoring choice of each item; of equal scores the first choice wins."""
    return scores.groupBy(*keys).agg(
        F.min_by(choice, F.struct(-score, F.col(choice))).alias("picked")
    )


def completion_scores(
    tokens: DataFrame, choices: DataFrame, keys: Sequence[str], normalise: bool = False
) -> DataFrame:
    """Summed log probability of each completion; one without tokens scores 0."""
    summed = tokens.groupBy(*keys).agg(
        F.sum("log_prob").alias("_sum"), F.count("*").alias("_n")
    )
    length = F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1)) if normalise else F.lit(1)
    return choices.join(summed, list(keys), "left").select(
        *choices.columns, (F.coalesce("_sum", F.lit(0.0)) / length).alias("score")
    )


def rerank_outcomes(
    candidates: DataFrame, golds: DataFrame, question: str = "question"
) -> DataFrame:
    """Is the first candidate right, and is the best-scored one?"""
    picked = candidates.groupBy(question).agg(
        F.min_by("answer", "candidate").alias("base_answer"),
        F.min_by("answer", F.struct(-F.col("score"), F.col("candidate"))).alias("best_answer"),
    )
    judged = golds.join(picked, question).withColumns(
        {
            "base_right": F.col("base_answer") == F.col("gold"),
            "best_right": F.col("best_answer") == F.col("gold"),
        }
    )
    outcome = (
        F.when(F.col("best_right") & ~F.col("base_right"), "rescued")
        .when(~F.col("best_right") & F.col("base_right"), "wrongly rejected")
        .when(F.col("base_right"), "right")
        .otherwise("wrong")
    )
    return judged.withColumn("outcome", outcome)


def rerank_gain(outcomes: DataFrame, group: str) -> DataFrame:
    return outcomes.groupBy(group).agg(
        share_of(F.col("base_right")).alias("accuracy"),
        share_of(F.col("best_right")).alias("accuracy_reranked"),
        (share_of(F.col("best_right")) - share_of(F.col("base_right"))).alias("gain"),
        F.count("*").alias("total"),
    )


def judged_numbers(answers: DataFrame) -> DataFrame:
    """Extracted answer, whether it is right, and the kind of error if not.

    The kinds are tested in order: the gold number stands in the text, the number is
    within a fifth of the gold one, anything else.
    """
    predicted = T.number_answer_loose(F.col("output"))
    rows = answers.withColumns(
        {"predicted": predicted, "_p": T.plain_number(predicted), "_g": T.plain_number(F.col("gold"))}
    )
    number = F.when(F.col("_p") == "", F.lit(0.0)).otherwise(F.col("_p").try_cast("double"))
    gold = F.col("_g").try_cast("double")
    kind = (
        F.when(F.contains(F.col("output"), F.col("_g")), "extraction")
        .when(F.abs(number - gold) < F.abs(gold) * 0.2, "arithmetic")
        .otherwise("reasoning")
    )
    return rows.withColumns(
        {"correct": F.col("_p") == F.col("_g"), "error": F.when(F.col("_p") != F.col("_g"), kind)}
    ).drop("_p", "_g")


def checked_pairs(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Predictions joined to references; it is an error when either side is alone."""
    joined = predictions.withColumn("_p", F.lit(1)).join(
        references.withColumn("_r", F.lit(1)), key, "full_outer"
    )
    alone = F.col("_p").isNull() | F.col("_r").isNull()
    message = F.lit("predictions and references do not match")
    return joined.filter(
        F.when(alone, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    ).drop("_p", "_r")


def unmatched(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with that side's name."""
    both = predictions.select(key, F.lit(1).alias("_p")).join(references.select(key, F.lit(1).alias("_r")), key, "full_outer")
    side = F.when(F.col("_r").isNull(), "predictions").when(F.col("_p").isNull(), "references")
    return both.select(key, side.alias("only_in")).filter(F.col("only_in").isNotNull())


def most_easy(rows: DataFrame, subset: str, easy: Column) -> DataFrame:
    """Easy rows of each subset, or all of its rows when none is marked easy."""
    marked = rows.withColumn("_easy", F.coalesce(easy, F.lit(False)))
    any_easy = marked.groupBy(subset).agg(F.bool_or("_easy").alias("_any"))
    return (
        marked.join(any_easy, subset)
        .filter(F.col("_easy") | ~F.col("_any"))
        .drop("_easy", "_any")
    )
