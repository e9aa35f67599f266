"""Preference and verifier tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import preference as P
from tallyloom.functions import text as T
from tallyloom.functions.draws import key_hash, uniform
from tallyloom.operators.ordered import totals_by_sort

# What a number may be moved or multiplied by to make it wrong.
CHANGES = [1.0, -1.0, 10.0, -10.0, 0.5, 2.0]


def dialogue_pairs(df: DataFrame) -> DataFrame:
    """Prompt, chosen and rejected from two full dialogues; rows with an empty side drop."""
    kept = [c for c in df.columns if c not in ("chosen", "rejected")]
    rows = df.select(
        *kept, P.dialogue_pair(F.col("chosen"), F.col("rejected")).alias("_p")
    ).select(*kept, "_p.*")
    return pair_texts(rows)


def pair_texts(df: DataFrame) -> DataFrame:
    usable = (F.col("chosen") != "") & (F.col("rejected") != "")
    return df.filter(usable).withColumns(
        {
            "chosen_text": P.pair_text(F.col("prompt"), F.col("chosen")),
            "rejected_text": P.pair_text(F.col("prompt"), F.col("rejected")),
        }
    )


def message_pairs(df: DataFrame) -> DataFrame:
    """Pairs whose sides are message lists; with a prompt only the last reply counts."""
    prompt = P.plain_text(F.col("prompt"))
    rows = df.withColumn("prompt", prompt)
    reply_only = F.col("prompt") != ""
    return pair_texts(
        rows.withColumns(
            {
                side: F.coalesce(P.message_text(F.col(side), reply_only), F.lit(""))
                for side in ("chosen", "rejected")
            }
        )
    )


def _wrong_number(answer: Column, seed: int, keys: list[Column]) -> Column:
    """Answer moved or scaled by a drawn amount; null when it is no number.

    Scaling that leaves the number as it is (by one, or of zero) moves it instead, so
    that the outcome is always wrong.
    """
    plain = F.replace(F.replace(answer, F.lit(","), F.lit("")), F.lit("$"), F.lit(""))
    number = plain.try_cast("double")
    change = F.element_at(
        F.array(*[F.lit(c) for c in CHANGES]),
        (key_hash(f"{seed}c", *keys) % len(CHANGES) + 1).cast("int"),
    )
    move = (uniform(f"{seed}m", *keys) > 0.5) | (number * change == number)
    made = F.when(move, number + change).otherwise(number * change)
    whole = made.try_cast("decimal(38,0)").cast("string")
    two_digits = made.try_cast("decimal(38,2)").cast("string")
    return F.when(made == F.floor(made), whole).otherwise(
        F.rtrim(F.rtrim(two_digits, F.lit("0")), F.lit("."))
    )


def verifier_examples(
    problems: DataFrame, seed: int, negatives: int = 1, key: str = "problem_id"
) -> DataFrame:
    """One right and ``negatives`` wrong answers per problem, with a shuffle key.

    A wrong answer is the answer of another problem or a changed number. With the
    problems sorted by answer, equal answers form one run; a drawn offset past the end
    of the own run picks among all other problems alike, so no candidate list is built
    and no draw has to be repeated.
    """
    rows = problems.select(
        key, "question", T.gold_answer(F.col("answer")).alias("gold")
    ).filter(F.col("gold").isNotNull())
    total = rows.count()
    sorted_rows = totals_by_sort(
        rows, {"place": F.lit(1)}, [F.col("gold"), F.col(key)]
    )
    runs = sorted_rows.groupBy("gold").agg(
        F.min("place").alias("_first"), F.count("*").alias("_same")
    )
    draws = F.sequence(F.lit(1), F.lit(negatives)) if negatives > 0 else F.array()
    drawn = rows.join(runs, "gold").withColumn("slot", F.explode(draws))
    keys = [F.col(key), F.col("slot")]
    others = F.lit(total) - F.col("_same")
    offset = key_hash(f"{seed}o", *keys) % F.greatest(others, F.lit(1))
    choices = drawn.withColumns(
        {
            "_changed": _wrong_number(F.col("gold"), seed, keys),
            "_place": (F.col("_first") + F.col("_same") + offset) % F.lit(max(total, 1)),
            "_wants_other": uniform(f"{seed}s", *keys) < 0.5,
        }
    )
    picked = sorted_rows.select(
        F.col("place").alias("_place"), F.col("gold").alias("_other")
    )
    use_other = (F.col("_wants_other") & (F.lit(total) > F.col("_same"))) | (
        F.col("_changed").isNull() & F.lit(total > 1)
    )
    wrong = choices.join(picked, "_place").select(
        key,
        "question",
        F.when(use_other, F.col("_other"))
        .otherwise(F.coalesce("_changed", F.lit("0")))
        .alias("answer"),
        F.lit(0).alias("label"),
        "slot",
    )
    right = rows.select(
        key,
        "question",
        F.col("gold").alias("answer"),
        F.lit(1).alias("label"),
        F.lit(0).alias("slot"),
    )
    return right.unionByName(wrong).select(
        key,
        "slot",
        "label",
        "answer",
        T.verifier_text(F.col("question"), F.col("answer")).alias("text"),
        uniform(seed, F.col(key), F.col("slot")).alias("order_key"),
    )
