"""Instruction-following scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.checks import JSON_CHECK, KWARGS, check, json_text
from tallyloom.operators.scoring import share_of


def checked_instructions(prompts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per instruction of a prompt; ids and kwargs pair up by position.

    A missing kwargs list counts as one empty entry per id, otherwise the shorter
    list decides. The JSON check needs Python and no kwargs: it is made once a prompt, before
    the response is repeated for each instruction.
    """
    ids = F.col("instruction_ids")
    kwargs = F.coalesce("kwargs", F.array().cast(f"array<{KWARGS}>"))
    usable = F.when(F.col("kwargs").isNull(), F.size(ids)).otherwise(
        F.least(F.size(ids), F.size("kwargs"))
    )
    pairs = F.slice(F.arrays_zip(ids.alias("id"), kwargs.alias("kw")), F.lit(1), usable)
    asked = F.when(F.array_contains(ids, JSON_CHECK), F.col("response"))
    with_json = prompts.select(
        *keys, "response", pairs.alias("_pairs"), json_text(asked, F.lit(None)).alias("_json")
    )
    return with_json.select(*keys, "response", "_json", F.posexplode_outer("_pairs").alias("slot", "_p")).select(
        *keys,
        "slot",
        F.col("_p.id").alias("instruction_id"),
        check(F.col("_p.id"), F.col("response"), F.col("_p.kw"), F.col("_json")).alias("followed"),
    )


def prompt_outcomes(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts pass when every instruction is followed; an unknown one fails its prompt."""
    real = F.col("instruction_id").isNotNull()
    return checked.groupBy(*keys).agg(
        F.bool_and(~real | F.coalesce("followed", F.lit(False))).alias("passed"),
        F.count("followed").alias("instructions"),
        F.count_if("followed").alias("instructions_passed"),
    )


def instruction_accuracy(checked: DataFrame, keys: list[str]) -> DataFrame:
    return prompt_outcomes(checked, keys).agg(
        share_of(F.col("passed")).alias("prompt_accuracy"),
        F.coalesce(
            F.try_divide(F.sum("instructions_passed"), F.sum("instructions")), F.lit(0.0)
        ).alias("instruction_accuracy"),
        F.count("*").alias("prompts_total"),
        F.count_if("passed").alias("prompts_pass"),
        F.coalesce(F.sum("instructions"), F.lit(0)).alias("instructions_total"),
        F.coalesce(F.sum("instructions_passed"), F.lit(0)).alias("instructions_pass"),
    )


def unknown_instructions(checked: DataFrame) -> DataFrame:
    unknown = F.col("instruction_id").isNotNull() & F.col("followed").isNull()
    return checked.filter(unknown).groupBy("instruction_id").agg(F.count("*").alias("n"))
