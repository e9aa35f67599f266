"""Whole rows through an operator that needs some of their columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_aside(docs: DataFrame, needed: list[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The needed columns with all others in one column ``_rest``, and the way back.

    So no other column's name can meet a name the operator uses; new columns follow by name.
    """
    others = [c for c in docs.columns if c not in needed]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)
    inner = docs.select(*needed, rest.alias("_rest"))

    def back(found: DataFrame, *new: str) -> DataFrame:
        return found.select(
            *[F.col(c) if c in needed else F.col("_rest").getField(c).alias(c) for c in docs.columns], *new
        )

    return inner, back
