"""Hook for a model that scores question and answer pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def scored(question: Column, answer: Column, load: Callable[[], Scorer]) -> Column:
    """Probability that an answer is right; ``load`` runs once per Python worker task."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for questions, answers in batches:
            yield model(questions, answers)

    return score(question, answer)


def mapped_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], reads: Sequence[str], schema: str
) -> DataFrame:
    """Batch map over the named columns only; the other columns are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.select(*reads).mapInPandas(run, schema)
