"""A training corpus from raw documents: five stages, each written before the next one reads.

1. ``toxicity``: documents that the conditional random field rejects go.
2. ``quality``: documents that the co-trained views reject go.
3. ``near_duplicates``: of each class of documents linked by five-word shingles with a
   Jaccard similarity of 0.8 or more, the one of smallest id stays.
4. ``repeats``: strings of ``REPEAT`` bytes that start in more than one place are cut. The
   length is shorter than that of the numbered query, so that passages of fifty words count.
5. ``packing``: what is left is tokenised and packed into sequences of 2048 ids.

All but the last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bwt, cotrain, crf, jaccard, vector_packing
from tallyloom.sources.workspace import pin

REPEAT = 200

#: Trained models and iterated joins can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf.without_toxic(docs, _labels(spark, sf_dir))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotrain.without_poor(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each_class(docs, threshold=0.8, words=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bwt.without_repeats(docs, length=REPEAT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return vector_packing.packed_texts(docs, path, end=1)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
