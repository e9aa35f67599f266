"""Vocabulary training, subword ids and the batch hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.scorer import mapped_batches, scored
from tallyloom.operators import vocab as V
from tallyloom.plans.registry import query, table, texts
from tallyloom.sources.workspace import pin

VOCABULARY = 16_000
MERGES = VOCABULARY - 256 - len(V.SPECIAL_TOKENS)


def _counts(spark, sf_dir):
    docs = texts(spark, sf_dir).filter(F.char_length("text") >= 16)
    return pin(V.piece_counts(docs))


@query("vocabulary_merges")
def vocabulary_merges(spark, sf_dir):
    """All merges of a vocabulary of 16,000 ids (fewer where no pair occurs twice)."""
    counts = _counts(spark, sf_dir)
    return V.merge_table(counts, V.learned_merges(counts, MERGES))


@query("subword_lengths")
def subword_lengths(spark, sf_dir):
    """Subword count of every document under a vocabulary learned from all of them."""
    learned = V.learned_merges(_counts(spark, sf_dir), MERGES)
    docs = texts(spark, sf_dir).filter(F.col("text") != "")
    pieces = pin(V.piece_lengths(pin(V.piece_counts(docs)), learned))
    return V.token_counts(docs, pieces)


@query(
    "model_scores",
    "SELECT o_orderkey, (length(o_orderstatus || o_orderkey) * 7 + length(o_orderpriority)) % 1000 / 1000.0::DOUBLE AS score FROM orders",
)
def model_scores(spark, sf_dir):
    def stand_in():
        """A fixed rule in place of a model."""
        return lambda q, a: (q.str.len() * 7 + a.str.len()) % 1000 / 1000.0

    question = F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", scored(question, F.col("o_orderpriority"), stand_in).alias("score")
    )


@query(
    "mapped_batches",
    "SELECT conv_id, turn, length(text) AS n_chars, reverse(role) AS backwards FROM conversations",
)
def mapped(spark, sf_dir):
    def measure(batch):
        return batch.assign(
            n_chars=batch["text"].str.len(), backwards=batch["role"].str[::-1]
        )[["conv_id", "turn", "n_chars", "backwards"]]

    turns = table(spark, sf_dir, "conversations")
    return mapped_batches(
        turns,
        measure,
        ["conv_id", "turn", "role", "text"],
        "conv_id long, turn long, n_chars long, backwards string",
    )
