"""Chat and instruction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import chat as C
from tallyloom.functions import tokens as K


def widened(df: DataFrame) -> DataFrame:
    """Add the schema columns a source lacks, as nulls."""
    missing = {
        name: F.lit(None).cast(kind)
        for name, kind in C.WIDE_SCHEMA.items()
        if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def adapted_examples(df: DataFrame, name: str) -> DataFrame:
    """Instruction, input and output of every usable row."""
    kept = [c for c in df.columns if c not in C.WIDE_SCHEMA]
    return (
        widened(df)
        .select(*kept, C.adapted(F.col(name)).alias("_e"))
        .filter(F.col("_e").isNotNull())
        .select(*kept, "_e.*")
    )


def normalised_chats(df: DataFrame) -> DataFrame:
    """Conversations that have at least one assistant turn."""
    kept = [c for c in df.columns if c not in C.WIDE_SCHEMA]
    rows = widened(df).select(*kept, C.normalised_messages().alias("messages"))
    return rows.filter(F.col("messages").isNotNull() & C.has_answer(F.col("messages")))


def chat_tokens(chats: DataFrame, max_tokens: int) -> DataFrame:
    """Ids and loss mask of whole conversations no longer than ``max_tokens``.

    The length is tested before the end-of-text token is added, and before any array
    is built.
    """
    kept = [c for c in chats.columns if c != "messages"]
    length = F.aggregate(
        "messages",
        F.lit(0),
        lambda n, m: n + K.chat_turn_length(m["role"], m["content"]),
    )
    pieces = F.flatten(
        F.transform("messages", lambda m: K.chat_turn_pieces(m["role"], m["content"]))
    )
    return (
        chats.filter(length <= max_tokens)
        .withColumn("_pieces", pieces)
        .select(
            *kept,
            K.with_eos(K.piece_ids(F.col("_pieces"))).alias("ids"),
            F.concat(K.piece_mask(F.col("_pieces")), F.array(F.lit(0))).alias("mask"),
        )
    )


def response_rows(texts: DataFrame, length: int) -> DataFrame:
    """Fixed-length rows of formatted instructions with loss on the response only."""
    kept = [c for c in texts.columns if c != "text"]
    ids = texts.withColumn("_ids", K.char_ids(F.col("text")))
    prompt = K.response_prompt_chars(F.col("text"))
    return ids.select(*kept, K.fixed_length_row(F.col("_ids"), length, prompt).alias("_r")).select(
        *kept, "_r.*"
    )


def padded_rows(texts: DataFrame, length: int) -> DataFrame:
    kept = [c for c in texts.columns if c != "text"]
    ids = texts.withColumn("_ids", K.char_ids(F.col("text")))
    return ids.select(*kept, K.fixed_length_row(F.col("_ids"), length).alias("_r")).select(
        *kept, "_r.*"
    )


def with_history(passages: DataFrame) -> DataFrame:
    """One row per question, with the passage's earlier questions and gold answers."""
    kept = [c for c in passages.columns if c not in ("questions", "answers", "story")]
    pairs = F.filter(
        F.arrays_zip(F.col("questions").alias("q"), F.col("answers").alias("a")),
        lambda p: p["q"].isNotNull() & p["a"].isNotNull(),
    )
    turns = passages.withColumn("_pairs", pairs).withColumn(
        "_said",
        F.transform(
            "_pairs",
            lambda p: F.concat(F.lit("Q: "), p["q"], F.lit("\nA: "), p["a"], F.lit("\n")),
        ),
    )
    exploded = turns.select(
        *kept, "story", "_said", F.posexplode("_pairs").alias("turn", "_pair")
    )
    history = F.array_join(F.slice("_said", F.lit(1), F.col("turn")), "")
    return exploded.select(
        *kept,
        "turn",
        F.col("_pair.q").alias("question"),
        F.col("_pair.a").alias("gold"),
        F.concat(
            F.lit("Passage: "), F.col("story"), F.lit("\n"), history,
            F.lit("Q: "), F.col("_pair.q"), F.lit("\nA:"),
        ).alias("prompt"),
    )
