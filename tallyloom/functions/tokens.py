"""Tokenizers and fixed-length rows as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The character tokenizer maps a character to 2 + code % 30,
# with 0 as padding and 1 as end of text.
PAD_ID, EOS_ID, FIRST_CHAR_ID, CHAR_IDS = 0, 1, 2, 30

# Fixed value: label of a position that carries no loss.
NO_LOSS = -100

# The chat layout.
CHAT_OPEN, CHAT_CLOSE = "<|im_start|>", "<|im_end|>"

# Fixed value: the text that ends the prompt part of a formatted instruction.
RESPONSE_MARKER = "### Response:\n"


def char_ids(text: Column) -> Column:
    ids = F.transform(
        F.split(text, ""), lambda c: (F.ascii(c) % CHAR_IDS + FIRST_CHAR_ID).cast("int")
    )
    return F.when(text == "", F.array().cast("array<int>")).otherwise(ids)


#: Texts of a batch that are turned into ids at a time.
TEXTS = 256


def batch_char_ids(text: Column) -> Column:
    """``char_ids`` of whole texts and the end of text, made from Arrow batches."""

    @F.arrow_udf("array<int>")
    def make(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), TEXTS):
            part = texts.slice(at, TEXTS)
            ended = "".join([f"{t}\0" for t in part.drop_null().to_pylist()])
            ids = np.frombuffer(ended.encode("utf-32-le"), np.int32) % CHAR_IDS + FIRST_CHAR_ID
            sizes = pc.fill_null(pc.add(pc.utf8_length(part), 1), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids[ends[1:][sizes > 0] - 1] = EOS_ID
            parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=part.is_null()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return make(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def with_eos(ids: Column) -> Column:
    return F.concat(ids, F.array(F.lit(EOS_ID)))


def padded(ids: Column, length: int, fill: int = PAD_ID) -> Column:
    """Cut or pad an array to exactly ``length`` entries."""
    return F.concat(
        F.slice(ids, 1, length),
        F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(ids), F.lit(0))),
    )


def attention_mask(ids: Column, length: int) -> Column:
    used = F.least(F.size(ids), F.lit(length))
    return F.concat(
        F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used)
    )


def labels_after(ids: Column, length: int, prompt_tokens: Column) -> Column:
    """Labels of a padded row: no loss on the prompt and none on padding."""
    used = F.least(F.size(ids), F.lit(length))
    prompt = F.least(F.greatest(prompt_tokens, F.lit(0)), used)
    return F.concat(
        F.array_repeat(F.lit(NO_LOSS), prompt),
        F.slice(ids, prompt + 1, used - prompt),
        F.array_repeat(F.lit(NO_LOSS), F.lit(length) - used),
    )


def fixed_length_row(ids: Column, length: int, prompt_tokens: Column | None = None) -> Column:
    start = F.lit(0) if prompt_tokens is None else prompt_tokens
    return F.struct(
        padded(ids, length).alias("input_ids"),
        attention_mask(ids, length).alias("attention_mask"),
        labels_after(ids, length, start).alias("labels"),
    )


def response_prompt_chars(text: Column) -> Column:
    """Characters up to and including the first response marker, 0 when it is absent."""
    at = F.locate(RESPONSE_MARKER, text)
    return F.when(at > 0, at + len(RESPONSE_MARKER) - 1).otherwise(0)


def chat_turn_pieces(role: Column, content: Column) -> Column:
    """The three pieces of one chat turn, with 1 only on what an assistant says."""
    spoken = F.when(role == "assistant", 1).otherwise(0)
    return F.array(
        F.struct(
            char_ids(F.concat(F.lit(CHAT_OPEN), role, F.lit("\n"))).alias("ids"),
            F.lit(0).alias("loss"),
        ),
        F.struct(char_ids(content).alias("ids"), spoken.alias("loss")),
        F.struct(
            char_ids(F.lit(CHAT_CLOSE + "\n")).alias("ids"), F.lit(0).alias("loss")
        ),
    )


def chat_turn_length(role: Column, content: Column) -> Column:
    """Token count of one chat turn under the character tokenizer, without the arrays."""
    fixed = len(CHAT_OPEN) + 1 + len(CHAT_CLOSE) + 1
    return F.char_length(role) + F.char_length(content) + F.lit(fixed)


def piece_ids(pieces: Column) -> Column:
    return F.flatten(F.transform(pieces, lambda p: p["ids"]))


def piece_mask(pieces: Column) -> Column:
    return F.flatten(
        F.transform(pieces, lambda p: F.array_repeat(p["loss"], F.size(p["ids"])))
    )


def subword_ids(text: Column, tokenizer: str) -> Column:
    """Ids from a tokenizer given as its JSON text; every worker builds it once."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(tokenizer)
        for batch in batches:
            found = coder.encode_batch(batch.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([item.ids for item in found])

    return encode(text)
