"""Preference pairs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import bound, capitalised, strip

# Fixed pattern: start of an assistant turn in a full dialogue.
ASSISTANT_TURN = r"\n\nAssistant:\s*"


def split_dialogue(text: Column) -> Column:
    """Prompt and reply around the last assistant marker; no marker means no reply."""

    def cut(parts: Column) -> Column:
        reply = F.element_at(parts, -1)
        marks = F.regexp_extract_all(text, F.lit(ASSISTANT_TURN), F.lit(0))
        tail = F.char_length(reply) + F.char_length(F.element_at(marks, -1))
        prompt = F.left(text, F.char_length(text) - tail)
        return (
            F.when(
                F.size(parts) > 1,
                F.struct(strip(prompt).alias("prompt"), strip(reply).alias("reply")),
            )
            .otherwise(F.struct(strip(text).alias("prompt"), F.lit("").alias("reply")))
        )

    return bound(F.split(text, ASSISTANT_TURN), cut)


def dialogue_pair(chosen: Column, rejected: Column) -> Column:
    """Prompt of the chosen side and both replies."""
    empty = F.lit("")
    kept = split_dialogue(F.coalesce(chosen, empty))
    other = split_dialogue(F.coalesce(rejected, empty))
    return F.struct(
        kept["prompt"].alias("prompt"),
        kept["reply"].alias("chosen"),
        other["reply"].alias("rejected"),
    )


def message_text(messages: Column, reply_only: Column) -> Column:
    """Last assistant turn, or all turns as ``Role: content`` lines."""
    replies = F.filter(messages, lambda m: m["role"] == "assistant")
    spoken = F.filter(
        messages, lambda m: strip(F.coalesce(m["content"], F.lit(""))) != ""
    )
    lines = F.transform(
        spoken,
        lambda m: F.concat(
            capitalised(F.coalesce(m["role"], F.lit("user"))), F.lit(": "), strip(m["content"])
        ),
    )
    whole = strip(F.array_join(lines, "\n"))
    last_reply = F.try_element_at(replies, F.lit(-1))["content"]
    return F.when(
        reply_only & (F.size(replies) > 0), strip(F.coalesce(last_reply, F.lit("")))
    ).otherwise(whole)


def plain_text(value: Column) -> Column:
    return F.coalesce(strip(value), F.lit(""))


def pair_text(prompt: Column, reply: Column) -> Column:
    return F.when(prompt != "", F.concat(prompt, F.lit("\n"), reply)).otherwise(reply)
