"""Chat and instruction schemas as column expressions.

An example is ``struct<instruction, input, output>`` or null when the row is unusable.
A conversation is ``array<struct<role, content>>``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import bound, first_filled, strip

EXAMPLE = "struct<instruction:string,input:string,output:string>"
MESSAGES = "array<struct<role:string,content:string>>"

# Columns an example row may have; a source fills the ones of its own schema.
WIDE_SCHEMA = {
    "messages": MESSAGES,
    "conversations": "array<struct<from:string,value:string>>",
    "instruction": "string",
    "input": "string",
    "output": "string",
    "prompt": "string",
    "query": "string",
    "question": "string",
    "response": "string",
    "answer": "string",
    "problem": "string",
    "solution": "string",
    "generated_solution": "string",
    "expected_answer": "string",
    "story": "string",
    "questions": "array<string>",
    "answers": "struct<input_text:array<string>>",
}

# Instruction layouts.
WITH_INPUT = "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n{output}"
WITHOUT_INPUT = "### Instruction:\n{instruction}\n\n### Response:\n{output}"

# Names in the share format and what they stand for.
SHARE_ROLES = {"human": "user", "gpt": "assistant", "system": "system"}
TOKENIZER_SHARE_ROLES = {
    "human": "user",
    "user": "user",
    "gpt": "assistant",
    "chatgpt": "assistant",
    "assistant": "assistant",
    "system": "system",
}
SYSTEM_PREFIX = "[System] "


def layout(template: str, **fields: Column) -> Column:
    """Text of a ``{name}`` template with columns filled in."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(fields[name])
    return F.concat(*parts)


def example(instruction: Column, input_text: Column, output: Column) -> Column:
    usable = (F.coalesce(instruction, F.lit("")) != "") & (
        F.coalesce(output, F.lit("")) != ""
    )
    row = F.struct(
        instruction.alias("instruction"), input_text.alias("input"), output.alias("output")
    )
    return F.when(usable, row)


def from_messages(messages: Column) -> Column:
    """Last assistant turn as output, all turns before it as instruction."""

    def build(msgs: Column) -> Column:
        from_end = F.array_position(
            F.reverse(F.transform(msgs, lambda m: m["role"])), "assistant"
        )
        answer_at = (F.size(msgs) - from_end + 1).cast("int")
        earlier = F.filter(
            F.slice(msgs, 1, F.greatest(answer_at - 1, F.lit(0))),
            lambda m: F.coalesce(m["content"], F.lit("")) != "",
        )
        said = F.transform(
            earlier,
            lambda m: F.when(
                m["role"] == "system", F.concat(F.lit(SYSTEM_PREFIX), m["content"])
            ).otherwise(m["content"]),
        )
        return F.when(
            (from_end > 0) & (answer_at > 1),
            example(
                strip(F.array_join(said, "\n\n")),
                F.lit(""),
                F.try_element_at(msgs, answer_at)["content"],
            ),
        )

    return F.when(F.size(messages) > 0, bound(messages, build))


def _renamed(role: Column, names: dict[str, str], other: str | None) -> Column:
    known = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    mapped = F.try_element_at(known, role)
    return mapped if other is None else F.coalesce(mapped, F.lit(other))


def share_as_messages(turns: Column) -> Column:
    return F.transform(
        turns,
        lambda t: F.struct(
            _renamed(F.coalesce(t["from"], F.lit("")), SHARE_ROLES, "user").alias("role"),
            t["value"].alias("content"),
        ),
    )


def adapt_messages() -> Column:
    return from_messages(F.col("messages"))


def adapt_share() -> Column:
    return from_messages(share_as_messages(F.col("conversations")))


def adapt_instruction() -> Column:
    return example(
        F.col("instruction"), F.coalesce("input", F.lit("")), F.col("output")
    )


def adapt_prompt_response() -> Column:
    return example(
        first_filled(F.col("prompt"), F.col("query"), F.col("question")),
        F.lit(""),
        first_filled(F.col("response"), F.col("answer")),
    )


def adapt_query_response() -> Column:
    return example(F.col("query"), F.lit(""), F.col("response"))


def adapt_problem_solution() -> Column:
    return example(
        F.col("problem"),
        F.lit(""),
        first_filled(F.col("generated_solution"), F.col("expected_answer")),
    )


def adapt_passage() -> Column:
    first_answer = F.try_element_at(F.col("answers.input_text"), F.lit(1))
    found = example(
        F.try_element_at(F.col("questions"), F.lit(1)), F.col("story"), first_answer
    )
    return F.when(F.coalesce("story", F.lit("")) != "", found)


def adapt_any() -> Column:
    return F.coalesce(adapt_instruction(), adapt_prompt_response())


# Which part of a data set's name selects which schema, first match wins.
ADAPTERS: list[tuple[str, Callable[[], Column]]] = [
    ("tulu-3-sft-mixture", adapt_messages),
    ("smoltalk", adapt_messages),
    ("no_robots", adapt_messages),
    ("OpenHermes-2.5", adapt_share),
    ("MetaMathQA", adapt_query_response),
    ("OpenMathInstruct-2", adapt_problem_solution),
    ("ifeval-like-data", adapt_prompt_response),
    ("coqa", adapt_passage),
    ("alpaca", adapt_instruction),
]


def adapter_for(name: str) -> Callable[[], Column]:
    low = name.lower()
    return next((a for key, a in ADAPTERS if key.lower() in low), adapt_any)


def adapted(name: Column) -> Column:
    """Example of a row by the name of its data set."""
    chosen = adapt_any()
    for adapter, entries in groupby(reversed(ADAPTERS), key=lambda entry: entry[1]):
        named = [F.contains(F.lower(name), F.lit(key.lower())) for key, _ in entries]
        chosen = F.when(reduce(or_, named), adapter()).otherwise(chosen)
    return chosen


def _messages_kept() -> Column:
    return F.filter(
        F.col("messages"),
        lambda m: m["role"].isin("user", "assistant", "system") & m["content"].isNotNull(),
    )


def _share_kept() -> Column:
    turns = F.transform(
        F.col("conversations"),
        lambda t: F.struct(
            _renamed(F.lower(F.coalesce(t["from"], F.lit(""))), TOKENIZER_SHARE_ROLES, None).alias(
                "role"
            ),
            t["value"].alias("content"),
        ),
    )
    return F.filter(turns, lambda m: m["role"].isNotNull() & m["content"].isNotNull())


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _passage_turns() -> Column:
    pairs = F.filter(
        F.arrays_zip(
            F.col("questions").alias("q"), F.col("answers.input_text").alias("a")
        ),
        lambda p: p["q"].isNotNull() & p["a"].isNotNull(),
    )
    turns = F.flatten(
        F.transform(
            pairs, lambda p: F.array(_message("user", p["q"]), _message("assistant", p["a"]))
        )
    )
    same_length = F.size("questions") == F.size("answers.input_text")
    return F.when(
        F.col("story").isNotNull() & same_length & (F.size(turns) > 0),
        F.concat(F.array(_message("system", F.col("story"))), turns),
    )


def normalised_messages() -> Column:
    """Conversation of a wide row for tokenizing; null when there is none."""
    asked = F.coalesce(
        first_filled(*[F.col(c) for c in ("question", "problem", "instruction", "query")]),
        F.col("query"),
    )
    answered = F.coalesce(
        first_filled(
            *[F.col(c) for c in ("answer", "solution", "response", "generated_solution", "output")]
        ),
        F.col("output"),
    )
    pair = F.array(_message("user", asked), _message("assistant", answered))
    found = (
        F.when(F.col("messages").isNotNull(), _messages_kept())
        .when(F.col("conversations").isNotNull(), _share_kept())
        .when(asked.isNotNull() & answered.isNotNull(), pair)
        .otherwise(_passage_turns())
    )
    return F.when(F.size(found) > 0, found)


def has_answer(messages: Column) -> Column:
    return F.exists(messages, lambda m: m["role"] == "assistant")


def instruction_text(instruction: Column, input_text: Column, output: Column) -> Column:
    fields = {
        "instruction": strip(instruction),
        "input": strip(input_text),
        "output": strip(output),
    }
    with_input = F.coalesce(strip(input_text), F.lit("")) != ""
    return F.when(with_input, layout(WITH_INPUT, **fields)).otherwise(
        layout(WITHOUT_INPUT, **fields)
    )


def instruction_row_text(columns: list[str], include_input: bool = True) -> Column:
    """Training text of a row: an instruction pair, else its text, else the chosen side."""
    if "instruction" in columns and "output" in columns:
        given = F.col("input") if include_input and "input" in columns else F.lit("")
        return instruction_text(F.col("instruction"), given, F.col("output"))
    for name in ("text", "chosen"):
        if name in columns:
            return F.col(name)
    return F.lit(None).cast("string")


