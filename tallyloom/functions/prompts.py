"""Benchmark prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.chat import layout
from tallyloom.functions.text import strip

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Prompt texts of the benchmarks; {a}, {b} and {c} are the row's fields.
TEMPLATES = {
    "cola": "{a}\nQuestion: Is this sentence grammatically acceptable?\nAnswer:",
    "sst2": "Review: {a}\nSentiment:",
    "mrpc": "Sentence 1: {a}\nSentence 2: {b}\nDo they mean the same thing?\nAnswer:",
    "qqp": "Question 1: {a}\nQuestion 2: {b}\nAre these duplicate questions?\nAnswer:",
    "mnli": "{a}\nQuestion: {b} True, False, or Neither?\nAnswer:",
    "qnli": "{a}\nQuestion: {b}\nDoes the sentence answer the question?\nAnswer:",
    "rte": "{a}\nQuestion: {b} True or False?\nAnswer:",
    "stsb": "Sentence 1: {a}\nSentence 2: {b}\nSimilarity (0-5):",
    "anli": "{a}\nQuestion: {b} True, False, or Neither?\nAnswer:",
    "squad_v2": (
        "Context: {a}\nQuestion: {b}\n"
        'If the question is unanswerable from the context, reply "unanswerable".\nAnswer:'
    ),
    "gsm8k": "Question: {a}\n\nAnswer:",
    "sst2_few_shot": (
        "Is this review positive or negative?\n\n"
        'Review: "I love this movie, it\'s fantastic!"\nAnswer: positive\n\n'
        'Review: "This was terrible and boring."\nAnswer: negative\n\n'
        'Review: "A wonderful experience from start to finish."\nAnswer: positive\n\n'
        'Review: "{a}"\nAnswer:'
    ),
}
FEW_SHOT_HEADER = "The following are multiple choice questions (with answers) about {subject}.\n\n"


def task_prompt(task: str, **fields: Column) -> Column:
    if task == "sst2":
        fields = {**fields, "a": strip(fields["a"])}
    return layout(TEMPLATES[task], **fields)


def prompt_by_task(task: Column, **fields: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for name in TEMPLATES:
        chosen = F.when(task == name, task_prompt(name, **fields)).otherwise(chosen)
    return chosen


def lettered(choices: Column) -> Column:
    """One line per choice, with a letter in front; more choices than letters are an error."""
    fitting = F.when(
        F.size(choices) > len(LETTERS), F.raise_error(F.lit("more choices than letters"))
    ).otherwise(choices)
    lines = F.transform(
        fitting,
        lambda c, i: F.concat(F.lit("\n"), F.char(i.cast("long") + 65), F.lit(". "), c),
    )
    return F.array_join(lines, "")


def choice_prompt(question: Column, choices: Column, lead: str = "Question: ") -> Column:
    return F.concat(F.lit(lead), question, lettered(choices), F.lit("\nAnswer:"))


def solved_choice(question: Column, choices: Column, gold: Column) -> Column:
    return F.concat(
        choice_prompt(strip(question), choices, ""),
        F.lit(" "),
        F.char(gold.cast("long") + 65),
        F.lit("\n\n"),
    )


def few_shot_prompt(subject: Column, shots: Column, question: Column, choices: Column) -> Column:
    return F.concat(
        layout(FEW_SHOT_HEADER, subject=F.replace(subject, F.lit("_"), F.lit(" "))),
        F.coalesce(shots, F.lit("")),
        choice_prompt(strip(question), choices, ""),
    )


def seeded_choices(question: Column, choices: Column) -> Column:
    """Choices in an order fixed by the question, and where the first one went."""
    keyed = F.array_sort(
        F.transform(
            choices,
            lambda c, i: F.struct(
                F.md5(F.concat_ws(":", i.cast("string"), question).cast("binary")).alias("k"),
                i.alias("i"),
                c.alias("c"),
            ),
        )
    )
    return F.struct(
        F.transform(keyed, lambda s: s["c"]).alias("choices"),
        (F.array_position(F.transform(keyed, lambda s: s["i"]), F.lit(0)) - 1).alias("gold"),
    )


def gold_index(letter: Column, choices: Column, answer: Column) -> Column:
    """0-based gold choice: by letter when it is one, else by trimmed text, else -1."""
    given = F.upper(strip(F.coalesce(letter, F.lit(""))))
    by_text = F.coalesce(F.array_position(choices, strip(answer)), F.lit(0)) - 1
    return F.when(given.rlike("^[A-Z]$"), (F.ascii(given) - 65).cast("long")).otherwise(by_text)


def with_none(*fields: Column) -> Column:
    """Fields on lines of their own; a missing one shows as None."""
    return F.concat_ws("\n", *[F.coalesce(f.cast("string"), F.lit("None")) for f in fields])
