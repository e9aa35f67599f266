"""Checks of a response against one instruction, as boolean columns.

``kwargs`` is a struct column with the fields of ``KWARGS``; a check that needs an
absent value is false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import filled, lenient_json, right_strip, strip

KWARGS = (
    "struct<relation:string,num_words:int,num_sentences:int,num_paragraphs:int,"
    "num_placeholders:int,postscript_marker:string,num_bullets:int,num_highlights:int,"
    "section_spliter:string,num_sections:int,keywords:array<string>,keyword:string,"
    "frequency:int,forbidden_words:array<string>,letter:string,let_relation:string,"
    "let_frequency:int,capital_relation:string,capital_frequency:int,end_phrase:string,"
    "prompt_to_repeat:string>"
)

# The three allowed answers.
ALLOWED_ANSWERS = ("My answer is yes.", "My answer is no.", "My answer is maybe.")
# Fixed patterns.
WORD = r"[A-Za-z']+"
CAPITAL_WORD = r"(?<![A-Za-z'])(?:'+[A-Z]|[A-Z][A-Z'])[A-Z']*(?![A-Za-z'])"
PARAGRAPH_BREAK = r"(?U)\n\s*\n"
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+"
PLACEHOLDER = r"\[[^\]]+\]"
BULLET_LINE = "(?U)^\\s*(\\*|-|•)\\s+"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
HIGHLIGHT = r"\*[^*]+\*"
TITLE = r"<<[^\n]+?>>"
SEPARATOR = "******"
MARK_START = ('"', "“")
MARK_END = ('"', "”")


def quoted(text: Column) -> Column:
    """Pattern that matches the text itself."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|#&~\s-])", r"\\$1")


def _compares(count: Column, relation: Column, target: Column) -> Column:
    return (
        F.when(relation == "at least", count >= target)
        .when(relation == "less than", count < target)
        .otherwise(F.lit(False))
    )


def _non_blank(parts: Column) -> Column:
    return F.size(F.filter(parts, lambda p: strip(p) != ""))


def word_number(r: Column, k: Column) -> Column:
    return _compares(F.regexp_count(r, F.lit(WORD)), k["relation"], k["num_words"])


def sentence_number(r: Column, k: Column) -> Column:
    count = _non_blank(F.split(strip(r), SENTENCE_BREAK))
    return _compares(count, k["relation"], k["num_sentences"])


def paragraph_number(r: Column, k: Column) -> Column:
    return _non_blank(F.split(strip(r), PARAGRAPH_BREAK)) == k["num_paragraphs"]


def placeholder_number(r: Column, k: Column) -> Column:
    return F.regexp_count(r, F.lit(PLACEHOLDER)) >= k["num_placeholders"]


def postscript(r: Column, k: Column) -> Column:
    return F.contains(r, F.coalesce(k["postscript_marker"], F.lit("P.S.")))


def bullet_number(r: Column, k: Column) -> Column:
    bullets = F.filter(F.split(r, LINE_BREAK), lambda line: line.rlike(BULLET_LINE))
    return F.size(bullets) == k["num_bullets"]


def allowed_answer(r: Column, k: Column) -> Column:
    return strip(r).isin(*ALLOWED_ANSWERS)


def highlight_number(r: Column, k: Column) -> Column:
    return F.regexp_count(r, F.lit(HIGHLIGHT)) >= k["num_highlights"]


def section_number(r: Column, k: Column) -> Column:
    marker = F.coalesce(filled(k["section_spliter"]), F.lit("SECTION"))
    pattern = F.concat(F.lit("(?U)"), quoted(marker), F.lit(r"\s*\d+"))
    return F.regexp_count(r, pattern) >= k["num_sections"]


def title(r: Column, k: Column) -> Column:
    return r.rlike(TITLE)


def json_text(r: Column, k: Column) -> Column:
    return lenient_json(F.btrim(strip(r), F.lit("`"))).isNotNull()


def keywords_present(r: Column, k: Column) -> Column:
    words = F.coalesce(k["keywords"], F.array().cast("array<string>"))
    return F.forall(words, lambda w: F.contains(F.lower(r), F.lower(w)))


def _whole_word(word: Column) -> Column:
    return F.concat(F.lit(r"(?U)\b"), quoted(F.lower(word)), F.lit(r"\b"))


def keyword_frequency(r: Column, k: Column) -> Column:
    pattern = _whole_word(F.coalesce(k["keyword"], F.lit("")))
    return _compares(F.regexp_count(F.lower(r), pattern), k["relation"], k["frequency"])


def no_forbidden_word(r: Column, k: Column) -> Column:
    words = F.coalesce(k["forbidden_words"], F.array().cast("array<string>"))
    return ~F.exists(words, lambda w: F.regexp_count(F.lower(r), _whole_word(w)) > 0)


def letter_frequency(r: Column, k: Column) -> Column:
    letter = F.lower(F.coalesce(k["letter"], F.lit("")))
    low = F.lower(r)
    single = F.char_length(low) - F.char_length(F.replace(low, letter, F.lit("")))
    count = F.when(F.char_length(letter) == 1, single).otherwise(0)
    return _compares(
        count,
        F.coalesce(filled(k["let_relation"]), k["relation"]),
        F.coalesce(F.nullif(k["let_frequency"], F.lit(0)), k["frequency"]),
    )


def capital_word_frequency(r: Column, k: Column) -> Column:
    return _compares(
        F.regexp_count(r, F.lit(CAPITAL_WORD)),
        F.coalesce(filled(k["capital_relation"]), k["relation"]),
        F.coalesce(F.nullif(k["capital_frequency"], F.lit(0)), k["frequency"]),
    )


def all_capitals(r: Column, k: Column) -> Column:
    return r.rlike(r"\p{L}") & ~r.rlike(r"[\p{L}&&[^\p{Lu}]]")


def all_lower(r: Column, k: Column) -> Column:
    return r.rlike(r"\p{L}") & ~r.rlike(r"[\p{L}&&[^\p{Ll}]]")


def no_comma(r: Column, k: Column) -> Column:
    return ~F.contains(r, F.lit(","))


def in_quotes(r: Column, k: Column) -> Column:
    text = strip(r)
    return (
        (F.char_length(text) >= 2)
        & F.left(text, F.lit(1)).isin(*MARK_START)
        & F.right(text, F.lit(1)).isin(*MARK_END)
    )


def ends_with_phrase(r: Column, k: Column) -> Column:
    return F.endswith(right_strip(r), k["end_phrase"])


def two_responses(r: Column, k: Column) -> Column:
    return F.contains(r, F.lit(SEPARATOR))


def repeats_prompt(r: Column, k: Column) -> Column:
    return F.contains(r, k["prompt_to_repeat"])


Check = Callable[[Column, Column], Column]

# The instruction ids.
CHECKS: dict[str, Check] = {
    "length_constraints:number_words": word_number,
    "length_constraints:number_sentences": sentence_number,
    "length_constraints:number_paragraphs": paragraph_number,
    "detectable_content:number_placeholders": placeholder_number,
    "detectable_content:postscript": postscript,
    "detectable_format:number_bullet_lists": bullet_number,
    "detectable_format:constrained_response": allowed_answer,
    "detectable_format:number_highlighted_sections": highlight_number,
    "detectable_format:multiple_sections": section_number,
    "detectable_format:title": title,
    "detectable_format:json_format": json_text,
    "keywords:existence": keywords_present,
    "keywords:frequency": keyword_frequency,
    "keywords:forbidden_words": no_forbidden_word,
    "keywords:letter_frequency": letter_frequency,
    "change_case:capital_word_frequency": capital_word_frequency,
    "change_case:english_capital": all_capitals,
    "change_case:english_lowercase": all_lower,
    "punctuation:no_comma": no_comma,
    "startend:quotation": in_quotes,
    "startend:end_checker": ends_with_phrase,
    "combination:two_responses": two_responses,
    "combination:repeat_prompt": repeats_prompt,
}


#: The one check that needs Python, which a caller may run ahead of its rows.
JSON_CHECK = "detectable_format:json_format"


def check(
    instruction_id: Column, response: Column, kwargs: Column, found_json: Column | None = None
) -> Column:
    """Did the response follow the instruction? Null for an unknown instruction, and only then.

    ``found_json`` is the outcome of ``json_text`` where that is known already.
    """
    found = F.lit(None).cast("boolean")
    for name, rule in CHECKS.items():
        ahead = found_json is not None and name == JSON_CHECK
        found = F.when(instruction_id == name, found_json if ahead else rule(response, kwargs)).otherwise(found)
    return F.when(instruction_id.isin(*CHECKS), F.coalesce(found, F.lit(False)))
