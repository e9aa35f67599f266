"""Text functions as column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Every character that counts as white space in Unicode text.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Fixed patterns of the two number extractors.
FINAL_MARK_LOOSE = r"####\s*([\d,.-]+)"
ANSWER_IS_LOOSE = r"(?i)answer is\s*([\d,.-]+)"
ANY_NUMBER_LOOSE = r"[\d,]+\.?\d*"
GROUPED_NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
FINAL_MARK_STRICT = rf"####\s*({GROUPED_NUMBER})"
ANSWER_IS_STRICT = rf"(?i)answer\s+is\s+({GROUPED_NUMBER})"
EQUALS_AT_END = rf"=\s*({GROUPED_NUMBER})\s*$"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def right_strip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def filled(text: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(text, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[filled(c) for c in columns])


def first_present(*columns: Column) -> Column:
    """First value that is not null; an empty string counts as present."""
    return F.coalesce(*columns)


def capitalised(text: Column) -> Column:
    return F.concat(
        F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2)))
    )


def without_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def qa_normalised(text: Column) -> Column:
    """Lower case, no articles, no punctuation, single spaces."""
    spaced = F.regexp_replace(F.lower(text), r"(?U)\b(a|an|the)\b", " ")
    return strip(F.regexp_replace(without_punctuation(spaced), r"(?U)\s+", " "))


def qa_tokens(text: Column) -> Column:
    normal = qa_normalised(text)
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(
        F.split(normal, " ")
    )


def exam_normalised(text: Column) -> Column:
    """Spaces are collapsed before punctuation goes, so double spaces may remain."""
    single = F.regexp_replace(strip(F.lower(text)), r"(?U)\s+", " ")
    return strip(without_punctuation(single))


def _found(text: Column, pattern: str) -> Column:
    return filled(F.regexp_extract(text, pattern, 1))


def number_answer_loose(text: Column) -> Column:
    """Marked answer, else "answer is", else the last number; null when none.

    The marked forms keep trailing points and signs.
    """
    numbers = F.regexp_extract_all(text, F.lit(ANY_NUMBER_LOOSE), F.lit(0))
    chosen = F.coalesce(
        _found(text, FINAL_MARK_LOOSE),
        _found(text, ANSWER_IS_LOOSE),
        F.try_element_at(numbers, F.lit(-1)),
    )
    return F.replace(chosen, F.lit(","), F.lit(""))


def number_answer_strict(text: Column) -> Column:
    """Like the loose form for signed grouped numbers, with "= x" at the end; '' when none."""
    numbers = F.regexp_extract_all(text, F.lit(GROUPED_NUMBER), F.lit(0))
    chosen = F.coalesce(
        _found(text, FINAL_MARK_STRICT),
        _found(text, ANSWER_IS_STRICT),
        _found(text, EQUALS_AT_END),
        F.try_element_at(numbers, F.lit(-1)),
        F.lit(""),
    )
    return F.replace(chosen, F.lit(","), F.lit(""))


def plain_number(text: Column) -> Column:
    return F.coalesce(strip(F.replace(text, F.lit(","), F.lit(""))), F.lit(""))


def gold_answer(text: Column) -> Column:
    """Text after the last ####, else the last word."""
    last_word = F.try_element_at(F.split(strip(text), r"(?U)\s+"), F.lit(-1))
    return F.when(
        F.contains(text, F.lit("####")), strip(F.substring_index(text, "####", -1))
    ).otherwise(last_word)


def verifier_text(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nAnswer: "), answer)


def verifier_inline_text(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit(" Answer: "), answer)


def cut_at_stops(text: Column, stops: Sequence[str]) -> Column:
    """Text before the first occurrence of any stop string."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return text


def cleaned_context(text: Column) -> Column:
    titled = F.replace(strip(text), F.lit(" [title]"), F.lit(". "))
    bare = F.regexp_replace(titled, r"\[[^\n]*?\]", "")
    return F.replace(bare, F.lit("  "), F.lit(" "))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def without_unanswerable(prediction: Column) -> Column:
    low = F.lower(strip(prediction))
    none_given = low.isin("unanswerable", "no answer", "none") | F.contains(
        low, F.lit("unanswerable")
    )
    return F.when(none_given, F.lit("")).otherwise(strip(prediction))


def json_or_null(text: Column) -> Column:
    """Parsed JSON, null unless the whole text is exactly one value.

    The parser stops after the first value, so the text is also tried as the only
    element of a list and as the only field of an object: no trailing text fits both.
    """
    as_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.size(F.try_variant_get(as_list, "$", "array<variant>")) == 1
    return F.when(alone & as_field.isNotNull(), F.try_parse_json(text))


@F.pandas_udf(StringType())
def plain_json(texts: pd.Series) -> pd.Series:
    """JSON with repeated keys (the last one counts) or NaN (null) in plain form; else null."""

    def plain(text):
        try:
            return None if text is None else json.dumps(json.loads(text, parse_constant=lambda name: None))
        except (ValueError, RecursionError):
            return None

    return texts.map(plain)


def lenient_json(text: Column) -> Column:
    """The text itself where Spark takes it as one JSON value, else its plain form or null."""
    known = json_or_null(text).isNotNull()
    likely = text.rlike(r'^\s*[\[{"0-9NIt\-fn]')
    return F.when(known, text).otherwise(plain_json(F.when(~known & likely, text)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repetition(text: Column, window: int) -> Column:
    """Share of word windows that occur again later in the text; 0 when it is shorter."""

    def share(tokens: Column) -> Column:
        spots = F.size(tokens) - (window - 1)
        grams = F.transform(
            F.sequence(F.lit(1), F.greatest(spots, F.lit(1))),
            lambda i: F.array_join(F.slice(tokens, i, window), " "),
        )
        rate = bound(grams, lambda g: (F.size(g) - F.size(F.array_distinct(g))) / F.size(g))
        return F.when(spots > 0, rate).otherwise(F.lit(0.0))

    return bound(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), share)


def composed(text: Column) -> Column:
    """Unicode NFC, by the ICU library that Spark's collations use.

    Texts are taken in the JVM, one at a time, so no batch of them is held beside it. Text without
    characters from U+0300 on is composed already and is left alone. ICU also knows the 17 characters that joined
    normalisation in Unicode 16, after Python 3.13's tables.
    """
    found = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\x00-\u02FF]"), found).otherwise(text)


def decoded(raw: Column) -> Column:
    """UTF-8 text of a binary column without its broken bytes.

    Broken bytes become the replacement character, which is then removed. Real
    replacement characters are escaped before and restored after.
    """
    mark, gone = F.lit("\uf8ff"), F.lit("\ufffd")
    mark_0, mark_1 = F.lit("\uf8ff0"), F.lit("\uf8ff1")
    text = raw.cast("string")
    escaped = F.replace(F.replace(text, mark, mark_0), gone, mark_1)
    cleaned = F.replace(F.make_valid_utf8(escaped), gone, F.lit(""))
    restored = F.replace(F.replace(cleaned, mark_1, gone), mark_0, mark)
    return F.when(F.is_valid_utf8(text), text).otherwise(restored)
