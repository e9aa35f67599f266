"""Suffix-stripping stems of English words, as columns over arrays of words.

The rules are Porter's (1980) with the common later additions: irregular forms, `-ied` and
four-letter `-ies`, `-fulli`, `-logi`, and two-letter stems that keep an `e`. Words are lower
case letters and digits; words of up to three characters stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rules. A suffix of a group is tried before those it ends in.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
ADJECTIVAL = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
LONG_STEM = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
)

# Consonant and vowel runs; y is a consonant at the start and after a vowel.
_CONSONANTS, _VOWELS = "[^aeiou][^aeiouy]*+", "[aeiouy][aeiou]*+"
_VOWEL = f"^(?:{_CONSONANTS})?+[aeiouy]"
_SOME = f"^(?:{_CONSONANTS})?+{_VOWELS}{_CONSONANTS}"
_ONE = f"{_SOME}(?:{_VOWELS})?+$"
_TWO = f"{_SOME}{_VOWELS}{_CONSONANTS}"
_CONSONANT = "(?:[^aeiouy](?:yy)*|(?:^|[aeiou])y(?:yy)*)"
_SHORT = f"{_CONSONANT}[aeiouy][^aeiouwxy]$|^[aeiou][^aeiou]$"
_DOUBLED = r"([^aeiouylsz])\1$|(?:[^aeiouy]|(?:^|[aeiou])y)(?:yy)+$"


def _less(word: Column, cut: Column | int) -> Column:
    """The word without its last ``cut`` characters."""
    return F.substring(word, F.lit(1), F.length(word) - cut)


def _ending(word: Column, suffixes) -> Column:
    return F.regexp_extract(word, f"(?:{'|'.join(sorted(suffixes, key=len, reverse=True))})$", 0)


def _ends_in(word: Column, letters) -> Column:
    """Whether the last letter is one of some: spares most words the patterns of a step."""
    return F.substring(word, -1, 1).isin(sorted(letters))


def _plural(w: Column) -> Column:
    return (
        F.when(~w.endswith("s"), w)
        .when(w.rlike("sses$|..ies$"), _less(w, 2))
        .when(w.rlike("[^s]s$"), _less(w, 1))
        .otherwise(w)
    )


def _past(w: Column) -> Column:
    """The word without -ed or -ing, and whether such an ending went."""
    bare = F.regexp_replace(w, "(?:ed|ing)$", "")
    keep = lambda c: F.struct(c.alias("w"), F.lit(False).alias("cut"))
    return (
        F.when(~_ends_in(w, "dg"), keep(w))
        .when(w.endswith("ied"), keep(F.when(F.length(w) == 4, _less(w, 1)).otherwise(_less(w, 2))))
        .when(w.endswith("eed"), keep(F.when(_less(w, 3).rlike(_SOME), _less(w, 1)).otherwise(w)))
        .when(w.rlike("(?:ed|ing)$") & bare.rlike(_VOWEL), F.struct(bare.alias("w"), F.lit(True).alias("cut")))
        .otherwise(keep(w))
    )


def _mended(past: Column) -> Column:
    w = past["w"]
    return (
        F.when(~past["cut"], w)
        .when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e")))
        .when(w.rlike(_DOUBLED), _less(w, 1))
        .when(w.rlike(r"([lsz])\1$"), w)
        .when(w.rlike(_ONE) & w.rlike(_SHORT), F.concat(w, F.lit("e")))
        .otherwise(w)
    )


def _last_y(w: Column) -> Column:
    turned = F.regexp_replace(w, "^(?=.{3})(.*[^aeiouy](?:yy)*|(?:.*[aeiou])?y(?:yy)*)y$", "$1i")
    return F.when(w.endswith("y"), turned).otherwise(w)


def _adverb(w: Column) -> Column:
    return F.when(w.endswith("alli") & _less(w, 4).rlike(_SOME), _less(w, 2)).otherwise(w)


def _replaced(w: Column, rules: dict[str, str]) -> Column:
    """Replace a suffix where a vowel and a consonant come before it."""
    forms = F.create_map(*[F.lit(x) for rule in rules.items() for x in rule])
    suffix = _ending(w, rules)
    bare = _less(w, F.length(suffix))
    fits = _ends_in(w, {rule[-1] for rule in rules}) & (suffix != "") & bare.rlike(_SOME)
    return F.when(fits, F.concat(bare, F.element_at(forms, suffix))).otherwise(w)


def _derived(w: Column) -> Column:
    logic = F.when(_less(w, 3).rlike(_SOME), _less(w, 1)).otherwise(w)
    return F.when(w.endswith("logi"), logic).otherwise(_replaced(w, DERIVED))


def _stripped(w: Column) -> Column:
    suffix = _ending(w, [*LONG_STEM, "(?<=[st])ion"])
    bare = _less(w, F.length(suffix))
    fits = _ends_in(w, {rule[-1] for rule in LONG_STEM} | {"n"}) & (suffix != "")
    return F.when(fits & bare.rlike(_TWO), bare).otherwise(w)


def _last_e(w: Column) -> Column:
    bare = _less(w, 1)
    gone = bare.rlike(_TWO) | (bare.rlike(_ONE) & ~bare.rlike(_SHORT))
    return F.when(w.endswith("e") & gone, bare).otherwise(w)


def _last_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & _less(w, 1).rlike(_TWO), _less(w, 1)).otherwise(w)


STEPS = (
    _plural, _past, _mended, _last_y, _adverb, _derived, lambda w: _replaced(w, ADJECTIVAL),
    _stripped, _last_e, _last_l,
)


def stems(words: Column) -> Column:
    """The stem of each word of an array; every step is a transform of its own.

    A null array gives null, a null word stays null.
    """
    known = F.create_map(*[F.lit(x) for form in IRREGULAR.items() for x in form])
    found = words
    for step in STEPS:
        found = F.transform(found, step)
    return F.zip_with(
        words,
        found,
        lambda w, s: F.when(F.length(w) > 3, F.coalesce(F.element_at(known, w), s)).otherwise(w),
    )
