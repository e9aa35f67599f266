"""Checking SQL for stems: words are spelt as consonants and vowels first, then cut step by step."""

from __future__ import annotations

from tallyloom.functions.stems import ADJECTIVAL, DERIVED, IRREGULAR, LONG_STEM


def _shape(word: str) -> str:
    """A word as c and v; y takes the other kind of the letter before it, c at the start."""
    made = f"regexp_replace(regexp_replace({word}, '[^aeiouy]', 'c', 'g'), '[aeiou]', 'v', 'g')"
    made = f"regexp_replace({made}, '^y', 'c')"
    for _ in range(3):
        made = f"replace(replace({made}, 'vy', 'vc'), 'cy', 'cv')"
    return made


def _less(n: int) -> str:
    return f"substr(w, 1, greatest(length(w) - {n}, 0))"


def _has(word: str, pattern: str) -> str:
    return f"regexp_matches({_shape(word)}, '{pattern}')"


SOME, TWO, ONE = "^c*v+c", "^c*v+c+v+c", "^c*v+c+v*$"


def _short(word: str) -> str:
    return f"(({_has(word, 'cvc$')} AND NOT regexp_matches({word}, '[wxy]$')) OR {_has(word, '^vc$')})"


def _rules(rules: dict[str, str], pattern: str) -> str:
    cases = [
        f"WHEN w LIKE '%{suffix}' THEN CASE WHEN {_has(_less(len(suffix)), pattern)} THEN {_less(len(suffix))} || '{new}' ELSE w END"
        for suffix, new in rules.items()
    ]
    return f"CASE {' '.join(cases)} ELSE w END"


def _last(extra: dict[str, str]) -> dict[str, str]:
    return dict(sorted(extra.items(), key=lambda rule: -len(rule[0])))


def stem_tables(words: str) -> str:
    """CTEs up to ``stems(token, stem)`` from a table of words with a column ``token``."""
    past = "regexp_replace(w, '(ed|ing)$', '')"
    ion = f"WHEN w LIKE '%ion' THEN CASE WHEN regexp_matches(w, '[st]ion$') AND {_has(_less(3), TWO)} THEN {_less(3)} ELSE w END"
    long = _rules(_last({s: "" for s in LONG_STEM}), TWO).replace("CASE ", f"CASE {ion} ", 1)
    logic = f"WHEN w LIKE '%logi' THEN CASE WHEN {_has(_less(3), SOME)} THEN {_less(1)} ELSE w END"
    steps = [
        f"CASE WHEN w LIKE '%sses' OR (w LIKE '%ies' AND length(w) > 4) THEN {_less(2)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {_less(1)} ELSE w END AS w",
        f"""CASE WHEN w LIKE '%ied' THEN CASE length(w) WHEN 4 THEN 'K' || {_less(1)} ELSE 'K' || {_less(2)} END
          WHEN w LIKE '%eed' THEN 'K' || CASE WHEN {_has(_less(3), SOME)} THEN {_less(1)} ELSE w END
          WHEN regexp_matches(w, '(ed|ing)$') AND {_shape(past)} LIKE '%v%' THEN {past} ELSE 'K' || w END AS w""",
        f"""CASE WHEN w LIKE 'K%' THEN substr(w, 2) WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
          WHEN length(w) > 1 AND w[-1] = w[-2] AND {_shape("w")} LIKE '%c' THEN CASE WHEN w[-1] IN ('l', 's', 'z') THEN w ELSE {_less(1)} END
          WHEN {_has("w", ONE)} AND {_short("w")} THEN w || 'e' ELSE w END AS w""",
        f"CASE WHEN w LIKE '%y' AND length(w) > 2 AND {_shape(_less(1))} LIKE '%c' THEN {_less(1)} || 'i' ELSE w END AS w",
        f"CASE WHEN w LIKE '%alli' AND {_has(_less(4), SOME)} THEN {_less(2)} ELSE w END AS w",
        _rules(_last(DERIVED), SOME).replace("CASE ", f"CASE {logic} ", 1) + " AS w",
        _rules(_last(ADJECTIVAL), SOME) + " AS w",
        f"{long} AS w",
        f"CASE WHEN w LIKE '%e' AND ({_has(_less(1), TWO)} OR ({_has(_less(1), ONE)} AND NOT {_short(_less(1))})) THEN {_less(1)} ELSE w END AS w",
        f"CASE WHEN w LIKE '%ll' AND {_has(_less(1), TWO)} THEN {_less(1)} ELSE w END AS w",
    ]
    made = [f"stem0 AS (SELECT DISTINCT token, token AS w FROM {words})"]
    made += [f"stem{i + 1} AS (SELECT token, {step} FROM stem{i})" for i, step in enumerate(steps)]
    fixed = " ".join(f"WHEN '{word}' THEN '{form}'" for word, form in IRREGULAR.items())
    made.append(
        f"stems AS (SELECT token, CASE WHEN length(token) < 4 THEN token ELSE coalesce(CASE token {fixed} END, w) END AS stem FROM stem{len(steps)})"
    )
    return ",\n".join(made)
