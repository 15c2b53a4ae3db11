"""Porter's algorithm in SQL over a table of distinct words, from the rule tables of the library."""

from __future__ import annotations

from timeweave.functions.stem import STEP2, STEP3, STEP4

# consonant and vowel runs: y is a vowel after a consonant
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
HAS_VOWEL = f"^({_C})?[aeiouy]"
OVER_0 = f"^({_C})?{_V}{_C}"
ONE = f"^({_C})?{_V}{_C}({_V})?$"
OVER_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"


def _is(text: str, pattern: str) -> str:
    """Does the text match, its first y being a consonant?"""
    return f"regexp_matches(regexp_replace({text}, '^y', 'Y'), '{pattern}')"


def _less(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _rules(rules: dict[str, str], pattern: str, extra: dict[str, str] | None = None) -> str:
    cases = []
    for suffix in sorted(rules, key=len, reverse=True):
        also = f" AND {extra[suffix]}" if extra and suffix in extra else ""
        stem = _less(len(suffix))
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {_is(stem, pattern)}{also} THEN {stem} || '{rules[suffix]}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def stems(words: str) -> str:
    """CTEs that end in ``stems(t, stem)`` for the column ``t`` of the relation ``words``."""
    ion = f"right({_less(3)}, 1) IN ('s', 't')"
    steps = [
        "CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_is(_less(3), OVER_0)} THEN {_less(1)} ELSE w END "
        f"WHEN ends_with(w, 'ed') AND {_is(_less(2), HAS_VOWEL)} THEN {_less(2)} || chr(10) WHEN ends_with(w, 'ing') AND {_is(_less(3), HAS_VOWEL)} THEN {_less(3)} || chr(10) ELSE w END",
        # a line feed marks words that lost their ending
        "CASE WHEN NOT ends_with(w, chr(10)) THEN w WHEN right(rtrim(w, chr(10)), 2) IN ('at', 'bl', 'iz') THEN rtrim(w, chr(10)) || 'e' "
        "WHEN length(w) > 2 AND substr(w, length(w) - 1, 1) = substr(w, length(w) - 2, 1) AND substr(w, length(w) - 1, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') THEN left(w, length(w) - 2) "
        f"WHEN {_is('rtrim(w, chr(10))', ONE)} AND {_is('rtrim(w, chr(10))', SHORT)} THEN rtrim(w, chr(10)) || 'e' ELSE rtrim(w, chr(10)) END",
        f"CASE WHEN ends_with(w, 'y') AND {_is(_less(1), HAS_VOWEL)} THEN {_less(1)} || 'i' ELSE w END",
        _rules(STEP2, OVER_0), _rules(STEP3, OVER_0), _rules(dict.fromkeys(STEP4, ""), OVER_1, {"ion": ion}),
        f"CASE WHEN ends_with(w, 'e') AND ({_is(_less(1), OVER_1)} OR ({_is(_less(1), ONE)} AND NOT {_is(_less(1), SHORT)})) THEN {_less(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_is(_less(1), OVER_1)} THEN {_less(1)} ELSE w END",
    ]
    ctes = [f"stem0 AS (SELECT DISTINCT t, t AS w FROM {words} WHERE length(t) > 2)"]
    ctes += [f"stem{k} AS (SELECT t, {step} AS w FROM stem{k - 1})" for k, step in enumerate(steps, 1)]
    return ", ".join(ctes) + f", stems AS (SELECT t, w AS stem FROM stem{len(steps)} UNION ALL SELECT DISTINCT t, t FROM {words} WHERE length(t) <= 2)"
