"""Spoken numbers, numeric tokens and units brought to one spelling, French and English."""

from __future__ import annotations

import re
from itertools import groupby

#: Number words.
FRENCH = {
    "zéro": 0, "zero": 0, "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9,
    "dix": 10, "onze": 11, "douze": 12, "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16, "vingt": 20, "vingts": 20,
    "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60,
}
ENGLISH = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
#: Units, each with its spellings.
UNITS = {
    "mg": "mg milligramme milligrammes milligram milligrams",
    "g": "g gramme grammes gram grams",
    "kg": "kg kilo kilos kilogramme kilogrammes kilogram kilograms",
    "µg": "µg ug mcg microgramme microgrammes microgram micrograms",
    "ml": "ml millilitre millilitres milliliter milliliters",
    "cl": "cl centilitre centilitres",
    "l": "l litre litres liter liters",
    "%": "%",
    "h": "h heure heures hour hours",
    "mmhg": "mmhg",
    "cm": "cm centimètre centimètres centimeter centimeters",
    "mm": "mm millimètre millimètres millimeter millimeters",
    "m": "m mètre mètres meter meters",
}
UNIT_OF = {spelling: unit for unit, spellings in UNITS.items() for spelling in spellings.split()}
#: Words that alone stay words.
ARTICLES = {"un", "une", "one"}

_NUMERIC = re.compile(r"[0-9]+(?:[.,][0-9]+)*")
_DIGITS = re.compile(r"[0-9]+")


class _Speech:
    """A language's number words, and what may follow a part below a hundred."""

    def __init__(self, values: dict[str, int], hundreds: set[str], thousand: str, link: str, after: dict[int, range]):
        self.values, self.hundreds, self.thousand, self.link, self.after = values, hundreds, thousand, link, after

    def knows(self, word: str) -> bool:
        return word in self.values or word in self.hundreds or word == self.thousand

    def step(self, state: tuple[int, int] | None, word: str) -> tuple[int, int] | None:
        """State (thousands, below a thousand) after one more word; None if the word can't continue the number."""
        thousands, below = state or (0, 0)
        if word == self.thousand:
            free = not thousands and (below or state is None)
            return ((below or 1) * 1000, 0) if free else None
        if word in self.hundreds:
            if state is None:
                return 0, 100
            return (thousands, below * 100) if 1 <= below <= 9 else None
        value = self.values.get(word)
        if value is None or value == 0:
            return (0, 0) if value == 0 and state is None else None
        rest = below % 100
        if rest == 0:
            return thousands, below + value
        if below == 4 and value == 20 and "quatre" in self.values:
            return thousands, 80
        return (thousands, below + value) if value in self.after.get(rest, ()) else None


_TENS = {t: range(1, 10) for t in range(20, 100, 10)}
_SPEECH = (
    _Speech(FRENCH, {"cent", "cents"}, "mille", "et", {**_TENS, 10: range(7, 10), 60: range(1, 20), 80: range(1, 20)}),
    _Speech(ENGLISH, {"hundred"}, "thousand", "and", _TENS),
)


def unify_percent(tokens: list[str]) -> list[str]:
    out: list[str] = []
    for t in tokens:
        if t == "cent" and out and out[-1] in ("pour", "per"):
            out[-1] = "%"
        else:
            out.append("%" if t in ("pourcent", "percent") else t)
    return out


def fold_spoken(tokens: list[str]) -> list[str]:
    """Spoken numbers as digits. The language is that of the first word, French before English."""
    out, i = [], 0
    while i < len(tokens):
        speech = next((s for s in _SPEECH if s.knows(tokens[i])), None)
        if speech is None:
            out.append(tokens[i])
            i += 1
            continue
        state, said, j = speech.step(None, tokens[i]), 1, i + 1
        while j < len(tokens):
            skip = 0
            following = speech.step(state, tokens[j])
            if following is None and tokens[j] == speech.link and j + 1 < len(tokens):
                skip, following = 1, speech.step(state, tokens[j + 1])
            if following is None:
                break
            state, said, j = following, said + 1, j + 1 + skip
        out.append(tokens[i] if said == 1 and tokens[i] in ARTICLES else str(sum(state)))
        i = j
    return out


def merge_spoken_decimals(tokens: list[str]) -> list[str]:
    """"2 virgule 5" and "2 point 5" as "2.5", from left to right."""
    out, rest = [], iter(range(len(tokens)))
    for i in rest:
        if tokens[i] in ("virgule", "point") and out and is_digits(out[-1]) and i + 1 < len(tokens) and is_digits(tokens[i + 1]):
            out[-1] += "." + tokens[next(rest)]
        else:
            out.append(tokens[i])
    return out


def is_digits(token: str) -> bool:
    return _DIGITS.fullmatch(token) is not None


def is_numeric_token(token: str) -> bool:
    """Digits, with single separators between them."""
    return _NUMERIC.fullmatch(token) is not None


def canonical_number_token(token: str) -> str:
    """Thousands joined, a point for decimals, no leading zeros; other tokens as they are."""
    if not is_numeric_token(token):
        return token
    head, *groups = re.split("[.,]", token)
    grouped = groups and len(head) <= 3 and head[0] != "0" and all(len(g) == 3 for g in groups) and (len(groups) > 1 or len(head) > 1)
    if len(groups) == 1 and not grouped:
        return f"{head.lstrip('0') or '0'}.{groups[0]}"
    return (head + "".join(groups)).lstrip("0") or "0"


def join_adjacent_digits(tokens: list[str]) -> list[str]:
    out: list[str] = []
    for digits, run in groupby(tokens, is_digits):
        out += ["".join(run)] if digits else run
    return out


def fold_numbers(tokens: list[str]) -> list[str]:
    folded = merge_spoken_decimals(fold_spoken(unify_percent(tokens)))
    return join_adjacent_digits([canonical_number_token(t) for t in folded])


def canonical_unit(token: str) -> str | None:
    return UNIT_OF.get(token)


def unify_units(tokens: list[str]) -> list[str]:
    return [UNIT_OF.get(t, t) for t in tokens]
