"""Dictionary post-correction: near-miss words become the vocabulary term that they most likely are."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import regex

from sonoframe.text.critical import DATE_WORDS, NEGATIONS
from sonoframe.text.numbers import UNIT_OF
from sonoframe.text.scoring import levenshtein

#: Letters that count as another without its accent, and ligatures.
_FOLDED = str.maketrans(
    {c: plain for plain, accented in {"a": "àâäáã", "e": "éèêë", "i": "îïí", "o": "ôöóõ", "u": "ùûüú", "c": "ç", "y": "ÿ", "oe": "œ", "ae": "æ"}.items() for c in accented}
)
_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")
_JOINING = re.compile("[ \\-'’\u00a0]+")


@dataclass(frozen=True)
class Preset:
    """Shortest length, edits per letter of the term, most edits, and whether first letters must agree."""

    min_len: int
    ratio: float
    max_distance: int
    same_first_letter: bool

    def allowed(self, length: int) -> int:
        return min(int(length * self.ratio), self.max_distance)


#: The three presets.
PRESETS = {"strict": Preset(6, 0.17, 2, True), "medium": Preset(5, 0.22, 2, True), "loose": Preset(4, 0.3, 3, False)}


def parse_vocabulary(text: str) -> list[str]:
    """Terms, one a line; blank lines and comments are left out, of spellings that differ in case the first stays."""
    terms: dict[str, str] = {}
    for line in text.splitlines():
        term = line.strip().lstrip("\ufeff").strip()
        if term and not term.startswith("#"):
            terms.setdefault(term.lower(), term)
    return list(terms.values())


def fold(text: str) -> str:
    return text.lower().translate(_FOLDED)


def is_protected(word: str) -> bool:
    """Words with digits, negations, names of days and months, units."""
    lower = word.lower()
    return bool(re.search("[0-9]", word)) or lower in NEGATIONS or lower in DATE_WORDS or lower in UNIT_OF


def letter_bits(folded: str) -> int:
    """The letters that occur, one bit each (others than a to z share six more)."""
    bits = 0
    for c in folded:
        at = ord(c) - 97
        bits |= 1 << (at if 0 <= at < 26 else 26 + ord(c) % 6)
    return bits


def differs_only_by_plural_mark(a: str, b: str) -> bool:
    return any(long[:-1] == short and long[-1:] in ("s", "x") and long for long, short in ((a, b), (b, a)))


def with_original_case(term: str, original: str) -> str:
    return term[0].upper() + term[1:] if original[:1].isupper() and term[:1].islower() else term


class Vocabulary:
    """Terms by the number of their words and their folded length, so that only possible ones are measured."""

    def __init__(self, terms: tuple[str, ...], preset: Preset):
        self.preset = preset
        self.by_shape: dict[tuple[int, int, str], list[tuple[str, str, int]]] = defaultdict(list)
        self.surfaces: dict[str, set[str]] = defaultdict(set)
        self.exact: dict[int, set[str]] = defaultdict(set)
        for surface in terms:
            words = _WORD.findall(surface)
            folded = "".join(map(fold, words))
            if len(folded) < preset.min_len or not words or any(map(is_protected, words)):
                continue
            self.surfaces[folded].add(surface)
            for size in range(max(1, len(words) - 1), len(words) + 2):
                self.by_shape[size, len(folded), self._first(folded)].append((surface, folded, letter_bits(folded)))
                self.exact[size].add(surface.lower())
        self.sizes = sorted(self.exact)
        self.known: dict[tuple[int, str], list[tuple[int, str]]] = {}

    def _first(self, folded: str) -> str:
        return folded[0] if self.preset.same_first_letter else ""

    def near(self, size: int, folded: str) -> list[tuple[int, str]]:
        """(distance, term) of the terms that a stretch of ``size`` words may be a misspelling of; words come again and again."""
        key = size, folded
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = list(self._near(size, folded))
        return self.known[key]

    def _near(self, size: int, folded: str):
        p = self.preset
        letters = letter_bits(folded)
        for length in range(max(1, len(folded) - p.max_distance), len(folded) + p.max_distance + 1):
            most = p.allowed(length)
            if abs(length - len(folded)) > most:
                continue
            for surface, term, term_letters in self.by_shape.get((size, length, self._first(folded)), ()):
                # each letter that only one of them has takes an edit of its own side
                if (term_letters & ~letters).bit_count() > most or (letters & ~term_letters).bit_count() > most or differs_only_by_plural_mark(folded, term) or self.surfaces.get(folded, set()) - {surface}:
                    continue
                distance = levenshtein(folded, term)
                if distance <= most:
                    yield distance, surface


@lru_cache(maxsize=64)
def prepared(terms: tuple[str, ...], preset: Preset) -> Vocabulary:
    return Vocabulary(terms, preset)


def _words(text: str) -> tuple[list[tuple[int, int, str, bool]], list[bool]]:
    """Each word's place, folded form and protection, and whether what lies between it and the next joins them."""
    words = [(m.start(), m.end(), fold(m.group()), is_protected(m.group())) for m in _WORD.finditer(text)]
    return words, [_JOINING.fullmatch(text, a[1], b[0]) is not None for a, b in zip(words, words[1:])]


def stretches(text: str, longest: int, preset: Preset) -> list[tuple[int, str, str]]:
    """(words, folded, in lower case) of the stretches of up to ``longest`` words that may be a term or a misspelling of one."""
    words, joins = _words(text)
    found = {}
    for i in range(len(words)):
        folded = ""
        for size in range(1, longest + 1):
            last = i + size - 1
            if last >= len(words) or words[last][3] or size > 1 and not joins[last - 1]:
                break
            folded += words[last][2]
            if len(folded) >= preset.min_len:
                found[size, folded, text[words[i][0] : words[last][1]].lower()] = None
    return list(found)


@dataclass(frozen=True)
class Looked:
    """A vocabulary as far as one text asks for it: sizes, terms in lower case, and near terms of stretches."""

    preset: Preset
    sizes: list[int]
    exact: dict[int, set[str]]
    known: dict[tuple[int, str], list[tuple[int, str]]]

    def near(self, size: int, folded: str) -> list[tuple[int, str]]:
        return self.known.get((size, folded), [])


def correct(text: str, terms: list[str], preset: Preset = PRESETS["strict"]) -> tuple[str, list[dict]]:
    """The corrected text and its changes (from, to, distance). All between the changed stretches stays as it was."""
    return correct_by(text, prepared(tuple(terms), preset))


def correct_by(text: str, vocabulary: Vocabulary | Looked) -> tuple[str, list[dict]]:
    words, joins = _words(text)
    pieces, changes, done, i = [], [], 0, 0
    while i < len(words):
        found: list[tuple[int, int, str]] = []
        for size in vocabulary.sizes:
            last = i + size - 1
            if last >= len(words) or words[last][3] or not all(joins[i:last]) or any(w[3] for w in words[i:last]):
                continue
            folded = "".join(w[2] for w in words[i : last + 1])
            if len(folded) < vocabulary.preset.min_len:
                continue
            if text[words[i][0] : words[last][1]].lower() in vocabulary.exact.get(size, ()):
                found = []
                break
            found += [(distance, size, surface) for distance, surface in vocabulary.near(size, folded)]
        least = min((f[0] for f in found), default=None)
        best = sorted(f for f in found if f[0] == least)
        if best and len({f[2] for f in best}) == 1:
            distance, size, surface = best[0]
            start, end = words[i][0], words[i + size - 1][1]
            pieces += [text[done:start], with_original_case(surface, text[start:end])]
            changes.append({"from": text[start:end], "to": surface, "distance": distance})
            done, i = end, i + size
        else:
            i += 1
    return "".join(pieces) + text[done:], changes
