"""Words for scoring, their alignment, and word and character error rates."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import regex

from sonoframe.text.numbers import fold_numbers, unify_units

_APOSTROPHES = str.maketrans("’‘`", "'''")
_DROPPED = regex.compile(r"(?:(?![\p{Alphabetic}\p{N}%'.,]).)|(?<![0-9])[.,]|[.,](?![0-9])", regex.DOTALL)
#: Where letters, digits and percent signs meet something else of a word.
_SEAMS = regex.compile(r"(?<=[0-9])(?=[^0-9.,' ])|(?<=%)(?=[^%' ])|(?<=\p{Alphabetic})(?=[^\p{Alphabetic}' ])")
_SIMPLE = regex.compile(r"[\w']+")


def normalize_words(text: str) -> list[str]:
    """The words that are scored: lower case, without punctuation, numbers and units in one spelling."""
    lowered = "".join(map(str.lower, _SEAMS.sub(" ", _DROPPED.sub(" ", text.translate(_APOSTROPHES)))))
    words = (w.strip("'") for w in lowered.split())
    return unify_units(fold_numbers([w for w in words if w]))


def simple_words(text: str) -> list[str]:
    """Words of the simple error rate: composed characters, lower case, runs of word characters and apostrophes."""
    return _SIMPLE.findall(unicodedata.normalize("NFC", text.replace("’", "'")).lower())


def levenshtein(a, b) -> int:
    """Edit distance of two sequences: one column of the table at a time, as the bits of two whole numbers."""
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    end = min(len(a), len(b))
    cut = 0
    while cut < end and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    if cut:
        a, b = a[:-cut], b[:-cut]
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, distance = every, 0, len(a)
    for y in b:
        here = places.get(y, 0)
        diagonal = (((here & rises) + rises) ^ rises) | here | falls
        up = (falls | ~(diagonal | rises)) & every
        down = diagonal & rises
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, (down << 1) & every
        rises, falls = (down | ~(diagonal | up)) & every, up & diagonal
    return distance


@dataclass(frozen=True)
class Step:
    kind: str  # equal, substitute, delete, insert
    reference: str | None
    hypothesis: str | None


def _costs(a: list[str], b: list[str]):
    """The table of edit distances of all beginnings."""
    ramp = np.arange(len(b) + 1, dtype=np.int32)
    if len(a) * len(b) <= 3000:
        rows = [ramp.tolist()]
        for i, x in enumerate(a, 1):
            above, left, row = rows[-1], i, [i]
            for j, y in enumerate(b):
                left = min(above[j] + (x != y), above[j + 1] + 1, left + 1)
                row.append(left)
            rows.append(row)
        return rows
    cost = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    codes: dict[str, int] = {}
    y = np.array([codes.setdefault(w, len(codes)) for w in b], dtype=np.int64)
    cost[0] = ramp
    for i, x in enumerate(a, 1):
        reached = np.empty(len(b) + 1, dtype=np.int32)
        reached[0] = i
        np.minimum(cost[i - 1, :-1] + (y != codes.get(x, -1)), cost[i - 1, 1:] + 1, out=reached[1:])
        # an insertion costs one a place: the least of what lies to the left, less its distance
        cost[i] = np.minimum.accumulate(reached - ramp) + ramp
    return cost


def align(reference: list[str], hypothesis: list[str]) -> list[Step]:
    """A shortest alignment. Of several, from the end on, a substitution goes before a deletion before an insertion."""
    n, m = len(reference), len(hypothesis)
    steps: list[Step] = []
    while n and m and reference[n - 1] == hypothesis[m - 1]:  # equal ends are always aligned with each other
        n, m = n - 1, m - 1
        steps.append(Step("equal", reference[n], hypothesis[m]))
    cost = _costs(reference[:n], hypothesis[:m])
    i, j = n, m
    while i or j:
        here = cost[i][j]
        if i and j and here == cost[i - 1][j - 1] + (reference[i - 1] != hypothesis[j - 1]):
            i, j = i - 1, j - 1
            steps.append(Step("equal" if reference[i] == hypothesis[j] else "substitute", reference[i], hypothesis[j]))
        elif i and here == cost[i - 1][j] + 1:
            i -= 1
            steps.append(Step("delete", reference[i], None))
        else:
            j -= 1
            steps.append(Step("insert", None, hypothesis[j]))
    return steps[::-1]


def compare_texts(reference: str, hypothesis: str) -> dict:
    """Rates (null for an empty reference), counts, alignment and both normalised texts."""
    r, h = normalize_words(reference), normalize_words(hypothesis)
    steps = align(r, h)
    counts = {kind: sum(s.kind == kind for s in steps) for kind in ("substitute", "delete", "insert")}
    a, b = " ".join(r), " ".join(h)
    return {
        "wer": sum(counts.values()) / len(r) if r else None,
        "cer": levenshtein(a, b) / len(a) if a else None,
        "reference_words": len(r),
        "hypothesis_words": len(h),
        "substitutions": counts["substitute"],
        "deletions": counts["delete"],
        "insertions": counts["insert"],
        "diff": [vars(s) for s in steps],
        "normalized_reference": a,
        "normalized_hypothesis": b,
    }


def simple_wer(reference: str, hypothesis: str) -> float | None:
    r = simple_words(reference)
    return levenshtein(r, simple_words(hypothesis)) / len(r) if r else None


def word_statuses(reference: str, hypothesis: str) -> list[tuple[str, bool, str]]:
    """For each reference word: itself, whether it was heard, and what was heard instead."""
    steps = align(normalize_words(reference), normalize_words(hypothesis))
    return [(s.reference, s.kind == "equal", s.hypothesis or "(missing)") for s in steps if s.reference is not None]
