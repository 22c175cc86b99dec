"""Broken generation in transcripts: immediate repetition, and endings that were lost."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

_WORD = re.compile(r"\w+")
LONGEST_GROUP, TAIL = 8, 8


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def max_repeat(tokens: list[str]) -> tuple[int, int]:
    """(repeats, words of the group) of the most often repeated group; (1, 0) without one.

    A single word counts from four times on, a longer group from three.
    """
    codes: dict[str, int] = {}
    ids = np.array([codes.setdefault(t, len(codes)) for t in tokens], dtype=np.int64)
    best = 1, 0
    for size in range(1, min(LONGEST_GROUP, len(ids) // 2) + 1):
        same = np.r_[False, ids[:-size] == ids[size:], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        longest = int((edges[1::2] - edges[::2]).max(initial=0))
        repeats = 1 + longest // size
        if repeats >= (4 if size == 1 else 3) and repeats > best[0]:
            best = repeats, size
    return best


def has_loop(text: str, reference: str) -> bool:
    """Whether the text repeats a group more often than the reference does."""
    repeats, size = max_repeat(words(text))
    return size > 0 and repeats > max_repeat(words(reference))[0]


def ending_missing(text: str, reference: str, tail: int = TAIL) -> bool:
    """Whether fewer than half of the reference's last words stand among the text's last ones."""
    wanted = Counter(words(reference)[-tail:])
    return 2 * (wanted & Counter(words(text)[-2 * tail :])).total() < wanted.total()
