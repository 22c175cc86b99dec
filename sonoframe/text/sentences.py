"""Sentences of a text with their places, by punctuation, abbreviations and line breaks."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Abbreviations whose dot ends no sentence, and those whose dot ends one before a capital letter.
ABBREVIATIONS = frozenset(
    "m mm mme mmes mlle mlles dr dre drs pr pre prof me st ste sts mr mrs ms jr sr vs cf env approx e.g i.e c.-à-d fig réf ref ex p pp tel tél "
    "av bd dept inc ltd n no janv févr fevr avr juil sept oct nov déc dec jan feb mar apr aug sep".split()
)
ENDING_ABBREVIATIONS = frozenset({"etc", "al"})
#: Punctuation that closes and opens.
_OPENERS = "\"'«“‘([{—–-¿¡"
_STOP = re.compile(r"\s+|[.!?…]+")
_CLOSING = re.compile(r"(?:[\"'»”’)\]}]|[^\S\n]+»)*")
_NEXT = re.compile(r"[\s" + re.escape(_OPENERS) + "]*")
_LINE_GAP = re.compile(r"\s*")
_BLANK_BEFORE = re.compile(r"[\s" + re.escape(_OPENERS) + "]*")


@dataclass
class Sentence:
    """Start and end count UTF-16 code units, as text views do."""

    text: str
    start: int
    end: int
    paragraph_end: bool


def _next_visible(text: str, at: int) -> str:
    at = _NEXT.match(text, at).end()
    return text[at : at + 1]


def _dot_goes_on(text: str, start: int, dot: int) -> bool:
    """Whether a single dot belongs to an abbreviation, an initial or a list number."""
    token = re.search(r"\S*$", text[max(start, dot - 64) : dot]).group()
    bare = token.lstrip(_OPENERS)
    if not bare:
        return False
    if bare.lower() in ABBREVIATIONS:
        return True
    if bare.lower() in ENDING_ABBREVIATIONS:
        return not _next_visible(text, dot + 1).isupper()
    if len(bare) == 1 and bare.isalpha() and bare.isupper():
        return True
    digits = dot - len(bare)
    return re.fullmatch("[0-9]+", bare) is not None and _BLANK_BEFORE.fullmatch(text, start, max(start, digits)) is not None


def split_sentences(text: str) -> list[Sentence]:
    """Texts without any mark are one sentence; pure punctuation joins the sentence before it on its line, or is dropped."""
    spans: list[list] = []

    def close(a: int, b: int) -> None:
        piece = text[a:b].strip()
        if not piece:
            return
        a += text[a:b].index(piece)
        b = a + len(piece)
        if any(map(str.isalnum, piece)):
            spans.append([a, b, False])
        elif spans and "\n" not in text[spans[-1][1] : a]:
            spans[-1][1] = b

    start = at = 0
    while m := _STOP.search(text, at):
        at = m.end()
        if m.group()[0].isspace():
            breaks = m.group().count("\n")
            if breaks:
                close(start, m.start())
                if breaks > 1 and spans:
                    spans[-1][2] = True
                start = at
            continue
        end = _CLOSING.match(text, at).end()
        gap = _LINE_GAP.match(text, end).group()
        if end < len(text):
            if not gap:
                continue
            if "\n" not in gap and (_next_visible(text, end).islower() or m.group() == "." and _dot_goes_on(text, start, m.start())):
                continue
        close(start, end)
        start = at = end
    close(start, len(text))
    if spans:
        spans[-1][2] = True
    wide = [i for i, c in enumerate(text) if ord(c) > 0xFFFF] if not text.isascii() else []
    units = lambda i: i + sum(w < i for w in wide)
    return [Sentence(text[a:b], units(a), units(b), last) for a, b, last in spans]
