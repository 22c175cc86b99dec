"""Errors that may change a statement's meaning: numbers, units, negations, dates, expected terms."""

from __future__ import annotations

from collections import Counter
from itertools import zip_longest

from sonoframe.text.numbers import UNIT_OF, is_numeric_token
from sonoframe.text.scoring import levenshtein, normalize_words

#: Words that negate, and names of days and months.
NEGATIONS = frozenset("pas jamais aucun aucune aucuns aucunes sans non rien ni nul nulle not no never without none nothing nobody cannot".split())
DATE_WORDS = frozenset(
    "lundi mardi mercredi jeudi vendredi samedi dimanche janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august october december".split()
)
NEAR_TERM = 0.6


def multiset_diff(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """What only a and only b have, each in its order; of equal items the first ones are paired."""
    common = Counter(a) & Counter(b)

    def beyond(items: list[str]) -> list[str]:
        left, out = Counter(common), []
        for x in items:
            if left[x]:
                left[x] -= 1
            else:
                out.append(x)
        return out

    return beyond(a), beyond(b)


def negation_count(tokens: list[str]) -> int:
    """Strong markers, or one if there are only weak ones."""
    strong = sum(t in NEGATIONS or t.endswith("n't") for t in tokens)
    return strong or int(any(t == "ne" or t.startswith("n'") for t in tokens))


def similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 - levenshtein(a, b) / longest if longest else 1.0


def split_elisions(tokens: list[str]) -> list[str]:
    return [part for t in tokens for part in t.split("'") if part]


def find_term(term: list[str], words: list[str]) -> tuple[bool, tuple[str, float] | None]:
    """Whether the term stands in the words, else the closest stretch of about its length and its similarity."""
    size = len(term)
    stretches = lambda k: (words[i : i + k] for i in range(len(words) - k + 1))
    if not term or any(w == term for w in stretches(size)):
        return True, None
    target, best = "".join(term), None
    for k in range(max(1, size - 1), size + 2):
        for stretch in stretches(min(k, max(1, len(words)))):
            joined = "".join(stretch)
            # lengths alone bound the similarity
            if best is not None and 1.0 - abs(len(target) - len(joined)) / max(len(target), len(joined)) <= best[1]:
                continue
            close = similarity(target, joined)
            if best is None or close > best[1]:
                best = " ".join(stretch), close
    return False, best


def _changes(kind: str, what: str, expected: list[str], heard: list[str]) -> list[dict]:
    missing, extra = multiset_diff(expected, heard)
    out = []
    for m, e in zip_longest(missing, extra):
        verb = "added" if m is None else "lost" if e is None else "changed"
        out.append({"kind": kind, "severity": "critical", "expected": "(none)" if m is None else m, "found": "(absent)" if e is None else e, "message": f"{what} was {verb}"})
    return out


def analyze(reference: str, hypothesis: str, key_terms: list[tuple[str, str]] = ()) -> list[dict]:
    """Flags in the order numbers, units, negations, dates, key terms (text, kind)."""
    r, h = normalize_words(reference), normalize_words(hypothesis)
    picked = lambda tokens, keep: [t for t in tokens if keep(t)]
    flags = _changes("number", "a number", picked(r, is_numeric_token), picked(h, is_numeric_token))
    flags += _changes("unit", "a unit", *([UNIT_OF[t] for t in side if t in UNIT_OF] for side in (r, h)))
    before, after = negation_count(r), negation_count(h)
    if before != after:
        verb = "dropped" if after < before else "added"
        message = f"a negation was {verb}: the meaning may be reversed"
        flags.append({"kind": "negation", "severity": "critical", "expected": f"{before} negation marker(s)", "found": str(after), "message": message})
    flags += _changes("date", "a day or month", picked(r, DATE_WORDS.__contains__), picked(h, DATE_WORDS.__contains__))
    heard = split_elisions(h)
    for text, kind in key_terms:
        found, near = find_term(split_elisions(normalize_words(text)), heard)
        if found:
            continue
        flag = {"kind": "keyTerm", "severity": "critical" if kind in ("drug", "name") else "warning", "expected": text, "found": "(absent)", "message": f"expected {kind} term not found"}
        if near and near[1] >= NEAR_TERM:
            flag["found"] = near[0]
            flag["message"] += f"; closest text is {near[1] * 100:.0f} % similar (probable misspelling)"
        flags.append(flag)
    return flags


def term_outcomes(key_terms: list[tuple[str, str]], flags: list[dict]) -> list[tuple[str, str, bool]]:
    """(kind, text, found) of each term."""
    missed = {f["expected"] for f in flags if f["kind"] == "keyTerm"}
    return [(kind, text, text not in missed) for text, kind in key_terms]


def key_words(key_terms: list[tuple[str, str]]) -> set[str]:
    return {w for text, _ in key_terms for w in split_elisions(normalize_words(text))}
