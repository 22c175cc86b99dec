"""Byte-pair encoding of whole partitions by a pair occurrence index.

The tokens of a public byte-level vocabulary are found in three steps that work on arrays of many texts at once:

1. ``token_starts`` finds the pre-token boundaries of all texts of a block with array operations on their code points;
2. every distinct pre-token of the partition is kept once;
3. ``merge_words`` encodes all new pre-tokens together: an index maps each mergeable pair to all of its positions, the
   active ranks are applied in ascending order, and each merge updates only the lists of its two neighbours.

No text is cut: one longer than a block is walked in segments that end between a visible character and a blank, where a
pre-token always ends.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

#: Code points handled at a time, pre-tokens gathered before encoding, distinct ones remembered: they bound memory and
#: don't change results.
BLOCK_CHARS = 1_000_000
GATHER_TOKENS = 6_000_000
CACHE_WORDS = 500_000

T = TypeVar("T")
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_CODES = 0x110000
_APOSTROPHE, _BLANK = 0x27, 0x20
#: Unicode's White_Space characters.
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The English contractions that the vocabulary's pattern keeps together.
_CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def _class_table() -> np.ndarray:
    kinds = np.zeros(_CODES, dtype=np.uint8)
    points = [i for i in range(_CODES) if not 0xD800 <= i < 0xE000]
    where = np.array(points)
    everything = "".join(map(chr, points))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, everything):
            kinds[where[m.start() : m.end()]] = kind
    kinds[_WHITE_SPACE] = SPACE
    return kinds


def token_starts(codes: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Marks where pre-tokens begin. ``first`` marks the first code point of each text."""
    n = len(codes)
    k = kinds[codes]
    space = k == SPACE
    before = np.empty(n, dtype=np.uint8)
    before[1:] = k[:-1]
    before[:1] = OTHER
    after_space = np.zeros(n, dtype=bool)
    after_space[1:] = space[:-1]
    last = np.ones(n, dtype=bool)
    last[:-1] = first[1:]
    next_visible = np.zeros(n, dtype=bool)
    next_visible[:-1] = ~space[1:]
    next_visible &= ~last
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = codes[:-1] == _BLANK
    start = np.where(space, ~after_space | next_visible, np.where(after_space, ~after_blank, k != before))
    start |= first
    # a contraction counts only where its apostrophe begins a pre-token of its own
    at = np.flatnonzero((codes == _APOSTROPHE) & start)
    for form in _CONTRACTIONS:
        here = at[at + len(form) < n]
        for j, letter in enumerate(form, 1):
            here = here[(codes[here + j] == ord(letter)) & ~first[here + j]]
        for j in range(1, len(form) + 1):
            start[here + j] = False
        behind = here + len(form) + 1
        start[behind[behind < n]] = True
    return start


class Vocabulary:
    """A byte-level vocabulary read from the bytes of its tokenizer file."""

    def __init__(self, data: bytes):
        model = json.loads(data)["model"]
        ids: dict[str, int] = model["vocab"]
        self.kinds = _class_table()
        self.byte_ids = np.array([ids[c] for c in _byte_alphabet()], dtype=np.int64)
        self.merges: list[tuple[int, int, int]] = []
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = ids[left], ids[right], ids[left + right]
            self.merges.append((a, b, c))
            self.ranks.setdefault(a << 20 | b, rank)
        keys = np.array(list(self.ranks), dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.ranks.values()), dtype=np.int64)[order]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, -1 for pairs that are never merged."""
        keys = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        if not len(raw):
            return np.zeros(0, dtype=np.int32), sizes
        ends = np.cumsum(sizes)
        index = PairIndex(self, self.byte_ids[raw], ends[sizes > 0])
        index.merge_all()
        kept = index.symbols >= 0
        total = np.concatenate([[0], np.cumsum(kept)])
        return index.symbols[kept].astype(np.int32), total[ends] - total[ends - sizes]


class PairIndex:
    """All positions of each mergeable pair in a sequence of words, kept up to date while the ranks are applied.

    Words are linked lists of symbols over shared arrays. A rank with many positions is applied by array operations; one
    with few, or whose pair may overlap itself, position by position through views of the same arrays.
    """

    MANY = 48

    def __init__(self, vocabulary: Vocabulary, symbols: np.ndarray, ends: np.ndarray):
        n = len(symbols)
        self.vocabulary, self.symbols = vocabulary, symbols.astype(np.int64)
        self.following, self.preceding = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.following[ends - 1] = -1
        self.preceding[ends[:-1]] = -1
        self.places: dict[int, list[int]] = {}
        self.active: list[int] = []
        at = np.flatnonzero(self.following >= 0)
        self._note(at, self.vocabulary.ranks_of(self.symbols[at], self.symbols[at + 1]))

    def _note(self, at: np.ndarray, ranks: np.ndarray) -> None:
        """Adds positions under their ranks."""
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        begin = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])).tolist()
        ranked, listed, places = ranks[begin].tolist(), at.tolist(), self.places
        for rank, i, j in zip(ranked, begin, [*begin[1:], len(listed)]):
            if rank in places:
                places[rank] += listed[i:j]
            else:
                places[rank] = listed[i:j]
                heapq.heappush(self.active, rank)

    def merge_all(self) -> None:
        while self.active:
            rank = heapq.heappop(self.active)
            positions = self.places.pop(rank)
            left, right, joined = self.vocabulary.merges[rank]
            if len(positions) < self.MANY or left == right:
                self._merge_each(sorted(positions), left, right, joined)
            else:
                self._merge_together(np.unique(np.array(positions)), left, right, joined)

    def _merge_together(self, p: np.ndarray, left: int, right: int, joined: int) -> None:
        symbols, following, preceding = self.symbols, self.following, self.preceding
        p = p[(symbols[p] == left) & (following[p] >= 0)]
        p = p[symbols[following[p]] == right]
        q = following[p]
        symbols[p], symbols[q] = joined, -1
        after = following[q]
        following[p] = after
        linked = after >= 0
        preceding[after[linked]] = p[linked]
        prior = preceding[p]
        prior = prior[prior >= 0]
        first = np.concatenate([p[linked], prior])
        self._note(first, self.vocabulary.ranks_of(symbols[first], symbols[following[first]]))

    def _merge_each(self, positions: list[int], left: int, right: int, joined: int) -> None:
        s, following, preceding = memoryview(self.symbols), memoryview(self.following), memoryview(self.preceding)
        rank_of, places, active = self.vocabulary.ranks.get, self.places, self.active
        for p in positions:
            if s[p] != left:
                continue
            q = following[p]
            if q < 0 or s[q] != right:
                continue
            s[p], s[q] = joined, -1
            after = following[p] = following[q]
            if after >= 0:
                preceding[after] = p
                r = rank_of(joined << 20 | s[after])
                if r is not None:
                    if r in places:
                        places[r].append(p)
                    else:
                        places[r] = [p]
                        heapq.heappush(active, r)
            prior = preceding[p]
            if prior >= 0:
                r = rank_of(s[prior] << 20 | joined)
                if r is not None:
                    if r in places:
                        places[r].append(prior)
                    else:
                        places[r] = [prior]
                        heapq.heappush(active, r)


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Encoder:
    """Numbers the distinct pre-tokens of many texts and encodes those that are new together."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.fresh: list[str] = []
        self.pool = np.zeros(0, dtype=np.int32)
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pre-tokens of the texts one after another, and how many each text has."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        offsets = np.cumsum(sizes) - sizes
        first = np.zeros(len(codes), dtype=bool)
        first[offsets] = True
        begins = np.flatnonzero(token_starts(codes, first, self.vocabulary.kinds))
        bounds = begins.tolist()
        bounds.append(len(joined))
        words = np.empty(len(begins), dtype=object)
        words[:] = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        local, distinct = pd.factorize(words)
        known, numbers = self.known, np.empty(len(distinct), dtype=np.int32)
        for i, w in enumerate(distinct):
            number = known.get(w)
            if number is None:
                number = known[w] = len(known)
                self.fresh.append(w)
            numbers[i] = number
        upto = np.searchsorted(begins, np.concatenate([offsets, [len(codes)]]))
        return numbers[local], np.diff(upto)

    def number(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_block``, for any number of texts of any length; null counts as empty."""
        pieces, owner, waiting = [], [], 0
        found: list[np.ndarray] = []
        totals = np.zeros(len(texts), dtype=np.int64)

        def flush() -> None:
            nonlocal pieces, owner, waiting
            if pieces:
                numbers, counts = self._block(pieces)
                np.add.at(totals, owner, counts)
                found.append(numbers)
            pieces, owner, waiting = [], [], 0

        for i, text in enumerate(texts):
            for part in _segments(text) if text else ():
                if waiting and waiting + len(part) > BLOCK_CHARS:
                    flush()
                pieces.append(part)
                owner.append(i)
                waiting += len(part)
        flush()
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int32), totals

    def settle(self) -> None:
        """Encodes the pre-tokens met since the last call."""
        if self.fresh:
            ids, counts = self.vocabulary.merge_words([w.encode("utf-8") for w in self.fresh])
            self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.pool = np.concatenate([self.pool, ids])
            self.fresh = []

    def sizes(self, numbers: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """How many ids each text has."""
        running = np.concatenate([[0], np.cumsum(self.count[numbers])])
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        return np.diff(running[bounds])

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        counts = self.count[numbers]
        begin = np.cumsum(counts) - counts
        shift = np.repeat(self.begin[numbers] - begin, counts)
        return self.pool[np.arange(len(shift)) + shift]

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number for each text."""
        numbers, per_text = self.number(texts)
        self.settle()
        return self.ids(numbers), self.sizes(numbers, per_text)

    def partition(self, batches: Iterable[tuple[T, list[str | None]]]) -> Iterator[tuple[T, np.ndarray, np.ndarray]]:
        """Each batch's companion with its pre-tokens' numbers and their count by text; all of them can be encoded then.

        Batches wait, as four bytes a pre-token, until GATHER_TOKENS have come, so that one index serves many texts.
        """
        waiting, gathered = [], 0
        for companion, texts in batches:
            if not waiting and len(self.known) > CACHE_WORDS:
                self._forget()
            numbers, per_text = self.number(texts)
            waiting.append((companion, numbers, per_text))
            gathered += len(numbers)
            if gathered > GATHER_TOKENS:
                self.settle()
                yield from waiting
                waiting, gathered = [], 0
        self.settle()
        yield from waiting


def _segments(text: str):
    """The text, cut between a visible character and a following blank where it is longer than a block."""
    at = 0
    while len(text) - at > BLOCK_CHARS:
        m = _CUT.search(text, at + BLOCK_CHARS)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


_CUT = regex.compile("[^" + "".join(map(chr, _WHITE_SPACE)) + "](?=[ \\t\\n])")
_encoders: dict[int, Encoder] = {}


def encoder_for(data: bytes) -> Encoder:
    """The worker's encoder of a vocabulary; workers are used again for many tasks."""
    key = hash(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(data))
    return _encoders[key]


def ids_array(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32, copy=False)))


@lru_cache(maxsize=2)
def token_bytes(data: bytes) -> list[bytes]:
    """The bytes of each id of a vocabulary file."""
    of = {c: bytes([i]) for i, c in enumerate(_byte_alphabet())}
    ids = json.loads(data)["model"]["vocab"]
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = b"".join(of[c] for c in token)
    return out
