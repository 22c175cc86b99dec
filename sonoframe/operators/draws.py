"""Draws of one random generator's sequence, made in many places: what random.Random(seed).choice picks, resample after resample.

The generator is linear over single bits, so its state after any number of steps is a sum of early states, told by a power of x
modulo the characteristic polynomial. How many raw numbers a group takes depends on those drawn again. These are counted first,
in blocks, by many tasks; then each group's place in the sequence is known and any stretch of it can be worked on by itself.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Words of the generator's state; raw numbers made at once; raw numbers that are sooner passed over than jumped.
WORDS, STEP, NEAR = 624, 1 << 16, 1 << 23


def source(seed: int) -> np.random.MT19937:
    """The generator of random.Random(seed), for raw numbers in bulk."""
    key = random.Random(seed).getstate()[1]
    return _with_key(np.array(key[:-1], dtype=np.uint32), key[-1])


def _with_key(key: np.ndarray, pos: int = WORDS) -> np.random.MT19937:
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": pos}}
    return out


@lru_cache(maxsize=1)
def _polynomial() -> tuple[int, ...]:
    """Exponents of the generator's characteristic polynomial, the highest first: Berlekamp and Massey's method on one bit."""
    bits = (source(1).random_raw(2 * 32 * WORDS) & np.uint64(1)).tolist()
    c, b, length, since, past = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        past = past << 1 | bit
        if (c & past).bit_count() & 1:
            if 2 * length <= n:
                c, b, length, since = c ^ b << since, c, n + 1 - length, 0
            else:
                c ^= b << since
        since += 1
    return tuple(length - i for i in range(length + 1) if c >> i & 1)


#: The bits of each byte with zeros between them.
_SPREAD = np.array([sum((i >> k & 1) << 2 * k for k in range(8)) for i in range(256)], dtype="<u2")


def _power(steps: int) -> int:
    """x to the power of ``steps``, modulo the polynomial, its coefficients as bits."""
    top, *low = _polynomial()
    out = 1
    for bit in f"{steps:b}":
        spread = _SPREAD[np.frombuffer(out.to_bytes(out.bit_length() // 8 + 1, "little"), dtype=np.uint8)]
        out = int.from_bytes(spread.tobytes(), "little") << int(bit)
        while high := out >> top:
            out &= (1 << top) - 1
            for t in low:
                out ^= high << t
    return out


@lru_cache(maxsize=2)
def _early_words(seed: int) -> np.ndarray:
    """The words of the generator's first states after the given one, as many as any later state is a sum of."""
    made, keys = source(seed), []
    for _ in range(_polynomial()[0] // WORDS + 2):
        made.random_raw(WORDS, output=False)
        keys.append(made.state["state"]["key"].copy())
    return np.concatenate(keys)


def source_at(seed: int, place: int) -> np.random.MT19937:
    """The generator after its first ``place`` raw numbers."""
    if place < NEAR:
        out = source(seed)
        out.random_raw(place, output=False)
        return out
    states, rest = divmod(place, WORDS)
    power = _power((states - 1) * WORDS)
    taken = np.flatnonzero(np.unpackbits(np.frombuffer(power.to_bytes(power.bit_length() // 8 + 1, "little"), dtype=np.uint8), bitorder="little"))
    windows = np.lib.stride_tricks.sliding_window_view(_early_words(seed), WORDS)
    out = _with_key(np.bitwise_xor.reduce(windows[taken], axis=0))
    out.random_raw(rest, output=False)
    return out


def _raw(made: np.random.MT19937, size: int) -> Iterator[np.ndarray]:
    """The next raw numbers, a few at a time."""
    numbers = np.random.Generator(made)
    for at in range(0, size, STEP):
        yield numbers.integers(0, 1 << 32, min(STEP, size - at), dtype=np.uint32)


def _shift(n: int) -> int:
    """Choices among n take so many bits from a raw number; values from n on are drawn again."""
    return 32 - n.bit_length()


def counted(seed: int, n: int, first: int, last: int, block: int) -> list[int]:
    """How many choices among n the blocks first..last - 1 of raw numbers give."""
    limit, made = np.uint32(n << _shift(n)), source_at(seed, first * block)
    return [sum(int(np.count_nonzero(v < limit)) for v in _raw(made, block)) for _ in range(first, last)]


def sums(seed: int, start: int, end: int, first: int, columns: list[np.ndarray], resamples: int) -> tuple[int, np.ndarray]:
    """What resamples pick in a stretch of raw numbers whose first choice has the number ``first`` of its group: the first
    resample of the stretch, and the sums of each column (columns, resamples)."""
    n, base, last = len(columns[0]), first // len(columns[0]), first // len(columns[0]) - 1
    most = max(int(np.abs(c).max()) for c in columns)
    packed = len(columns) == 2 and most * n < 1 << 31 and min(int(c.min()) for c in columns) >= 0
    tables = [columns[0] << 32 | columns[1]] if packed else columns
    tables = [np.concatenate([c, np.zeros((1 << n.bit_length()) - n, dtype=np.int64)]) for c in tables]  # what is drawn again adds nothing
    out = np.zeros((len(tables), resamples - base), dtype=np.int64)
    for v in _raw(source_at(seed, start), end - start):
        v >>= np.uint32(_shift(n))
        hits = v < n
        if not (have := int(np.count_nonzero(hits))):
            continue
        begin, last = first // n, (first + have - 1) // n
        starts = np.zeros(last - begin + 1, dtype=np.int64)
        if last > begin:
            starts[1:] = np.flatnonzero(hits)[np.arange(begin + 1, last + 1) * n - first]
        places = v.astype(np.int64)
        for row, table in zip(out, tables):
            row[begin - base : last + 1 - base] += np.add.reduceat(table.take(places, mode="wrap"), starts)
        first += have
    out = out[:, : last + 1 - base]
    return base, np.stack([out[0] >> 32, out[0] & (1 << 32) - 1]) if packed else out


@dataclass(frozen=True)
class Piece:
    """Raw numbers start..end - 1, all of one group; ``first`` is the number of the first choice among the group's."""

    group: int
    start: int
    end: int
    first: int


class Plan:
    """Where in the sequence each group of so many members has its choices: ``resamples`` of its size each, group after group."""

    def __init__(self, seed: int, sizes: list[int], resamples: int):
        self.seed, self.sizes, self.resamples = seed, sizes, resamples
        self.wanted = [n * resamples for n in sizes]
        self.total = math.ceil(sum(w * 2.0 ** n.bit_length() / n for n, w in zip(sizes, self.wanted)))  # as expected
        self.block = min(1 << 22, max(1 << 14, self.total >> 16))
        self.counts: dict[tuple[int, int], int] = {}

    def expected(self, most: int) -> list[tuple[int, int, int]]:
        """(group, first, last): the blocks, last left out, that a group's choices lie in but for a chance of nothing, up to
        ``most`` together. A block that they reach all the same is counted later."""
        out, mean, spread = [], 0.0, 0.0
        for g, (n, wanted) in enumerate(zip(self.sizes, self.wanted)):
            share = n / 2.0 ** n.bit_length()
            first = max(0, math.floor((mean - 8 * math.sqrt(spread)) / self.block))
            mean, spread = mean + wanted / share, spread + wanted * (1 - share) / share**2
            last = math.ceil((mean + 8 * math.sqrt(spread)) / self.block)
            out += [(g, b, min(last, b + most)) for b in range(first, last, most)]
        return out

    def add(self, group: int, first: int, counts: list[int]) -> None:
        self.counts.update(((group, first + i), n) for i, n in enumerate(counts))

    def _count(self, group: int, block: int) -> int:
        if (group, block) not in self.counts:
            self.add(group, block, counted(self.seed, self.sizes[group], block, block + 1, self.block))
        return self.counts[group, block]

    def pieces(self, most: int) -> list[Piece]:
        """All groups' choices, in pieces of up to ``most`` blocks and a begun one."""
        out, at, held, raw = [], 0, -1, np.zeros(0, dtype=np.uint32)
        for g, (n, wanted) in enumerate(zip(self.sizes, self.wanted)):
            limit, done, begun, from_ = np.uint32(n << _shift(n)), 0, at, 0
            while done < wanted:
                b, off = divmod(at, self.block)
                if off or done + self._count(g, b) >= wanted:  # where in the block do the choices begin or end
                    if held != b:
                        held, raw = b, np.concatenate(list(_raw(source_at(self.seed, b * self.block), self.block)))
                    hits = np.flatnonzero(raw[off:] < limit)[: wanted - done]
                    done += len(hits)
                    at = at + int(hits[-1]) + 1 if done == wanted else (b + 1) * self.block
                else:
                    done, at = done + self._count(g, b), (b + 1) * self.block
                if done == wanted or at - begun >= most * self.block:
                    out.append(Piece(g, begun, at, from_))
                    begun, from_ = at, done
        return out
