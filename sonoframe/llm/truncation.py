"""Problem 2: texts that were cut off.

Only a text that doesn't close with a sentence's end can have been cut. For each such open text:

1. near-copies are found by min-hash banding over five-word shingles. A cut text is like the beginning of its near-copy, so
   each text has bands for growing beginnings (LEVELS words), and an open text asks in those of the longest beginnings that
   it holds whole. An open text too short for shingles has one band: all its words but the last;
2. a pair is verified (at least 0.8 of the words stand in the other's beginning) and its end aligned. The near-copy then
   says whether the text stops inside a word, inside a sentence, or where a sentence ends. Each open text is held against every
   text of its bands, in blocks, and each pair votes once;
3. a text that no near-copy calls cut is scored by closing-word terminality: log-odds that the last words end a sentence,
   from how often they do so in the whole corpus, less what speaks for a cut there: a last word that is rare beside the words
   it begins, a closing that no finished text has, a length at which many different closings of the source stop. Near-copies
   that say complete, and other sources that stop with the same words, speak against it.

A short text's band holds all its near-copies by definition; their votes are counted by next word without making pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.session import BROADCAST_LIMIT_BYTES, cut_lineage, spread

SHINGLE, SIMILARITY = 5, 0.8
#: Words of the beginnings that have bands, and min-hashes of each. An open text asks in those of the longest two it holds.
FIRST_LEVEL, HASHES, ASKED_LEVELS = 8, 4, 2
#: Texts of a band that a task holds at once, on either side of the comparison.
BLOCK = 1024
#: Near-copies from which a text's votes are worked out in arrays, of so many words at once (pairs of a block from the square of
#: it); all ways give the same.
MANY, AT_ONCE = 8, 1 << 18
#: Words at the end that are aligned.
TAIL = 12
#: A word is a fragment if, ends of open texts left out, it is met at most so often for each word that it begins.
FRAGMENT_SHARE = 0.02
#: Occurrences that the rate of a word, and of all words, counts for in the rate of a pair and of a word.
PRIOR = 25.0
#: Letters from which the beginning of a word tells the word without the one before it.
LONG_PREFIX = 4
#: Weights in log-odds: of a fragment, of a closing that no finished text has, of near-copies that say complete. A text that no
#: near-copies call cut is cut if its score is below CUT_BELOW.
FRAGMENT_WEIGHT, LOOSE_WEIGHT, COMPLETE_WEIGHT, CUT_BELOW = 4.0, 6.0, 4.0, -2.0
#: How many times as many closings as the lengths around a length may have by itself.
LIMIT_FACTOR = 3.0

_WORD_AND_GAP = regex.compile(r"([^\W_]+)([\W_]*)")
_TERMINAL, _INNER_TERMINAL = ".?!", ".?!…"
_SEEDS = [0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1 for i in range(HASHES)]
#: What may have been put where the rest of a text had been, and what may follow a sentence's end; read from the end.
_MARK = regex.compile(r"(?r)(?:\s|…|\.\.\.|�|&#?\w{0,8}(?=$|\s)|[\[({<]+(?:…|\.\.\.|cut|truncated|tronqué|coupé)?[\])}>]*)+$")
#: Ends that no finished text has: half characters, opened brackets, entities without their end, three dots, blanks, commas.
_LOOSE = regex.compile(r"(?r)(?:\s|�.?|&#?\w{0,8}|[\[({<]|\.\.\.|[,;:\-–—«“])$")
_CLOSERS = " \t\r\n\f\v\xa0  »”\"’')]"

#: words, with blanks between; of each word whether a sentence ends after it, as 1 or 0; bands that it answers and asks in.
_FEATURES = pa.schema([
    ("tid", pa.int64()), ("words", pa.string()), ("n", pa.int32()), ("ends", pa.string()), ("closed", pa.bool_()), ("dots", pa.bool_()), ("looped", pa.bool_()),
    ("loose", pa.bool_()), ("chars", pa.int32()), ("bytes", pa.int32()), ("answers", pa.list_(pa.int64())), ("asks", pa.list_(pa.int64())),
])
_SHAPE = "tid long, words string, n int, ends string, closed boolean, dots boolean, looped boolean, loose boolean, chars int, bytes int, answers array<long>, asks array<long>"


def _levels(longest: int) -> list[int]:
    """8, 12, 16, 24, 32, ... up to the longest."""
    out, level = [], FIRST_LEVEL
    while level <= longest:
        out += [level, level + level // 2]
        level *= 2
    return [x for x in out if x <= longest]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _bands(words: list[list[str]]) -> list[list[tuple[int, np.ndarray]]]:
    """Of each text (level, bands of its beginning of so many words), by rising level; of texts of fewer words nothing."""
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in words]
    numbers: dict[str, int] = {}
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    if not len(sizes) or sizes.max() < FIRST_LEVEL:
        return out
    flat = np.array([numbers.setdefault(w, len(numbers)) for text in words for w in text], dtype=np.int64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], dtype=np.uint64)[flat]
    first = np.cumsum(sizes) - sizes
    shingles = np.zeros(len(flat), dtype=np.uint64)
    for k in range(SHINGLE):  # the last few of a text reach into the next and are never used
        shingles[: len(flat) - k] = _mixed(shingles[: len(flat) - k] + hashes[k:] + np.uint64(k + 1))
    for level in _levels(int(sizes.max())):
        long = np.flatnonzero(sizes >= level)
        edges = np.stack([first[long], first[long] + level - SHINGLE + 1], axis=1).ravel()
        own = []
        for k, seed in enumerate(_SEEDS):
            lowest = np.minimum.reduceat(np.append(_mixed(shingles ^ np.uint64(seed)), np.uint64(0)), edges)[::2]
            own.append(_mixed(lowest + np.uint64(level * HASHES + k)).view(np.int64))
        for i, row in zip(long.tolist(), np.stack(own, axis=1)):
            out[i].append((level, row))
    return out


def _features(texts: list[str]) -> tuple[list[list[str]], dict[str, list]]:
    words, columns = [], {name: [] for name in _FEATURES.names if name not in ("tid", "answers", "asks")}
    ends_at: dict[str, tuple[bool, bool]] = {}
    for text in texts:
        core = _MARK.sub("", text, count=1)
        shown = text.rstrip()
        marked = len(core) < len(shown)
        stripped = core.rstrip(_CLOSERS)
        closed = stripped.endswith(tuple(_TERMINAL)) and (not marked or shown.endswith(tuple(_TERMINAL)))
        loose = bool(_LOOSE.search(text) or _LOOSE.search(core))
        # an engine that writes neither case nor punctuation doesn't write dots either
        loose |= text.endswith("…") and core == core.lower() and not any(c in ".,?!:;" for c in core)
        found, gaps = [], []
        for w, gap in _WORD_AND_GAP.findall(core.lower()):
            found.append(w)
            if gap not in ends_at:
                stop = any(c in _INNER_TERMINAL for c in gap)
                ends_at[gap] = (stop and any(c.isspace() for c in gap), stop)
                if len(ends_at) > 10_000:
                    ends_at = {gap: ends_at[gap]}
            gaps.append(ends_at[gap])
        tail = found[-3:]
        words.append(found)
        looped = len(tail) == 3 and any(w == tail[0] for w in found[:-3]) and sum(found[i : i + 3] == tail for i in range(len(found) - 3)) >= 2
        said = (" ".join(found), len(found), "".join("1" if g[0] else "0" for g in gaps[:-1]) + ("1" if gaps and gaps[-1][1] else "0" if gaps else ""))
        for name, value in zip(columns, (*said, closed, text.rstrip(" »”)").endswith("…"), looped, loose, len(text), len(text.replace("�", "").encode()))):
            columns[name].append(value)
    return words, columns


def features(texts: DataFrame) -> DataFrame:
    """Words, sentence ends, closing and bands of each distinct text (tid long, text)."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, len(batch), 2000)):
                words, columns = _features(part.column(1).to_pylist())
                answers, asks = [], []
                for text, own, closed in zip(words, _bands(words), columns["closed"]):
                    answers.append(np.concatenate([b for _, b in own]) if own else [])
                    # the last word may be cut, so that only beginnings without it are sure
                    asked = [b for level, b in own if level < len(text)][-ASKED_LEVELS:]
                    asks.append(np.concatenate(asked) if asked and not closed else [])
                values = [part.column(0), *columns.values(), answers, asks]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t.type) for v, t in zip(values, _FEATURES)], schema=_FEATURES)

    return texts.mapInArrow(run, _SHAPE)


def _slack(n: int) -> int:
    """How many words further than its own number a text of n words is looked for in another."""
    return max(2, n // 8)


def possible_pairs(asking: list[int], answering: list[int], codes: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Each of the asking texts with the answering ones that closing_vote may verify, by numbers of their words.

    Of the answering text's beginning those words are counted that stand in the asking one. They are at least as many as the
    words in common, so that none that closing_vote verifies is missing.
    """
    asking = [a for a in asking if len(codes[a]) > 1]
    if not asking or not answering:
        return
    lengths = np.array([len(codes[b]) for b in answering])
    order = np.argsort(-lengths, kind="stable")
    lengths, names = lengths[order], np.array(answering)[order]
    local = np.concatenate([codes[b] for b in names])
    ends = np.cumsum(lengths)
    place = np.arange(len(local)) - np.repeat(ends - lengths, lengths)
    known, before = np.zeros(1 + max(int(codes[i].max()) for i in (*asking, *answering)), dtype=np.uint8), 0
    for a in sorted(asking, key=lambda a: len(codes[a])):
        n = len(codes[a])
        if n != before:
            # those long enough come first
            before, some = n, int(np.searchsorted(-lengths, -(n - 1), side="right"))
            if not some:
                break
            width = np.minimum(lengths[:some], n + _slack(n))
            part = local[: ends[some - 1]][place[: ends[some - 1]] < n + _slack(n)]
            starts = np.cumsum(width) - width
        known[codes[a][:-1]] = 1
        common = np.add.reduceat(known[part], starts, dtype=np.int64)
        known[codes[a][:-1]] = 0
        found = names[:some][common >= SIMILARITY * (n - 1)]
        yield a, found[found != a]


def closing_vote(words: list[str], other: list[str], ends: str, dots: bool) -> int | None:
    """What a near-copy says of where a text stops: 1 cut, 0 complete, None nothing (or no near-copy)."""
    n = len(words)
    if n < 2 or len(other) < n - 1:
        return None
    slack = _slack(n)
    beginning = other[: n + slack]
    tail = words[-TAIL:]
    low = max(0, n - len(tail) - slack)
    part = beginning[low:]
    last = tail[-1]
    if not any(x.startswith(last) for x in part):
        return None
    if words[:-1] != other[: n - 1]:
        counts: dict[str, int] = {}
        for w in beginning:
            counts[w] = counts.get(w, 0) + 1
        common = 0
        for w in words[:-1]:
            if counts.get(w, 0) > 0:
                counts[w] -= 1
                common += 1
        if common < SIMILARITY * (n - 1):
            return None
    if len(other) >= n and tail[:-1] == other[n - len(tail) : n - 1] and (other[n - 1] == last or last not in part and other[n - 1].startswith(last)):
        return _said(n - 1, last, other, ends, dots)  # nothing can be aligned better
    # alignment of the tail with any stretch of the part; the row of costs by the place where the stretch ends
    row = [0] * (len(part) + 1)
    for i, w in enumerate(tail[:-1], 1):
        before, row[0] = row[0], i
        for j, x in enumerate(part, 1):
            best = before if w == x else before + 1
            before = row[j]
            if before + 1 < best:
                best = before + 1
            if row[j - 1] + 1 < best:
                best = row[j - 1] + 1
            row[j] = best
    # the beginning of a number tells of a cut only after the same word
    reached = [j for j, x in enumerate(part) if x == last or x.startswith(last) and not (last.isdigit() and (low + j == 0 or other[low + j - 1] != tail[-2]))]
    if not reached:
        return None
    cost, _, at = min((row[j] + (part[j] != last), abs(low + j + 1 - n), low + j) for j in reached)
    if cost > 1 + (1 - SIMILARITY) * len(tail):
        return None
    return _said(at, last, other, ends, dots)


def _said(at: int, last: str, other: list[str], ends: str, dots: bool) -> int | None:
    if other[at] != last:
        return 1
    if ends[at] == "1":
        return 0
    if at == len(other) - 1:
        return 0 if dots else None
    return 1 if "1" in ends[at + 1 :] else None


class _Block:
    """The texts of a block in arrays, for closing_vote's answers on many near-copies of a text at once."""

    def __init__(self, known: list[str], codes: list[np.ndarray], ends: tuple[str, ...], dots: tuple[bool, ...]):
        self.known, self.codes = known, codes  # words by number are in order, so that those that begin alike are neighbours
        self.lengths = np.array([len(x) for x in codes])
        self.first = np.cumsum(self.lengths) - self.lengths
        self.flat = np.concatenate(codes)
        self.ends = np.frombuffer("".join(ends).encode(), dtype=np.uint8) == ord("1")
        self.final = np.array([x.rfind("1") for x in ends])
        self.dots = np.array(dots, dtype=bool)

    def votes(self, a: int, words: list[str], copies: np.ndarray) -> tuple[int, int]:
        """How many of the copies say that the text is cut, and that it is complete."""
        step = max(1, AT_ONCE // (len(words) + _slack(len(words))))
        parts = [self._votes(self.codes[a], words[-1], copies[i : i + step]) for i in range(0, len(copies), step)]
        return sum(p[0] for p in parts), sum(p[1] for p in parts)

    def _votes(self, own: np.ndarray, last: str, copies: np.ndarray) -> tuple[int, int]:
        n, slack = len(own), _slack(len(own))
        copies = copies[self.lengths[copies] >= n - 1]
        if n < 2 or not len(copies):
            return 0, 0
        begins, upto = int(own[-1]), bisect_left(self.known, last + chr(0x10FFFF))
        width = np.arange(n + slack)[:, None]  # a column for each copy
        place = self.first[copies] + width
        beginning = np.where(width < self.lengths[copies], self.flat[np.minimum(place, len(self.flat) - 1)], -1)
        # words in common, each as often as both have it
        kinds, own_counts = np.unique(own[:-1], return_counts=True)
        at = np.minimum(np.searchsorted(kinds, beginning), len(kinds) - 1)
        held = np.nonzero(kinds[at] == beginning)
        counts = np.bincount(at[held] * len(copies) + held[1], minlength=len(kinds) * len(copies)).reshape(len(kinds), -1)
        low = max(0, n - min(n, TAIL) - slack)
        part = beginning[low:]
        near = (np.minimum(counts, own_counts[:, None]).sum(axis=0) >= SIMILARITY * (n - 1)) & ((part >= begins) & (part < upto)).any(axis=0)
        copies, beginning, part = copies[near], beginning[:, near], part[:, near]
        if not len(copies):
            return 0, 0
        tail = own[-TAIL:]
        row = np.zeros((len(part) + 1, len(copies)), dtype=np.int32)
        rise = np.arange(len(part) + 1, dtype=np.int32)[:, None]
        for i, w in enumerate(tail[:-1], 1):
            best = np.empty_like(row)
            best[0] = i
            np.minimum(row[:-1] + (part != w), row[1:] + 1, out=best[1:])
            row = np.minimum.accumulate(best - rise, axis=0) + rise
        reached = (part >= begins) & (part < upto)
        if last.isdigit():
            before = np.vstack([beginning[low - 1 : low] if low else np.full((1, len(copies)), -1), part[:-1]])
            reached &= (part == begins) | (before == tail[-2])
        cost = row[:-1] + (part != begins)
        where = low + np.arange(len(part), dtype=np.int64)[:, None]
        order = np.where(reached, (cost.astype(np.int64) << 48) + (np.abs(where + 1 - n) << 24) + where, np.iinfo(np.int64).max).min(axis=0)
        sure = (order >> 48) <= 1 + (1 - SIMILARITY) * len(tail)
        copies, at = copies[sure], (order & (1 << 24) - 1)[sure]
        other = self.flat[self.first[copies] + at] != begins
        ended, closing = self.ends[self.first[copies] + at], at == self.lengths[copies] - 1
        cut = other | ~ended & ~closing & (self.final[copies] > at)
        complete = ~other & (ended | closing & self.dots[copies])
        return int(cut.sum()), int(complete.sum())


def _where_few(rows: DataFrame, width: int) -> DataFrame:
    """Rows of about ``width`` bytes that others are filtered by: broadcast where they were counted to be few, so that what they
    leave out is never shuffled."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if width * rows.count() <= BROADCAST_LIMIT_BYTES // 4 else rows


_VOTES = pa.schema([("tid", pa.int64()), ("cut", pa.int64()), ("complete", pa.int64())])


def block_votes(rows: list[tuple]) -> list[tuple[int, int, int]]:
    """(tid, cut, complete) of a block's asking texts; rows are (asks, answers, tid, words, ends, dots), where asks and answers are
    the text's bands lower than the block's, null if it doesn't ask or answer. A pair that has one of these in common votes there."""
    asks, answers, tids, words, ends, dots = zip(*rows)
    asking, answering = [i for i, x in enumerate(asks) if x is not None], [i for i, x in enumerate(answers) if x is not None]
    out = []
    if len(asking) * len(answering) < MANY * MANY:
        for a in asking:
            copies = [b for b in answering if b != a and set(asks[a]).isdisjoint(answers[b])]
            mine = words[a].split(" ")
            votes = [closing_vote(mine, words[b].split(" "), ends[b], dots[b]) for b in copies]
            out.append((tids[a], votes.count(1), votes.count(0)))
        return [x for x in out if x[1] or x[2]]
    words = [w.split(" ") for w in words]
    known = sorted({w for x in words for w in x})
    numbers = {w: i for i, w in enumerate(known)}
    codes = [np.array([numbers[w] for w in x], dtype=np.int64) for x in words]
    block = _Block(known, codes, ends, dots)
    holders: dict[int, np.ndarray] = {}
    for b in answering:
        for x in answers[b]:
            holders.setdefault(x, np.zeros(len(rows), dtype=bool))[b] = True
    for a, copies in possible_pairs(asking, answering, codes):
        for x in asks[a]:
            if x in holders:
                copies = copies[~holders[x][copies]]
        if len(copies) < MANY:
            votes = [closing_vote(words[a], words[b], ends[b], dots[b]) for b in copies.tolist()]
            cut, complete = votes.count(1), votes.count(0)
        else:
            cut, complete = block.votes(a, words[a], copies)
        if cut or complete:
            out.append((tids[a], cut, complete))
    return out


def _block_votes(feats: DataFrame, banded: DataFrame, asked: DataFrame) -> DataFrame:
    """(tid, cut, complete): votes of every text of the bands in which the texts of ``asked`` ask.

    A band is cut into blocks of BLOCK texts that ask or answer, and all pairs of blocks are gone through. A pair that meets in
    several bands votes in one of them, so that only sums are shuffled on.
    """
    asking = _where_few(asked.groupBy("band").agg(F.count(F.lit(1)).alias("open")), 24)
    banded = cut_lineage(banded.select("band", "tid").join(asking, "band", "left_semi"))
    members = banded.groupBy("band").agg(F.count(F.lit(1)).alias("texts"))
    sizes = asking.join(members.filter("texts > 1"), "band").select("band", F.ceil(F.col("texts") / BLOCK).alias("columns"), F.ceil(F.col("open") / BLOCK).alias("lines"))
    row = lambda c, of: F.pmod(F.xxhash64("tid", F.lit(c)), of)
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    asks = asked.join(sizes, "band").withColumn("line", row(1, "lines")).select("band", "tid", "line", upto("columns").alias("column"), F.lit(True).alias("asking"), F.lit(False).alias("answering"))
    gives = banded.select("band", "tid").join(sizes, "band").withColumn("column", row(2, "columns")).select("band", "tid", upto("lines").alias("line"), "column", F.lit(False).alias("asking"), F.lit(True).alias("answering"))
    block = ["band", "line", "column"]
    placed = asks.unionByName(gives).groupBy(*block, "tid").agg(F.max("asking").alias("asking"), F.max("answering").alias("answering"))
    # who asks in a band asks besides in those of one level before or after it
    level = F.floor((F.array_position("answers", F.col("band")) - 1) / HASHES).cast("int")
    near = F.slice("answers", F.greatest(level - ASKED_LEVELS + 1, F.lit(0)) * HASHES + 1, (2 * ASKED_LEVELS - 1) * HASHES)
    lower = lambda bands: F.filter(bands, lambda x: x < F.col("band"))
    blocks = placed.join(feats.select("tid", "words", "ends", "dots", "asks", "answers"), "tid").select(
        *block, F.when(F.col("asking"), lower(F.col("asks"))).alias("asks"), F.when(F.col("answering"), lower(near)).alias("answers"), "tid", "words", "ends", "dots"
    )

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))

        votes: list[tuple] = []
        for _, members in groupby(rows(), key=lambda r: r[:3]):
            votes += block_votes([r[3:] for r in members])
            if len(votes) >= 10_000:
                yield batch_of(votes)
                votes = []
        yield batch_of(votes)

    def batch_of(votes):
        return pa.RecordBatch.from_arrays([pa.array([v[i] for v in votes], pa.int64()) for i in range(3)], schema=_VOTES)

    said = blocks.repartition(*block).sortWithinPartitions(*block).mapInArrow(run, "tid long, cut long, complete long")
    return said.groupBy("tid").agg(F.sum("cut").alias("cut"), F.sum("complete").alias("complete"))


def _short_votes(feats: DataFrame) -> DataFrame:
    """(tid, cut, complete): votes on open texts of fewer words than FIRST_LEVEL + 1.

    Their near-copies have all their words but the last at the beginning; which, and what comes next, is counted by the hash
    of that beginning and the next word.
    """
    asking = feats.filter(f"not closed and n between 2 and {FIRST_LEVEL}").select("tid", F.col("n").alias("k"), F.element_at(F.split("words", " "), -1).alias("last"), "words", "ends", "dots")
    head = lambda k: F.substring_index("words", " ", k)
    asking = asking.withColumn("head", F.expr("xxhash64(substring_index(words, ' ', k - 1), k)"))
    heads = _where_few(asking.select("head").distinct(), 16)
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.xxhash64(head(k - 1), F.lit(k)).alias("head")) for k in range(2, FIRST_LEVEL + 1))))
    said = feats.filter("n >= 2").select("tid", "words", "n", "ends", "dots", steps.alias("s")).filter("s.k <= n").withColumn("head", F.col("s.head")).join(heads, "head", "left_semi")
    ended = F.substring("ends", F.col("s.k"), F.lit(1)) == "1"
    later = F.substring("ends", F.col("s.k") + 1, F.col("n")).contains("1")
    complete = ended | ((F.col("s.k") == F.col("n")) & F.col("dots"))
    cut = ~ended & (F.col("s.k") < F.col("n")) & later
    counted = said.select("head", F.split("words", " ")[F.col("s.k") - 1].alias("next"), complete.cast("long").alias("complete"), cut.cast("long").alias("cut"))
    counted = counted.groupBy("head", "next").agg(F.sum("complete").alias("complete"), F.sum("cut").alias("cut"), F.count(F.lit(1)).alias("texts"))
    met = asking.join(counted, "head").filter(F.col("next").startswith(F.col("last")))
    same = F.col("next") == F.col("last")
    # a text's own row is among those of its last word
    own = F.when((F.substring("ends", F.col("k"), F.lit(1)) == "1") | F.col("dots"), 1).otherwise(0)
    votes = met.groupBy("tid").agg(F.sum(F.when(same, F.col("cut")).otherwise(F.col("texts"))).alias("cut"), F.sum(F.when(same, F.col("complete") - own).otherwise(0)).alias("complete"))
    return votes.filter("cut > 0 or complete > 0")


def _votes(feats: DataFrame) -> DataFrame:
    """(tid, cut, complete): the near-copies' votes on the texts without a sentence's end."""
    banded = feats.select("tid", "closed", F.explode(F.array_distinct("answers")).alias("band"))
    asked = feats.filter("not closed").select("tid", F.explode(F.array_distinct("asks")).alias("band"))
    return _block_votes(feats, banded, asked).unionByName(_short_votes(feats))


def _number(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), F.lit("#")).otherwise(c)


def _terminality(feats: DataFrame, votes: DataFrame) -> DataFrame:
    """(tid, odds): of each text without a sentence's end, the log-odds that its closing words end a sentence, against those
    of any word; lower by FRAGMENT_WEIGHT where the last word is a fragment.

    An open text's end, which may be a cut, counts only where near-copies say that it is none: else as neither an occurrence
    nor an end. So a fragment is none the less one for being met often.
    """
    confirmed = feats.select("tid", "words", "ends", "n", "closed").join(votes.filter("complete > cut").select("tid", F.lit(True).alias("whole")), "tid", "left")
    sure = F.col("closed") | F.coalesce("whole", F.lit(False))
    steps = confirmed.filter("n > 0").select(F.split("words", " ").alias("w"), "ends", "n", sure.alias("sure"))
    steps = steps.select(F.posexplode("w").alias("i", "word"), F.concat(F.array(F.lit("")), "w").alias("w"), "ends", "n", "sure")
    at_end = F.col("i") == F.col("n") - 1
    words = steps.select(
        _number(F.col("w")[F.col("i")]).alias("v"), _number(F.col("word")).alias("w"),
        F.when(at_end, F.col("sure")).otherwise(F.substring("ends", F.col("i") + 1, F.lit(1)) == "1").cast("long").alias("final"), (~at_end | F.col("sure")).cast("long").alias("met"),
    )
    pairs = cut_lineage(words.groupBy("v", "w").agg(F.sum("met").alias("n2"), F.sum("final").alias("f2")))
    singles = pairs.groupBy("w").agg(F.sum("n2").alias("n1"), F.sum("f2").alias("f1"))
    whole = singles.agg(F.coalesce(F.try_divide(F.sum("f1").cast("double"), F.sum("n1").cast("double")), F.lit(0.0)).alias("r0"))  # one row
    ending = F.split("words", " ")
    last = feats.filter("not closed and n > 0").select("tid", _number(F.coalesce(F.try_element_at(ending, F.lit(-2)), F.lit(""))).alias("v"), _number(F.element_at(ending, -1)).alias("w"))
    asked = _where_few(last.select("v", F.col("w").alias("prefix")).distinct(), 64)
    beginning = _where_few(last.select(F.col("w").alias("prefix")).distinct(), 40)
    beginnings = lambda c, least: F.explode(F.transform(F.sequence(F.lit(least), F.length(c) - 1), lambda k: F.substring(c, 1, k)))
    # words that follow v and begin with the closing word without being it
    longer = pairs.filter("w != '#' and length(w) > 1").select("v", "n2", beginnings("w", 1).alias("prefix"))
    longer = longer.join(asked, ["v", "prefix"], "left_semi").groupBy("v", "prefix").agg(F.sum("n2").alias("longer")).withColumnRenamed("prefix", "w")
    # the same without v, for beginnings long enough to tell
    starts = singles.filter(F.length("w") > LONG_PREFIX).select("n1", beginnings("w", LONG_PREFIX).alias("prefix"))
    begun = starts.join(beginning, "prefix", "left_semi").groupBy("prefix").agg(F.sum("n1").alias("begun")).withColumnRenamed("prefix", "w")
    joined = last.join(pairs, ["v", "w"], "left").join(singles, "w", "left").join(longer, ["v", "w"], "left").join(begun, "w", "left").na.fill(0).join(F.broadcast(whole))
    # a pair that often ends sentences says so; one that seldom does may be a usual one inside them
    rate1 = (F.col("f1") + PRIOR * F.col("r0")) / (F.col("n1") + PRIOR)
    rate2 = (F.col("f2") + PRIOR * rate1) / (F.col("n2") + PRIOR)
    fragment = (F.col("longer") > 0) & (F.col("n2") <= FRAGMENT_SHARE * F.col("longer")) & (F.col("n1") <= F.col("longer")) | (F.col("begun") > 0) & (F.col("n1") <= FRAGMENT_SHARE * F.col("begun"))
    odds = F.when((F.col("v") == F.col("w")) | (F.col("r0") == 0), 0.0).otherwise(F.ln(F.greatest(rate1, rate2) / F.col("r0")))  # a doubled word says nothing
    return joined.select("tid", (odds - F.when(fragment, FRAGMENT_WEIGHT).otherwise(0.0)).alias("odds"))


def _field_limits(open_records: DataFrame, size: str) -> DataFrame:
    """(origin, source, size, limit): the log-likelihood ratio of a field limit at a length, from how many different closings
    stop there without a sentence's end, against LIMIT_FACTOR times the lengths around (and one)."""
    at = open_records.select("origin", "source", F.col(size).alias("size"), "closing").distinct().groupBy("origin", "source", "size").agg(F.count(F.lit(1)).alias("closings"))
    # at most a row a length: neighbours within ten, themselves and the next three left out (bytes are cut before a character)
    around = Window.partitionBy("origin", "source").orderBy("size")
    near = F.coalesce(F.sum("closings").over(around.rangeBetween(-10, -4)), F.lit(0)) + F.coalesce(F.sum("closings").over(around.rangeBetween(4, 10)), F.lit(0))
    usual = LIMIT_FACTOR * near / 14.0 + 1.0
    ratio = F.when(F.col("closings") > usual, F.col("closings") * F.ln(F.col("closings") / usual) - F.col("closings") + usual).otherwise(0.0)
    return at.select("origin", "source", "size", ratio.alias("limit"))


def assess(records: DataFrame) -> DataFrame:
    """(origin, record_key, source, truncated, evidence, score), a row for each distinct record of text_records.

    Null and empty texts, and texts that close with a sentence's end, aren't truncated; nor is a text for which nothing
    speaks. ``evidence`` of a truncated one is near_copy or closing; ``score``, of open texts that none calls cut, their
    log-odds. Repeated rows of a record count once; a record delivered with several texts is truncated if one of them
    is. An empty table gives an empty result.
    """
    named = records.withColumn("tid", F.when(F.trim("text") != "", F.xxhash64("text")))
    texts = named.filter("tid is not null").select("tid", "text").dropDuplicates(["tid"])
    feats = cut_lineage(features(spread(texts)))
    judged = feats.select("tid", "closed", "loose", "looped", "chars", "bytes", F.xxhash64(F.substring_index("words", " ", -2)).alias("closing"), F.xxhash64("words").alias("spoken"))
    votes = cut_lineage(_votes(feats))
    judged = judged.join(votes, "tid", "left").join(_terminality(feats, votes), "tid", "left")
    keyed = named.select("origin", "record_key", "source", "tid").distinct()
    rows = cut_lineage(keyed.join(judged, "tid", "left"))
    open_rows = rows.filter("not closed")
    for size in ("chars", "bytes"):
        limits = _field_limits(open_rows, size).select("origin", "source", F.col("size").alias(size), F.col("limit").alias(f"{size}_limit"))
        rows = rows.join(limits, ["origin", "source", size], "left")
    # other sources whose texts stop with the same words are near-copies that say complete
    alike = open_rows.select("spoken", F.xxhash64("origin", "source").alias("from")).distinct().groupBy("spoken").agg(F.count(F.lit(1)).alias("sources"))
    rows = rows.join(alike, "spoken", "left")
    more = F.coalesce(F.col("cut"), F.lit(0)) - F.coalesce(F.col("complete"), F.lit(0)) - F.coalesce(F.col("sources"), F.lit(1)) + 1
    # the end of a loop says nothing of a sentence
    score = F.when(F.col("looped"), 0.0).otherwise(F.coalesce("odds", F.lit(0.0))) - F.when(F.col("loose"), LOOSE_WEIGHT).otherwise(0.0)
    score -= F.greatest(F.coalesce("chars_limit", F.lit(0.0)), F.coalesce("bytes_limit", F.lit(0.0)))
    score += F.when(more < 0, COMPLETE_WEIGHT).otherwise(0.0)
    evidence = F.when(F.coalesce("closed", F.lit(True)), F.lit(None)).when(more > 0, F.lit("near_copy")).when(score < CUT_BELOW, F.lit("closing"))
    rows = rows.withColumns({"evidence": evidence, "score": F.when(~F.col("closed") & (more <= 0), score)})
    out = rows.groupBy("origin", "record_key").agg(F.max("source").alias("source"), F.max("evidence").alias("evidence"), F.min("score").alias("score"))
    return out.select("origin", "record_key", "source", F.col("evidence").isNotNull().alias("truncated"), "evidence", "score")


def rates(assessed: DataFrame) -> DataFrame:
    """Records, truncated ones and their share, by origin and source."""
    by = assessed.groupBy("origin", "source").agg(F.count(F.lit(1)).alias("records"), F.count_if("truncated").alias("truncated"))
    return by.withColumn("truncated_share", F.col("truncated") / F.col("records"))
