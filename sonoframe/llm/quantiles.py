"""Problem 4: percentiles of very large numeric columns from dyadic Count-sketches.

A value is encoded as a whole number of CODE_BITS bits that keeps the order: the sign, exponent and first MANTISSA_BITS of
its 64-bit floating-point form. For each binary resolution there is one signed sketch of the codes' prefixes: exact counters
where a level has no more prefixes than a sketch has cells, else DEPTH rows of WIDTH cells, in each of which a prefix adds
its sign to one cell. All cells are plain sums, so that the sketches of days, runs or partitions are added cell by cell, and
a deletion adds -1. A percentile descends the levels from the coarsest, going right past a left child whose estimated count
is smaller than the rank that is left.

A group of few distinct codes is kept as these codes and their counts, which add up in the same way, until a percentile is
asked for; the sketch is then made of them.

Error: a decoded value is within 2 ** -(MANTISSA_BITS + 1) of a value of its code, relatively. A level's estimate of n values
is off by about sqrt(F2 / WIDTH) (F2: the sum of squared counts of that level's prefixes) with a probability that falls
exponentially in DEPTH; with the counters of the first levels exact, ranks were off by less than 1 % in all tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from sonoframe.session import shuffle_partitions

MANTISSA_BITS = 8
CODE_BITS = 12 + MANTISSA_BITS
DEPTH, WIDTH = 5, 4096
PERCENTILES = (5, 25, 50, 75, 90, 95, 99)
#: Distinct codes of a group up to which a task hands on codes (as cells below zero) instead of a sketch.
SPARSE = 512
#: Distinct codes that a task holds before it hands on what it has.
HELD_CODES = 400_000

_SHIFT = 52 - MANTISSA_BITS
_EXACT = WIDTH.bit_length() - 1
#: Cells of the exact levels lie first, level l at 2 ** l - 1; those of each sketched level follow.
_EXACT_CELLS = (1 << (_EXACT + 1)) - 1
CELLS = _EXACT_CELLS + (CODE_BITS - _EXACT) * DEPTH * WIDTH


def encode(values: np.ndarray) -> np.ndarray:
    """Order-preserving codes of finite and infinite numbers; -0.0 counts as 0.0."""
    bits = (values.astype(np.float64) + 0.0).view(np.int64)
    ordered = np.where(bits < 0, ~bits, bits | np.int64(-(1 << 63))).view(np.uint64)
    return (ordered >> np.uint64(_SHIFT)).astype(np.int64)


def decode(code: int) -> float:
    """The middle of the values of a code."""
    ordered = (code << _SHIFT) + (1 << (_SHIFT - 1))
    bits = ordered ^ (1 << 63) if ordered >> 63 else ~ordered & ((1 << 64) - 1)
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def _place(level: int, prefix: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and sign of the prefixes of a sketched level in one row."""
    x = prefix.astype(np.uint64) + np.uint64((level << 32) + (row << 48) + 1)
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    cell = _EXACT_CELLS + ((level - _EXACT - 1) * DEPTH + row) * WIDTH + (x % np.uint64(WIDTH)).astype(np.int64)
    return cell, np.where(x >> np.uint64(63), 1, -1).astype(np.int64)


def add(sketch: np.ndarray, values: np.ndarray, counts: np.ndarray | int = 1) -> None:
    """Adds the values to a sketch of CELLS cells; a count of -1 takes one out again."""
    add_codes(sketch, *_counted(encode(values), np.broadcast_to(counts, np.shape(values))))


def _counted(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)


def add_codes(sketch: np.ndarray, codes: np.ndarray, n: np.ndarray) -> None:
    for level in range(CODE_BITS + 1):
        prefix = codes >> (CODE_BITS - level)
        if level <= _EXACT:
            np.add.at(sketch, (1 << level) - 1 + prefix, n)
            continue
        for row in range(DEPTH):
            cell, sign = _place(level, prefix, row)
            np.add.at(sketch, cell, sign * n)


def from_cells(cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sketch of a group's rows: cells, and codes (cell -1 - code)."""
    sketch = np.zeros(CELLS, dtype=np.int64)
    dense = cell >= 0
    np.add.at(sketch, cell[dense], n[dense])
    if not dense.all():
        add_codes(sketch, -1 - cell[~dense].astype(np.int64), n[~dense])
    return sketch


def estimate(sketch: np.ndarray, level: int, prefix: np.ndarray) -> np.ndarray:
    """Estimated counts of prefixes of a level."""
    if level <= _EXACT:
        return sketch[(1 << level) - 1 + prefix].astype(float)
    found = [sketch[cell] * sign for cell, sign in (_place(level, prefix, row) for row in range(DEPTH))]
    return np.median(np.stack(found), axis=0)


def quantiles(sketch: np.ndarray, parts: list[float]) -> list[float | None]:
    """The values at ranks part * (n - 1); None where nothing was counted."""
    n = int(sketch[0])
    if n <= 0:
        return [None] * len(parts)
    rank = np.array(parts) * (n - 1)
    prefix, above = np.zeros(len(parts), dtype=np.int64), np.full(len(parts), float(n))
    for level in range(1, CODE_BITS + 1):
        left = np.clip(estimate(sketch, level, 2 * prefix), 0.0, above)
        if level > _EXACT:
            # what the children's estimates differ from their parent's is shared between them
            right = np.maximum(estimate(sketch, level, 2 * prefix + 1), 0.0)
            both = left + right
            left = np.where(both > 0, above * left / np.where(both > 0, both, 1.0), above / 2)
        go_left = rank < left
        prefix = 2 * prefix + ~go_left
        rank = np.where(go_left, rank, rank - left)
        above = np.where(go_left, left, above - left)
    return [decode(int(p)) for p in prefix]


def sketches(values: DataFrame, by: list[str], value: str = "value", count: str | None = None) -> DataFrame:
    """(by..., cell, n): the sketches of each group, made where the rows are read and added up cell by cell.

    Null and not-a-number values don't count. ``count`` names a column of +1 and -1 (or other weights).
    """
    kept = [f for f in values.schema.fields if f.name in by]
    kept.sort(key=lambda f: by.index(f.name))
    usable = values.select(*by, F.col(value).cast("double").alias("__value"), (F.col(count) if count else F.lit(1)).cast("long").alias("__count")).filter("__value is not null and not isnan(__value)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        waiting = 0
        schema = pa.schema([*shape, ("cell", pa.int32()), ("n", pa.int64())])

        def hand_on() -> Iterator[pa.RecordBatch]:
            keys, cells, counts = [], [], []
            for key, (codes, n) in held.items():
                if len(codes) > SPARSE:
                    sketch = np.zeros(CELLS, dtype=np.int64)
                    add_codes(sketch, codes, n)
                    codes = np.flatnonzero(sketch)
                    n = sketch[codes]
                else:
                    codes = -1 - codes
                keys += [key] * len(codes)
                cells.append(codes)
                counts.append(n)
            if keys:
                columns = [pa.array([k[i] for k in keys], t.type) for i, t in zip(range(len(by)), schema)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(counts))], schema=schema)
            held.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))))) if by else [()] * len(batch)
            numbers: dict[tuple, int] = {}
            group = np.fromiter((numbers.setdefault(k, len(numbers)) for k in keys), dtype=np.int64, count=len(keys))
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(len(numbers) + 1))
            codes, weights = encode(batch.column(len(by)).to_numpy()[order]), batch.column(len(by) + 1).to_numpy()[order]
            for key, i, j in zip(numbers, cuts, cuts[1:]):
                mine = _counted(codes[i:j], weights[i:j])
                if key in held:
                    waiting -= len(held[key][0])
                    mine = _counted(*(np.concatenate(x) for x in zip(held[key], mine)))
                held[key] = mine
                waiting += len(mine[0])
            if waiting > HELD_CODES:
                yield from hand_on()
                waiting = 0
        yield from hand_on()

    shape = [(f.name, to_arrow_type(f.dataType)) for f in kept]
    out = StructType(kept).add("cell", IntegerType()).add("n", LongType())
    return add_sketches(usable.mapInArrow(run, out), by)


def add_sketches(cells: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of days, runs or partitions added up to those of ``by``."""
    return cells.groupBy(*by, "cell").agg(F.sum("n").alias("n")).filter("n != 0")


def rank_error(sketch: np.ndarray) -> float:
    """Twice the standard error of a rank, as a part of n: the estimates of all sketched levels on the way add to it.

    The sum of a row's squared cells estimates the sum of the squared counts of its level, F2; a cell's standard error is
    sqrt(F2 / WIDTH). The median of DEPTH rows is better than one row; that isn't counted on.
    """
    n = int(sketch[0])
    rows = sketch[_EXACT_CELLS:].reshape(CODE_BITS - _EXACT, DEPTH, WIDTH).astype(float)
    second = np.median((rows * rows).sum(axis=2), axis=1)
    return 2.0 * float(np.sqrt(second.sum() / WIDTH)) / n if n > 0 else 0.0


def exact_quantiles(codes: np.ndarray, n: np.ndarray, parts: list[float]) -> list[float | None]:
    """quantiles() of codes and their counts."""
    order = np.argsort(codes)
    below = np.cumsum(n[order])
    if not len(below) or below[-1] <= 0:
        return [None] * len(parts)
    at = np.searchsorted(below, np.floor(np.array(parts) * (below[-1] - 1)), side="right")
    return [decode(int(c)) for c in codes[order][at]]


def percentiles(cells: DataFrame, by: list[str], wanted: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(by..., n, p5, ..., rank_error): percentiles of each group of a sketch table.

    pP is the value at rank floor(P / 100 * (n - 1)), counted from 0, of the sorted values, to within 2 ** -(MANTISSA_BITS + 1)
    relatively; its rank may be off by about rank_error * n, which is 0 for groups that are kept as codes. A group has at most
    CELLS + 2 ** CODE_BITS rows, whatever it counts; they are read as two arrays.
    """
    packed = cells.groupBy(*by).agg(F.collect_list(F.struct("cell", "n")).alias("cells")).select(*by, "cells.cell", "cells.n")
    parts = [p / 100 for p in wanted]
    kept = [f for f in packed.schema.fields if f.name in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n = batch.column(len(by)), batch.column(len(by) + 1)
            ends = cell.offsets.to_numpy()
            cell, n = cell.values.to_numpy(zero_copy_only=False).astype(np.int64), n.values.to_numpy(zero_copy_only=False)
            rows = []
            for i, j in zip(ends, ends[1:]):
                c, k = cell[i:j], n[i:j]
                if (c < 0).all():
                    rows.append([int(k.sum()), *exact_quantiles(-1 - c, k, parts), 0.0])
                else:
                    sketch = from_cells(c, k)
                    rows.append([int(sketch[0]), *quantiles(sketch, parts), rank_error(sketch)])
            columns = [pa.array([r[x] for r in rows], pa.int64() if x == 0 else pa.float64()) for x in range(len(parts) + 2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(by))), *columns], [*by, "n", *(f"p{p}" for p in wanted), "rank_error"])

    out = StructType(kept).add("n", LongType())
    for name in (*(f"p{p}" for p in wanted), "rank_error"):
        out = out.add(name, DoubleType())
    return packed.mapInArrow(run, out).filter("n > 0")


def deliveries_once(runs: DataFrame, key: list[str], values: list[str], by: list[str]) -> DataFrame:
    """One row (by..., values...) per key: of repeated deliveries, whose content is the same, the largest values count.

    The rows of a group (``by``, a part of the key) go to an eighth of all partitions: the largest group is spread, and a
    partition has few groups to make sketches of. Repeated rows are found there without a second shuffle.
    """
    spread = [x for c in key for x in (F.col(c), F.col(c).isNull())]
    salts = max(1, shuffle_partitions(runs.sparkSession) // 8)
    hashed = runs.select(*by, *(c for c in values if c not in by), F.xxhash64(*spread).alias("__a"), F.xxhash64(F.lit(3), *spread[::-1]).alias("__b"))
    placed = hashed.withColumn("__salt", F.pmod("__a", F.lit(salts))).repartition(*by, "__salt")
    return placed.groupBy(*by, "__salt", "__a", "__b").agg(*(F.max(c).alias(c) for c in values)).drop("__salt", "__a", "__b")


def long_form(runs: DataFrame, metrics: list[str], *kept: Column | str) -> DataFrame:
    """(kept..., metric, value)."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return runs.select(*kept, F.explode(pairs).alias("p")).select("*", "p.metric", "p.value").drop("p")
