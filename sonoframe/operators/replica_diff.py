"""Problem 5: differences between two copies of a table, field by field.

Each side is summed up on its own in an invertible Bloom lookup table: every row (hash of its key, hash of its values) is
added to three cells of its bucket. The tables of the two sides are subtracted cell by cell, so that equal rows vanish
whatever their order, and what is left is peeled: a cell that holds a single row names it, and taking it out of its other
cells lays bare more. Only the rows named so are fetched from the two copies and compared field by field.

A bucket with more differences than its cells can hold stays unpeeled; its rows are then compared hash by hash, so that
nothing is lost however much the copies differ.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.session import BROADCAST_LIMIT_BYTES, cut_lineage, shuffle_partitions

#: Rows of a bucket on average, and cells in each of a bucket's three tables. About 300 differences of 2048 rows peel.
BUCKET_ROWS, CELLS = 2048, 128
FLOAT_TOLERANCE = 1e-9
#: Cells peeled by one task at a time.
SHARD_CELLS = 400_000

_M = (1 << 64) - 1
#: The primes of the public 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhash64_of_longs(*columns: np.ndarray) -> np.ndarray:
    """What the SQL function xxhash64 gives for columns of 64-bit integers without nulls."""
    seed = np.full(len(columns[0]), 42, dtype=np.uint64)
    for column in columns:
        h = seed + np.uint64((_P5 + 8) & _M)
        h ^= _rotate(column.astype(np.int64).view(np.uint64) * np.uint64(_P2), 31) * np.uint64(_P1)
        h = _rotate(h, 27) * np.uint64(_P1) + np.uint64(_P4)
        h ^= h >> np.uint64(33)
        h *= np.uint64(_P2)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_P3)
        seed = h ^ (h >> np.uint64(32))
    return seed.view(np.int64)


def _hash(names: list[str], types: dict[str, T.DataType], *salt: Column) -> Column:
    """A hash in which null, empty and their neighbours' values stay apart."""
    parts = []
    for n in names:
        c = F.col(f"`{n}`")
        parts += [F.to_json(c) if isinstance(types[n], (T.ArrayType, T.StructType, T.MapType)) else c, c.isNull()]
    return F.xxhash64(*salt, *parts)


def _hashed(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({"__k1": _hash(keys, types), "__k2": _hash(keys[::-1], types, F.lit(7)), "__v": _hash(values, types)})


def _entries(hashed: DataFrame, sign: int) -> DataFrame:
    """One row per key. Deliveries of different content give a value of their own, so that the fields decide."""
    once = hashed.groupBy("__k1", "__k2").agg(F.min("__v").alias("low"), F.max("__v").alias("high"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.xxhash64("low", "high", F.lit(sign)))
    return once.select("__k1", "__k2", value.alias("__v"), F.lit(sign).alias("sign"))


def _bucket(buckets: int) -> Column:
    """The same hash as that of the shuffle before, so that one task's rows fall into few buckets."""
    return F.pmod(F.hash("__k1", "__k2"), F.lit(buckets))


def sketch(entries: DataFrame, buckets: int, cells: int = CELLS) -> DataFrame:
    """The lookup table of one side: (cell, n, k1, k2, v, check). Sketches of parts add up to that of the whole."""
    checked = entries.withColumn("check", F.xxhash64("__k1", "__k2", "__v")).withColumn("bucket", _bucket(buckets).cast("long"))
    places = F.array(*(F.col("bucket") * (3 * cells) + i * cells + F.pmod(F.shiftrightunsigned("check", 20 * i), F.lit(cells)) for i in range(3)))
    spread = checked.select(F.explode(places).alias("cell"), "sign", "__k1", "__k2", "__v", "check")
    return _sum_cells(spread, "sign", "__k1", "__k2", "__v")


def _sum_cells(df: DataFrame, n: str, k1: str, k2: str, v: str) -> DataFrame:
    x = F.bit_xor
    return df.groupBy("cell").agg(F.sum(n).alias("n"), x(k1).alias("k1"), x(k2).alias("k2"), x(v).alias("v"), x("check").alias("check"))


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """The difference of two sketches, of which the right one was made with sign -1; only cells that hold something."""
    return _sum_cells(left.unionByName(right), "n", "k1", "k2", "v").filter("n != 0 or k1 != 0 or k2 != 0 or v != 0 or check != 0")


def peel(difference: DataFrame, cells: int, shards: int) -> DataFrame:
    """(k1, k2, sign) of the rows named by the cells; bucket is set instead where something couldn't be taken apart."""

    def run(table: pa.Table) -> pa.Table:
        cell = table.column("cell").to_numpy()
        order = np.argsort(cell)
        cell = cell[order]
        n, k1, k2, v, check = (table.column(c).to_numpy()[order].copy() for c in ("n", "k1", "k2", "v", "check"))
        named: list[tuple] = []
        look = np.arange(len(cell))
        while len(look):
            pure = look[np.abs(n[look]) == 1]
            pure = pure[xxhash64_of_longs(k1[pure], k2[pure], v[pure]) == check[pure]]
            if not len(pure):
                break
            _, first = np.unique(np.stack([k1[pure], k2[pure], v[pure]], axis=1), axis=0, return_index=True)
            pure = pure[first]
            row = n[pure].copy(), k1[pure].copy(), k2[pure].copy(), v[pure].copy(), check[pure].copy()
            named.append(row)
            bucket = cell[pure] // (3 * cells)
            unsigned = row[4].view(np.uint64)
            touched = []
            for i in range(3):
                # pmod of a value that is negative only where nothing was shifted out
                shifted = row[4] if i == 0 else (unsigned >> np.uint64(20 * i)).view(np.int64)
                at = np.searchsorted(cell, bucket * (3 * cells) + i * cells + shifted % cells)
                np.subtract.at(n, at, row[0])
                for column, gone in zip((k1, k2, v, check), row[1:]):
                    np.bitwise_xor.at(column, at, gone)
                touched.append(at)
            look = np.unique(np.concatenate(touched))
        rest = np.unique(cell[(n != 0) | (k1 != 0) | (k2 != 0) | (v != 0) | (check != 0)] // (3 * cells))
        signs, a, b = (np.concatenate([r[i] for r in named]) if named else np.zeros(0, np.int64) for i in range(3))
        none = [None] * len(rest)
        return pa.table({
            "k1": pa.concat_arrays([pa.array(a, pa.int64()), pa.array(none, pa.int64())]),
            "k2": pa.concat_arrays([pa.array(b, pa.int64()), pa.array(none, pa.int64())]),
            "sign": pa.concat_arrays([pa.array(signs, pa.int64()), pa.array(none, pa.int64())]),
            "bucket": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(rest, pa.int64())]),
        })

    shard = F.pmod(F.expr(f"cell div {3 * cells}"), F.lit(shards))
    return difference.groupBy(shard.alias("shard")).applyInArrow(run, "k1 long, k2 long, sign long, bucket long")


def differing_keys(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], cells: int = CELLS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(__k1, __k2): hashes of the keys whose rows aren't the same on both sides, written and read again."""
    spark = left.sparkSession
    parts = shuffle_partitions(spark)
    rows = max(left.select(F.count(F.lit(1))).first()[0], right.select(F.count(F.lit(1))).first()[0])
    buckets = parts * max(1, math.ceil(rows / bucket_rows / parts))
    sides = [_entries(_hashed(df, keys, values), sign) for df, sign in ((left, 1), (right, -1))]
    difference = subtract(*(sketch(side, buckets, cells) for side in sides))
    shards = max(parts, math.ceil(buckets * 3 * cells / SHARD_CELLS))
    named = cut_lineage(peel(difference, cells, shards))
    found = named.filter("bucket is null").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    unpeeled = named.filter("bucket is not null").select("bucket").distinct()
    if unpeeled.limit(1).count():
        both = sides[0].unionByName(sides[1]).withColumn("bucket", _bucket(buckets).cast("long"))
        rest = both.join(unpeeled, "bucket", "left_semi").groupBy("__k1", "__k2", "__v").agg(F.sum("sign").alias("n")).filter("n != 0")
        found = found.unionByName(rest.select("__k1", "__k2"))
    return cut_lineage(found.distinct())


def _same(a: Column, b: Column, kind: T.DataType, tolerance: float) -> Column:
    equal = a.eqNullSafe(b)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        equal = equal | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    return equal


def compare(left: DataFrame, right: DataFrame, keys: list[str], ignore: list[str] = (), order: str | None = None, names: tuple[str, str] = ("left", "right"), tolerance: float = FLOAT_TOLERANCE, **sizes: int) -> DataFrame:
    """One row ``keys, field`` per difference of two copies.

    ``field`` is ``only_in_<name>`` for keys of one side, else a column whose values differ. Columns that only one side has
    aren't compared. Nulls equal nulls only, also in keys; not-a-number equals itself; floating-point numbers are equal
    within ``tolerance``; strings, arrays and structs are compared exactly. Of a key's several deliveries the one with
    the largest ``order`` counts (of several such, the one with the largest hash). Empty tables are valid on either side.
    """
    shared = [c for c in left.columns if c in set(right.columns)]
    values = [c for c in shared if c not in {*keys, *ignore}]
    keyset = differing_keys(left, right, keys, values, **sizes)
    if 64 * keyset.count() <= BROADCAST_LIMIT_BYTES // 2:
        keyset = F.broadcast(keyset)
    types = {f.name: f.dataType for f in left.schema.fields}

    def fetch(df: DataFrame, side: str) -> DataFrame:
        rows = _hashed(df, keys, values).join(keyset, ["__k1", "__k2"], "left_semi")
        content = F.struct(*(F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate([*keys, *values])))
        latest = F.struct(F.col(f"`{order}`") if order else F.lit(0).alias("o"), F.col("__v").alias("v"))
        return rows.groupBy("__k1", "__k2").agg(F.max_by(content, latest).alias(side))

    both = fetch(left, "l").join(fetch(right, "r"), ["__k1", "__k2"], "full_outer")
    k = len(keys)
    fields = [F.when(F.col("l").isNull(), F.lit(f"only_in_{names[1]}")), F.when(F.col("r").isNull(), F.lit(f"only_in_{names[0]}"))]
    there = F.col("l").isNotNull() & F.col("r").isNotNull()
    fields += [F.when(there & ~_same(F.col(f"l.f{k + i}"), F.col(f"r.f{k + i}"), types[c], tolerance), F.lit(c)) for i, c in enumerate(values)]
    key = F.coalesce("l", "r")
    out = both.select(*(key[f"f{i}"].alias(f"k{i}") for i in range(k)), F.explode(F.filter(F.array(*fields), lambda x: x.isNotNull())).alias("field"))
    return out.toDF(*keys, "field")
