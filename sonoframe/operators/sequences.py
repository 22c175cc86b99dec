"""Operators on ordered rows: islands, unions of intervals, clamps between neighbours, clocks, as-of lookups, multisets.

A key may hold any part of the rows. Where an operator needs a key's order, the rows of a stretch of time (a slot) are worked
on by themselves, and only what a slot hands on to the next is put in order for the whole key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

#: Gaps to a slot of islands, and the length of other slots where none is given (a day of milliseconds).
SLOT_GAPS, SLOT = 64, 86_400_000


def _slot(at: Column, length: float) -> Column:
    return F.floor(at / F.lit(float(length)))


def _same(a: str, b: str, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by))


def _joined_islands(df: DataFrame, by: list[str], max_gap: float) -> DataFrame:
    """(by..., first, last, n): of rows with these columns those at most max_gap apart put together."""
    order = Window.partitionBy(*by).orderBy("first", "last")
    new = F.coalesce((F.col("first") - F.lag("last").over(order) > max_gap).cast("int"), F.lit(1))
    numbered = df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("__island")


def islands(df: DataFrame, key: list[str], at: str, max_gap: float) -> DataFrame:
    """(key..., first, last, n): runs of rows of a key that lie at most max_gap apart.

    Islands are made in slots; only those that reach a slot's edge meet those of other slots.
    """
    length = SLOT_GAPS * max_gap or 1.0
    rows = df.select(*key, F.col(at).alias("first"), F.col(at).alias("last"), F.lit(1).cast("long").alias("n"), _slot(F.col(at), length).alias("__slot"))
    local = _joined_islands(rows, [*key, "__slot"], max_gap)
    inner = (F.col("first") - F.col("__slot") * length > max_gap) & ((F.col("__slot") + 1) * length - F.col("last") > max_gap)
    marked = local.withColumn("__inner", F.coalesce(inner, F.lit(False)))
    edges = _joined_islands(marked.filter("not __inner").drop("__slot", "__inner"), key, max_gap)
    return marked.filter("__inner").drop("__slot", "__inner").unionByName(edges)


def _union_within(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., start, end): the union of the intervals of each group."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    numbered = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def interval_union(df: DataFrame, key: list[str], start: str, end: str, slot: float = SLOT) -> DataFrame:
    """(key..., start, end): the union of a key's intervals; those that touch become one, empty ones count for nothing.

    Intervals are put together by the slot that they start in; only these unions are put in order for the whole key.
    """
    rows = df.filter(F.col(start) < F.col(end)).select(*key, F.col(start).alias("start"), F.col(end).alias("end"), _slot(F.col(start), slot).alias("__slot"))
    return _union_within(_union_within(rows, [*key, "__slot"]).drop("__slot"), key)


def clamped(df: DataFrame, key: list[str], start: str, end: str, pad: int) -> DataFrame:
    """Intervals widened by pad, but not past the middle of the gap to their neighbours."""
    order = Window.partitionBy(*key).orderBy(start, end)
    before, after = F.lag(end).over(order), F.lead(start).over(order)
    middle = lambda a, b: F.floor((a + b) / 2).cast("long")
    low = F.greatest(F.col(start) - pad, F.lit(0), middle(before, F.col(start)))
    high = F.least(F.col(end) + pad, middle(F.col(end), after))
    return df.select(*key, start, end, low.alias("padded_start"), high.alias("padded_end"))


def greedy_groups(df: DataFrame, key: list[str], at: str, limit: float) -> DataFrame:
    """(key..., first, last, n): rows in order, a group ending before the row that would make it longer than limit.

    Each step depends on where the group before it ended. A key's rows are sorted by the shuffle and walked through once; a task
    holds a batch of them and the group that is open. Null places count for nothing.
    """
    kept = [f for f in df.schema.fields if f.name in key]
    kept.sort(key=lambda f: key.index(f.name))
    rows = df.select(*key, F.col(at).cast("double").alias("__at")).filter("__at is not null").repartition(*key).sortWithinPartitions(*key, "__at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, last, n = None, 0.0, 0.0, 0
        schema = None
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(i) for i in range(len(key))), ("first", pa.float64()), ("last", pa.float64()), ("n", pa.int64())])
            closed = []
            for *k, x in zip(*(batch.column(i).to_pylist() for i in range(len(key) + 1))):
                if k == group and x - first <= limit:
                    last, n = x, n + 1
                    continue
                if n:
                    closed.append((*group, first, last, n))
                group, first, last, n = k, x, x, 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in closed], t.type) for i, t in enumerate(schema)], schema=schema)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*group, first, last, n), schema)], schema=schema)

    return rows.mapInArrow(run, StructType(kept).add("first", DoubleType()).add("last", DoubleType()).add("n", LongType()))


def running_clock(df: DataFrame, key: list[str], order: list[str], length: str, pause: str, slot: float = SLOT) -> DataFrame:
    """begin and end of rows that follow one another, each with a pause after it.

    Rows are summed in slots of the first column of ``order``, a number; of a whole key only the slots' sums are put in order.
    """
    placed = df.withColumn("__slot", _slot(F.col(order[0]), slot))
    took = F.col(length) + F.col(pause)
    before = Window.partitionBy(*key, "__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("__begin", F.coalesce(F.sum(took).over(before), F.lit(0)))
    slots = placed.groupBy(*key, "__slot").agg(F.sum(took).alias("__took"))
    earlier = Window.partitionBy(*key).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.withColumn("__offset", F.coalesce(F.sum("__took").over(earlier), F.lit(0))).drop("__took")
    met = within.alias("a").join(offsets.alias("b"), _same("a", "b", [*key, "__slot"]))
    begin = F.col("a.__begin") + F.col("b.__offset")
    return met.select(*(f"a.{c}" for c in df.columns), begin.alias("begin"), (begin + F.col(f"a.{length}")).alias("end"))


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, value: str, slot: float = SLOT) -> DataFrame:
    """left with the value of the last row of right at or before its time; null before the first.

    Both sides of a slot are put in one order and the value carried forward. Rows before the first value of their slot take the
    last one of the slots before; of a whole key only the slots' last values are put in order.
    """
    marks = right.select(*key, F.col(at), F.col(value).alias("__value"), F.lit(0).alias("__side"))
    asks = left.withColumns({"__value": F.lit(None).cast(right.schema[value].dataType), "__side": F.lit(1)})
    both = asks.unionByName(marks, allowMissingColumns=True).withColumn("__slot", _slot(F.col(at), slot))
    order = Window.partitionBy(*key, "__slot").orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__carried", F.last("__value", ignorenulls=True).over(order)).filter("__side = 1")
    slots = both.groupBy(*key, "__slot").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(at))).alias("__last"))
    earlier = Window.partitionBy(*key).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    handed = slots.withColumn("__handed", F.last("__last", ignorenulls=True).over(earlier)).filter("__handed is not null").drop("__last")
    own = carried.filter("__carried is not null").select(*left.columns, F.col("__carried").alias(value))
    met = carried.filter("__carried is null").alias("a").join(handed.alias("b"), _same("a", "b", [*key, "__slot"]), "left")
    return own.unionByName(met.select(*(f"a.{c}" for c in left.columns), F.col("b.__handed").alias(value)))


def multiset_difference(left: DataFrame, right: DataFrame, key: list[str], item: str) -> DataFrame:
    """(key..., item, only_left, only_right): how many more of an item one side has."""
    counted = lambda df, n: df.groupBy(*key, item).agg(F.count(F.lit(1)).alias(n))
    both = counted(left, "l").join(counted(right, "r"), [*key, item], "full_outer").na.fill(0, ["l", "r"])
    more = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    return both.filter("l != r").select(*key, item, more("l", "r").alias("only_left"), more("r", "l").alias("only_right"))


def looked_up(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """df with the columns of its key's row in ``known``; a key that isn't known, also null, stops the job and is named."""
    met = df.join(known.withColumn("__known", F.lit(True)), key, "left")
    checked = F.when(F.col("__known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return met.withColumn(key, checked).drop("__known")
