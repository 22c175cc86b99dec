"""Exact order statistics of groups of any size.

Values are counted first, combined before the shuffle. Their counts are summed by narrow ranges of values, of which a group has
a bounded number, so that the range of each wanted rank is known; only the values of these ranges are put in order. No group's
values are collected or sorted as a whole.

The quantile definitions differ and are never exchanged. Each names the places, counted from 0, of two of n sorted values, and
how far between them the result lies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values to each power of two.
RANGES = 64


@dataclass(frozen=True)
class Quantile:
    low: Callable[[Column], Column]
    high: Callable[[Column], Column]
    weight: Callable[[Column], Column] = lambda n: F.lit(0.0)


def _at(place: Callable[[Column], Column]) -> Quantile:
    return Quantile(place, place)


def nearest_rank(percent: float) -> Quantile:
    """The value at rank ceil(percent / 100 * n), 1 at least."""
    return _at(lambda n: F.greatest(F.ceil(n * percent / 100.0), F.lit(1)) - 1)


def linear(percent: float) -> Quantile:
    place = lambda n: (n - 1) * percent / 100.0
    return Quantile(lambda n: F.floor(place(n)), lambda n: F.ceil(place(n)), lambda n: place(n) - F.floor(place(n)))


def mid_median() -> Quantile:
    """The middle value, or the mean of both."""
    return Quantile(lambda n: F.floor((n - 1) / 2), lambda n: F.floor(n / 2), lambda n: F.lit(0.5))


def upper_median() -> Quantile:
    """The value at place n // 2."""
    return _at(lambda n: F.floor(n / 2))


def nearest_index(percent: float) -> Quantile:
    """The value at place round-half-even(percent / 100 * (n - 1))."""
    return _at(lambda n: F.bround((n - 1) * (percent / 100)).cast("long"))


def _range(value: Column) -> Column:
    """A whole number that never falls as the value rises."""
    x = value.cast("double")
    size = F.floor((F.log2(F.abs(x)) + 1100) * RANGES)
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, size).otherwise(-size)


def _same(a: str, b: str, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by), F.lit(True))


def order_statistics(df: DataFrame, by: list[str], value: str, wanted: dict[str, Quantile], count: str | None = None) -> DataFrame:
    """(by..., n, a double column for each of ``wanted``), a row for each group that has a value.

    Null values don't count; values that are no numbers must be taken out before. With ``count`` each row stands for so many
    values. Null is a group like any other. An empty table gives an empty result.
    """
    given = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"), (F.col(count) if count else F.lit(1)).cast("long").alias("__n"))
    counted = given.groupBy(*by, "__v").agg(F.sum("__n").alias("__n")).withColumn("__r", _range(F.col("__v")))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    ranges = counted.groupBy(*by, "__r").agg(F.sum("__n").alias("__n"))  # of each group a bounded number
    summed = ranges.withColumns({"__total": F.sum("__n").over(whole), "__below": F.sum("__n").over(whole.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")})
    places = [F.struct(F.lit(2 * i + k).alias("k"), f(F.col("__total")).cast("long").alias("at")) for i, q in enumerate(wanted.values()) for k, f in enumerate((q.low, q.high))]
    inside = lambda p: (p["at"] >= F.col("__below")) & (p["at"] < F.col("__below") + F.col("__n"))
    asked = summed.select(*by, "__r", "__total", "__below", F.explode(F.filter(F.array(*places), inside)).alias("__p"))
    asked = asked.select(*by, "__r", "__total", F.col("__p.k").alias("__k"), (F.col("__p.at") - F.col("__below")).alias("__at"))
    met = counted.alias("a").join(asked.alias("b"), _same("a", "b", [*by, "__r"])).select(*(f"a.{c}" for c in by), "a.__v", "a.__n", "b.__total", "b.__k", "b.__at")
    upto = F.sum("__n").over(Window.partitionBy(*by, "__k").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    reached = met.withColumn("__upto", upto).filter(F.col("__upto") > F.col("__at"))
    found = reached.groupBy(*by).agg(F.max("__total").alias("__total"), *(F.min(F.when(F.col("__k") == k, F.col("__v").cast("double"))).alias(f"__{k}") for k in range(2 * len(wanted))))
    # equal neighbours need no weight, which infinite ones couldn't have
    between = lambda i, q: F.when(F.col(f"__{2 * i}") == F.col(f"__{2 * i + 1}"), F.col(f"__{2 * i}")).otherwise(F.col(f"__{2 * i}") + (F.col(f"__{2 * i + 1}") - F.col(f"__{2 * i}")) * q.weight(F.col("__total")))
    return found.select(*by, F.col("__total").alias("n"), *(between(i, q).alias(name) for i, (name, q) in enumerate(wanted.items())))


def measures_in_rows(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """(by..., measure, value): the measures below one another, without nulls."""
    rows = F.array(*(F.struct(F.lit(name).alias("measure"), c.cast("double").alias("value")) for name, c in measures.items()))
    return df.select(*by, F.explode(F.filter(rows, lambda x: x["value"].isNotNull())).alias("m")).select(*by, "m.measure", "m.value")


def measures_in_columns(statistics: DataFrame, by: list[str], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """The statistics of measures side by side again: columns name (measure, statistic)."""
    return statistics.groupBy(*by).agg(*(F.max(F.when(F.col("measure") == m, F.col(s))).alias(name) for name, (m, s) in columns.items()))
