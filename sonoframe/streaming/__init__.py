"""Structured Streaming over record parts and event times: what batch queries do, a part at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sonoframe import schemas

LATENESS = "1 hour"


def run_records(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Run records as their parts arrive in a folder, with event time ``at``."""
    stream = spark.readStream.schema(schemas.RUN).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return schemas.with_run_defaults(stream).withColumn("at", F.timestamp_millis("timestampMs"))


def running_rates(records: DataFrame) -> DataFrame:
    """Counts and error rates of each configuration so far."""
    ok = F.col("error").isNull() & (F.col("repetition") == 1)
    errors = F.when(ok, F.col("substitutions") + F.col("deletions") + F.col("insertions"))
    return records.groupBy("modelId", "decoding").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("error").isNotNull()).alias("failures"), F.sum(errors).alias("word_errors"), F.sum(F.when(ok, F.col("referenceWords"))).alias("words")
    )


def tumbling(events: DataFrame, at: str, length: str, *by: str, lateness: str = LATENESS) -> DataFrame:
    return events.withWatermark(at, lateness).groupBy(F.window(at, length), *by).agg(F.count(F.lit(1)).alias("n"))


def sliding(events: DataFrame, at: str, length: str, step: str, *by: str, lateness: str = LATENESS) -> DataFrame:
    return events.withWatermark(at, lateness).groupBy(F.window(at, length, step), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, at: str, gap: str, *by: str, lateness: str = LATENESS) -> DataFrame:
    """Runs of events less than ``gap`` apart; unlike sequences.islands, a distance of exactly the gap parts them."""
    return events.withWatermark(at, lateness).groupBy(F.session_window(at, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def deliver_once(records: DataFrame, key: list[str], at: str = "at", lateness: str = LATENESS) -> DataFrame:
    """Records without second deliveries, as far back as the lateness."""
    return records.withWatermark(at, lateness).dropDuplicatesWithinWatermark(key)


def run_available(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Works through all that is there into a table in memory of that name, and ends."""
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def closing(events: DataFrame, at: str, after: str) -> DataFrame:
    """One event of nulls that lies so far behind the last one of a batch table that its arrival closes all windows before it:
    ``after`` is a window's length or a session's gap. An empty table gives none."""
    late = F.max(at) + F.expr(f"interval {LATENESS}") + 2 * F.expr(f"interval {after}")
    others = [F.lit(None).cast(t).alias(c) for c, t in events.dtypes if c != at]
    return events.agg(late.alias(at)).filter(F.col(at).isNotNull()).select(at, *others).select(*events.columns)


def write_available(result: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Works through all that is there into files of that folder, rows as they become final, and ends: for results of any size."""
    query = result.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
