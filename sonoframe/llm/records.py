"""The texts that problems 2 and 3 are about, in one shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_records(transcripts: DataFrame, samples: DataFrame) -> DataFrame:
    """(origin, record_key, source, language, text, day) of transcribe_results and samples; nulls stay, repeated rows too. The day
    is that on which a result was captured, null for samples."""
    first = transcripts.select(
        F.lit("transcribe_results").alias("origin"), F.col("result_id").cast("string").alias("record_key"), F.col("provider_id").alias("source"), "language", "text", F.to_date("captured_at").alias("day")
    )
    second = samples.select(F.lit("samples").alias("origin"), F.col("id").alias("record_key"), F.col("source.kind").alias("source"), "language", F.col("reference").alias("text"), F.lit(None).cast("date").alias("day"))
    return first.unionByName(second)
