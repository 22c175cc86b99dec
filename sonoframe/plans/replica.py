"""Queries on the two copies of the run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.operators.replica_diff import compare
from sonoframe.session import table

KEY = ["runId", "modelId", "decoding", "sampleId", "repetition"]
#: The columns of the run record besides its key and ingestedAt; those of floating point.
VALUES = [
    "scoringVersion", "timestampMs", "provider", "speakerId", "category", "language", "domain", "utteranceType", "private", "coldStart",
    "loadMs", "inferenceMs", "audioMs", "rtf", "chunking", "segments", "chunkingMs", "biasing", "postCorrection", "rawText", "threads",
    "peakMemoryMb", "cpuMs", "avgCores", "reference", "text", "wer", "cer", "substitutions", "deletions", "insertions", "referenceWords",
    "critical", "hasCritical", "error",
]
FLOATS = {"rtf", "peakMemoryMb", "avgCores", "wer", "cer"}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = table(spark, sf_dir, "runs"), table(spark, sf_dir, "runs_replica")
    return compare(*sides, keys=KEY, ignore=["ingestedAt"], order="ingestedAt", names=("runs", "replica"))


def p5_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows differ in each field."""
    return p5_found(spark, sf_dir).groupBy("field").agg(F.count(F.lit(1)).alias("n_rows"))


def _sql() -> str:
    key = ", ".join(f'"{c}"' for c in KEY)
    once = "select * from (select *, row_number() over (partition by {k} order by \"ingestedAt\" desc) as nth from {t}) where nth = 1"
    same = lambda c: f'l."{c}" is not distinct from r."{c}"' + (f' or abs(l."{c}" - r."{c}") <= 1e-9' if c in FLOATS else "")
    on = " and ".join(f'l."{c}" is not distinct from r."{c}"' for c in KEY)
    out = ", ".join(f'coalesce(l."{c}", r."{c}") as "{c}"' for c in KEY)
    tests = ", ".join(f"case when not coalesce(({same(c)}), false) then '{c}' end" for c in VALUES)
    return f"""
with l as ({once.format(k=key, t="runs")}), r as ({once.format(k=key, t="runs_replica")}),
both_sides as (
  select {out}, case when r.nth is null then ['only_in_runs'] when l.nth is null then ['only_in_replica'] else [{tests}] end as fields
  from l full outer join r on {on}),
long_form as (select {key}, unnest(fields) as field from both_sides)
select {key}, field from long_form where field is not null"""


def queries() -> dict:
    return {"p5_found": p5_found, "p5_by_field": p5_by_field}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": _sql(), "p5_by_field": f"select field, count(*) as n_rows from ({_sql()}) group by field"}
