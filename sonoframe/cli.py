"""Data jobs on run folders and datasets: python -m sonoframe.cli VERB ... (each prints or writes one table)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe import sources
from sonoframe.functions import text as T
from sonoframe.operators import aggregates as A
from sonoframe.operators import termstudy as K
from sonoframe.operators import validation as V
from sonoframe.sources import sinks

PAIR_KEY = ["modelId", "decoding", "sampleId", "repetition"]


def _pairs(spark: SparkSession, o) -> DataFrame:
    return A.pairs_of_runs(sources.runs(spark, o.path), sources.runs(spark, o.against), PAIR_KEY, ["timestampMs", "runId"])


def check(spark, o):
    return V.sample_issues(sources.samples(spark, o.path))


def summarize(spark, o):
    return A.summarize(sources.runs(spark, o.path))


def rescore(spark, o):
    scored = K.rescored(sources.runs(spark, o.path), sources.samples(spark, o.dataset))
    if o.out:
        sinks.write_rescored(scored, o.out, o.version)
    return A.summarize(scored)


def postcorrect(spark, o):
    terms = [r["text"] for r in sinks.bounded_rows(sources.vocabulary(spark, o.vocabulary).orderBy("line"))]
    done = sources.runs(spark, o.path).withColumn("c", T.post_correct("text", terms, o.preset))
    log = done.select(F.col("modelId").alias("model"), "decoding", F.col("sampleId").alias("sample"), F.col("c.changes").alias("changes"))
    if o.out:
        sinks.change_log(log, o.out)
    return log.filter(F.size("changes") > 0)


def termstudy(spark, o):
    return K.word_deltas(_pairs(spark, o), sources.samples(spark, o.dataset)) if o.against else K.key_term_summary(sources.runs(spark, o.path), sources.samples(spark, o.dataset))


def bootstrap(spark, o):
    return K.bootstrap(sources.runs(spark, o.path), o.resamples, o.seed)


def compare(spark, o):
    pairs = _pairs(spark, o)
    return A.determinism(pairs).join(A.speed_changes(pairs), A.CONFIG)


def timing(spark, o):
    return A.timing_study(sources.runs(spark, o.path))


def chunking_study(spark, o):
    both = sources.runs(spark, o.path).withColumn("mode", F.lit("whole")).unionByName(sources.runs(spark, o.against).withColumn("mode", F.lit("chunked")))
    return K.chunking_study(both.filter(A.first_repetition()))


def tts_summary(spark, o):
    return sinks.measure_summary(sources.tts_measures(spark, o.path))


def tts_overhead(spark, o):
    return sinks.mode_overhead(sources.tts_measures(spark, o.path), o.whole, o.pieces)


def plan_sentences(spark, o):
    lines = spark.read.text(o.path, wholetext=True)
    return lines.select(F.posexplode(T.plan_sentences("value", F.lit(o.language))).alias("place", "s")).select("place", "s.*")


VERBS = {f.__name__.replace("_", "-"): f for f in (check, summarize, rescore, postcorrect, termstudy, bootstrap, compare, timing, chunking_study, tts_summary, tts_overhead, plan_sentences)}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("path")
    for name in ("against", "dataset", "vocabulary", "out"):
        p.add_argument(f"--{name}", default="")
    p.add_argument("--preset", default="strict", choices=("strict", "medium", "loose"))
    p.add_argument("--language", default="fr")
    p.add_argument("--whole", default="whole")
    p.add_argument("--pieces", default="pieces")
    for name, value in (("version", 2), ("resamples", 5000), ("seed", 7)):
        p.add_argument(f"--{name}", type=int, default=value)
    options = p.parse_args(args)
    spark = SparkSession.builder.appName(f"sonoframe {options.verb}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    VERBS[options.verb](spark, options).show(1000, truncate=False)


if __name__ == "__main__":
    main()
