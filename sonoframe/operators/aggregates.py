"""Aggregation of run records: summaries, the quantile definitions, comparisons of runs and repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.operators import ranks as R

CONFIG = ["modelId", "decoding"]
RUN_KEY = ["runId", "modelId", "decoding", "sampleId", "repetition"]


def number(column: str | Column) -> Column:
    """The value, or null where it is not a number."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def succeeded() -> Column:
    return F.col("error").isNull()


def first_repetition() -> Column:
    return succeeded() & (F.col("repetition") == 1)


def word_errors() -> Column:
    return F.col("substitutions") + F.col("deletions") + F.col("insertions")


def when(condition: Column, value: str | Column) -> Column:
    return F.when(condition, F.col(value) if isinstance(value, str) else value)


def latest_deliveries(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the one that comes last in the given order."""
    last = df.groupBy(*key).agg(F.max_by(F.struct(*(c for c in df.columns if c not in key)), F.struct(*order)).alias("__last"))
    return last.select(*key, "__last.*").select(*df.columns)


def summarize(runs: DataFrame) -> DataFrame:
    """One row per configuration and category, and one per configuration with group ALL.

    Accuracy counts the first repetition of successful runs, timing all successful repetitions. Samples are reduced
    before the grouping sets, so that only one row a sample and configuration is expanded.
    """
    ok, first = succeeded(), first_repetition()
    by_sample = runs.groupBy(*CONFIG, "category", "sampleId").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~ok).alias("failures"), F.count_if(ok).alias("good"), F.sum(when(first, word_errors())).alias("errors"),
        F.sum(when(first, "referenceWords")).alias("words"), F.sum(when(first, "wer")).alias("wer_sum"), F.count(when(first, "wer")).alias("wer_n"),
        F.sum(when(first, "cer")).alias("cer_sum"), F.count(when(first, "cer")).alias("cer_n"), F.count_if(first & (F.col("wer") >= 1)).alias("runaway"),
        F.max(when(first, "hasCritical")).alias("flagged"), F.count_if(first & F.col("hasCritical")).alias("critical"), F.sum(when(first, F.size("critical"))).alias("flags"), F.min(when(ok, "text")).alias("low"), F.max(when(ok, "text")).alias("high"),
        F.max(when(ok, "peakMemoryMb")).alias("peak"),
    )
    rate = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double"))
    sets = [[F.col(c) for c in CONFIG], [F.col(c) for c in (*CONFIG, "category")]]
    group = F.when(F.grouping("category") == 1, F.lit("ALL")).otherwise(F.col("category")).alias("group")
    # samples may stand in several categories; within one configuration they are told apart by name
    counts = by_sample.groupingSets(sets, *CONFIG, "category").agg(
        group, F.count_distinct(when(F.col("good") > 0, "sampleId")).alias("samples"), F.sum("runs").alias("runs"), F.sum("failures").alias("failures"),
        rate("errors", "words").alias("wer_micro"), rate("wer_sum", "wer_n").alias("wer_macro"), rate("cer_sum", "cer_n").alias("cer_macro"),
        F.sum("runaway").alias("runaway_outputs"), F.sum("critical").alias("samples_with_critical"), F.coalesce(F.sum("flags"), F.lit(0)).alias("critical_flags"),
        F.count_if(F.col("low") != F.col("high")).alias("unstable_samples"), F.max("peak").alias("peak_memory_mb_max"),
    ).drop("category")
    measures = {"rtf": number("rtf"), "inferenceMs": F.col("inferenceMs"), "load": when(F.col("coldStart"), "loadMs"), "avgCores": number("avgCores")}
    values = R.measures_in_rows(runs.filter(ok), [*CONFIG, "category"], measures)
    each = values.groupBy(*CONFIG, F.col("category").alias("group"), "measure", "value").agg(F.count(F.lit(1)).alias("times"))
    every = each.groupBy(*CONFIG, "measure", "value").agg(F.sum("times").alias("times")).withColumn("group", F.lit("ALL"))
    keys = [*CONFIG, "group"]
    ranked = R.order_statistics(each.unionByName(every), [*keys, "measure"], "value", {"p50": R.nearest_rank(50), "p95": R.nearest_rank(95)}, count="times")
    columns = {"rtf_median": ("rtf", "p50"), "inference_ms_median": ("inferenceMs", "p50"), "inference_ms_p95": ("inferenceMs", "p95"), "load_ms_cold_median": ("load", "p50"), "avg_cores_median": ("avgCores", "p50")}
    times = R.measures_in_columns(ranked, keys, columns)
    times = times.withColumns({c: F.col(c).cast("long") for c in columns if "_ms_" in c})
    return counts.alias("c").join(times.alias("t"), [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], "left").select("c.*", *(f"t.{c}" for c in times.columns if c not in keys))


def flags_by_kind(runs: DataFrame) -> DataFrame:
    """Flags of first repetitions by configuration and kind."""
    return runs.filter(first_repetition()).select(*CONFIG, F.explode("critical").alias("flag")).groupBy(*CONFIG, F.col("flag.kind").alias("kind")).agg(F.count(F.lit(1)).alias("flags"))


def unstable_samples(runs: DataFrame) -> DataFrame:
    """Samples whose successful texts aren't all equal."""
    texts = runs.filter(succeeded()).groupBy(*CONFIG, "sampleId").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.count(F.lit(1)).alias("runs"))
    return texts.filter("low != high").select(*CONFIG, "sampleId", "runs")


def hard_samples(runs: DataFrame, least: float = 0.25) -> DataFrame:
    """Samples whose median rate over configurations is high, and the configuration whose text was best."""
    first = runs.filter(first_repetition() & F.col("wer").isNotNull())
    medians = R.order_statistics(first, ["sampleId"], "wer", {"wer_median": R.nearest_rank(50)}).filter(F.col("wer_median") >= least)
    best = first.groupBy("sampleId").agg(F.min(F.struct("wer", *CONFIG, "runId", "text")).alias("best"))
    return medians.withColumnRenamed("n", "outputs").join(best, "sampleId").select("sampleId", "wer_median", "outputs", F.col("best.wer").alias("best_wer"), F.col("best.modelId").alias("best_model"), F.col("best.text").alias("best_text"))


def timing_study(runs: DataFrame) -> DataFrame:
    """Per configuration: spread of times, and how much a sample's repetitions vary (coefficient of variation)."""
    ok = runs.filter(succeeded())
    by_sample = ok.groupBy(*CONFIG, "sampleId").agg(F.count(F.lit(1)).alias("n"), F.avg("inferenceMs").alias("mean"), F.stddev_pop("inferenceMs").alias("dev"))
    cv = by_sample.filter("n >= 2 and mean > 0").withColumn("cv", 100 * F.col("dev") / F.col("mean"))
    most = cv.groupBy(*CONFIG).agg(F.max("cv").alias("cv_max"))
    measures = R.measures_in_rows(ok, CONFIG, {"ms": F.col("inferenceMs"), "rtf": number("rtf"), "load": when(F.col("loadMs") > 0, "loadMs")})
    measures = measures.unionByName(cv.select(*CONFIG, F.lit("cv").alias("measure"), F.col("cv").alias("value")))
    ranked = R.order_statistics(measures, [*CONFIG, "measure"], "value", {"p50": R.mid_median(), "p95": R.linear(95)})
    columns = {"ms_median": ("ms", "p50"), "ms_p95": ("ms", "p95"), "rtf_median": ("rtf", "p50"), "load_median": ("load", "p50"), "cv_median": ("cv", "p50")}
    t = F.col("inferenceMs")
    times = ok.groupBy(*CONFIG).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("ms_min"), F.max(t).alias("ms_max"))
    out = times.join(R.measures_in_columns(ranked, CONFIG, columns), CONFIG, "left").join(most, CONFIG, "left")
    return out.select(*CONFIG, "n", "ms_median", "ms_p95", "ms_min", "ms_max", "rtf_median", "load_median", "cv_median", "cv_max")


def repetition_medians(runs: DataFrame, repetitions: list[int]) -> DataFrame:
    ok = runs.filter(succeeded())
    medians = R.order_statistics(ok.filter(F.col("repetition").isin(repetitions)), [*CONFIG, "repetition"], "inferenceMs", {"median": R.mid_median()})
    wide = medians.groupBy(*CONFIG).pivot("repetition", repetitions).agg(F.max("median"))
    return ok.select(*CONFIG).distinct().join(wide, CONFIG, "left")


def pairs_of_runs(base: DataFrame, variant: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Successful records of both runs side by side (b, v); of several of a key the last counts."""
    sides = [latest_deliveries(df.filter(succeeded()), keys, order).select(F.struct("*").alias(n), *keys) for df, n in ((base, "b"), (variant, "v"))]
    return sides[0].join(sides[1], keys, "inner")


def determinism(pairs: DataFrame) -> DataFrame:
    same = F.trim("b.text") == F.trim("v.text")
    return pairs.groupBy(*CONFIG).agg(F.count_if(same).alias("identical"), F.count(F.lit(1)).alias("total"))


def speed_changes(pairs: DataFrame) -> DataFrame:
    measures = ["loadMs", "inferenceMs", "rtf", "peakMemoryMb", "avgCores"]
    of = {f"{m}_{'old' if s == 'b' else 'new'}": number(f"{s}.{m}") if m in ("rtf", "peakMemoryMb", "avgCores") else F.col(f"{s}.{m}") for m in measures for s in "bv"}
    ranked = R.order_statistics(R.measures_in_rows(pairs, CONFIG, of), [*CONFIG, "measure"], "value", {"median": R.mid_median()})
    return pairs.select(*CONFIG).distinct().join(R.measures_in_columns(ranked, CONFIG, {name: (name, "median") for name in of}), CONFIG, "left")


def complete_samples(runs: DataFrame) -> DataFrame:
    """Samples that every configuration has (relational division)."""
    pairs = runs.select(*CONFIG, "sampleId").distinct()
    wanted = pairs.select(*CONFIG).distinct().agg(F.count(F.lit(1)).alias("wanted"))
    return pairs.groupBy("sampleId").agg(F.count(F.lit(1)).alias("configs")).join(F.broadcast(wanted), F.col("configs") == F.col("wanted")).select("sampleId")


def pooled_rate(df: DataFrame, by: list[str], rate: str = "wer", weight: str = "referenceWords") -> DataFrame:
    """Rates weighted by their words."""
    usable = F.col(rate).isNotNull()
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(rate) * F.col(weight)), F.sum(when(usable, weight)).cast("double")).alias("pooled_rate"))


def folded_pieces(pieces: DataFrame, key: list[str], position: str) -> DataFrame:
    """Pieces of one recording put together: times summed, cold if one was, largest memory, texts in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.col("text").alias("t"))))
    text = F.array_join(F.filter(F.transform(ordered, lambda x: F.trim(x["t"])), lambda t: t != ""), " ")
    return pieces.groupBy(*key).agg(
        F.sum("inferenceMs").alias("inferenceMs"), F.sum("loadMs").alias("loadMs"), F.sum("cpuMs").alias("cpuMs"), F.bool_or("coldStart").alias("coldStart"),
        F.max("peakMemoryMb").alias("peakMemoryMb"), F.try_divide(F.sum("inferenceMs").cast("double"), F.max("audioMs").cast("double")).alias("rtf"), text.alias("text"),
    )
