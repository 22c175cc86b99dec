"""Queries of the aggregation operators on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.operators import aggregates as A
from sonoframe.operators import ranks as R
from sonoframe.schemas import with_run_defaults
from sonoframe.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_run_defaults(table(spark, sf_dir, "runs"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_FIRST = "error is null and repetition = 1"
_GROUPS = """
select "modelId", "decoding", {group} as "group",
  count(distinct case when error is null then "sampleId" end) as samples, count(*) as runs, cast(sum(case when error is not null then 1 else 0 end) as bigint) as failures,
  round(sum(case when {first} then substitutions + deletions + insertions end)::double / nullif(sum(case when {first} then "referenceWords" end), 0)::double, 10) as wer_micro,
  round(avg(case when {first} then wer end), 10) as wer_macro, round(avg(case when {first} then cer end), 10) as cer_macro,
  cast(count(case when {first} and wer >= 1 then 1 end) as bigint) as runaway_outputs, cast(count(case when {first} and "hasCritical" then 1 end) as bigint) as samples_with_critical,
  cast(coalesce(sum(case when {first} then len(critical) end), 0) as bigint) as critical_flags, round(max(case when error is null then "peakMemoryMb" end), 10) as peak_memory_mb_max,
  round(quantile_disc(case when error is null and not isnan(rtf) then rtf end, 0.5), 10) as rtf_median, quantile_disc(case when error is null then "inferenceMs" end, 0.5) as inference_ms_median,
  quantile_disc(case when error is null then "inferenceMs" end, 0.95) as inference_ms_p95, quantile_disc(case when error is null and "coldStart" then "loadMs" end, 0.5) as load_ms_cold_median,
  round(quantile_disc(case when error is null and not isnan("avgCores") then "avgCores" end, 0.5), 10) as avg_cores_median
from runs group by "modelId", "decoding"{by}"""
_UNSTABLE = """
select "modelId", "decoding", {group} as "group", cast(count(case when low <> high then 1 end) as bigint) as unstable_samples from (
  select "modelId", "decoding", category, "sampleId", min(case when error is null then text end) as low, max(case when error is null then text end) as high from runs
  group by all)
group by "modelId", "decoding"{by}"""
_ALL, _EACH = {"group": "'ALL'", "by": ""}, {"group": "category", "by": ", category"}


@query(
    f"with c as ({_GROUPS.format(first=_FIRST, **_ALL)} union all {_GROUPS.format(first=_FIRST, **_EACH)}), u as ({_UNSTABLE.format(**_ALL)} union all {_UNSTABLE.format(**_EACH)}) "
    'select c.*, u.unstable_samples from c join u on c."modelId" = u."modelId" and c."decoding" = u."decoding" and c."group" is not distinct from u."group"'
)
def agg01_summary(spark, sf_dir):
    return rounded(A.summarize(runs_of(spark, sf_dir)), 10)


@query(f"""select "modelId", language, cast(sum(substitutions + deletions + insertions) as bigint) as word_errors, cast(sum("referenceWords") as bigint) as words,
  round(sum(substitutions + deletions + insertions)::double / nullif(sum("referenceWords"), 0), 10) as rate_or_null,
  round(coalesce(sum(substitutions + deletions + insertions)::double / nullif(sum("referenceWords"), 0), 0), 10) as rate_or_zero
from runs where {_FIRST} group by all""")
def agg02_micro_rates(spark, sf_dir):
    by = runs_of(spark, sf_dir).filter(A.first_repetition()).groupBy("modelId", "language").agg(F.sum(A.word_errors()).alias("word_errors"), F.sum("referenceWords").alias("words"))
    rate = F.try_divide(F.col("word_errors").cast("double"), F.col("words").cast("double"))
    return rounded(by.withColumns({"rate_or_null": rate, "rate_or_zero": F.coalesce(rate, F.lit(0.0))}), 10)


@query(f'select category, round(avg(wer), 10) as wer_macro, round(avg(cer), 10) as cer_macro, count(wer) as rated from runs where {_FIRST} group by all')
def agg03_macro_rates(spark, sf_dir):
    return rounded(runs_of(spark, sf_dir).filter(A.first_repetition()).groupBy("category").agg(F.avg("wer").alias("wer_macro"), F.avg("cer").alias("cer_macro"), F.count("wer").alias("rated")), 10)


@query("""select provider, count(*) as runs, count(distinct case when error is null then "sampleId" end) as samples, count(case when error is not null then 1 end) as failures,
  count(case when wer >= 1 then 1 end) as runaway, count(case when "hasCritical" then 1 end) as flagged, cast(sum(len(critical)) as bigint) as flags from runs
  group by all""")
def agg04_05_conditional_counts(spark, sf_dir):
    return runs_of(spark, sf_dir).groupBy("provider").agg(
        F.count(F.lit(1)).alias("runs"), F.count_distinct(A.when(A.succeeded(), "sampleId")).alias("samples"), F.count_if(~A.succeeded()).alias("failures"),
        F.count_if(F.col("wer") >= 1).alias("runaway"), F.count_if("hasCritical").alias("flagged"), F.sum(F.size("critical").cast("long")).alias("flags"),
    )


@query(f'select "modelId", "decoding", f.kind as kind, count(*) as flags from (select "modelId", "decoding", unnest(critical) as f from runs where {_FIRST}) group by all')
def agg06_flags_by_kind(spark, sf_dir):
    return A.flags_by_kind(runs_of(spark, sf_dir))


@query('select "modelId", "decoding", "sampleId", count(*) as runs from runs where error is null group by all having min(text) <> max(text)')
def agg07_unstable_samples(spark, sf_dir):
    return A.unstable_samples(runs_of(spark, sf_dir))


@query("""with v as (select "modelId", "inferenceMs" as x from runs where error is null),
a as (select "modelId", list_sort(list(x)) as s, quantile_disc(x, 0.95) as nearest_rank, round(quantile_cont(x, 0.95), 6) as linear, round(median(x), 6) as mid_median
  from v group by all)
select "modelId", nearest_rank, linear, mid_median, s[len(s) // 2 + 1] as upper_median, s[cast(round_even(0.95::double * (len(s) - 1), 0) as bigint) + 1] as nearest_index
  from a""")
def agg08_12_five_quantiles(spark, sf_dir):
    wanted = {"nearest_rank": R.nearest_rank(95), "linear": R.linear(95), "mid_median": R.mid_median(), "upper_median": R.upper_median(), "nearest_index": R.nearest_index(95)}
    found = R.order_statistics(runs_of(spark, sf_dir).filter(A.succeeded()), ["modelId"], "inferenceMs", wanted).drop("n")
    return rounded(found.withColumns({c: F.col(c).cast("long") for c in ("nearest_rank", "upper_median", "nearest_index")}))


@query("""with s as (select "modelId", "decoding", "sampleId", count(*) as n, avg("inferenceMs") as m, stddev_pop("inferenceMs") as d from runs where error is null group by all),
c as (select "modelId", "decoding", median(100 * d / m) as cv_median, max(100 * d / m) as cv_max from s where n >= 2 and m > 0 group by all),
t as (select "modelId", "decoding", count(*) as n, median("inferenceMs") as ms_median, quantile_cont("inferenceMs", 0.95) as ms_p95, min("inferenceMs") as ms_min,
  max("inferenceMs") as ms_max,
  median(case when not isnan(rtf) then rtf end) as rtf_median, median(case when "loadMs" > 0 then "loadMs" end) as load_median from runs where error is null group by all)
select t."modelId", t."decoding", n, round(ms_median, 6) as ms_median, round(ms_p95, 6) as ms_p95, ms_min, ms_max, round(rtf_median, 6) as rtf_median, round(load_median,
  6) as load_median,
  round(cv_median, 6) as cv_median, round(cv_max, 6) as cv_max from t left join c on t."modelId" = c."modelId" and t."decoding" = c."decoding" """)
def agg13_21_timing_study(spark, sf_dir):
    return rounded(A.timing_study(runs_of(spark, sf_dir)))


@query("""select "modelId", "decoding", round(median(case when repetition = 1 then "inferenceMs" end), 6) as r1, round(median(case when repetition = 2 then "inferenceMs" end), 6)
  as r2,
  round(median(case when repetition = 3 then "inferenceMs" end), 6) as r3 from runs where error is null group by all""")
def agg21_repetition_medians(spark, sf_dir):
    return rounded(A.repetition_medians(runs_of(spark, sf_dir), [1, 2, 3]).withColumnsRenamed({str(i): f"r{i}" for i in (1, 2, 3)}))


@query("""select cast(segments as integer) as segments, coalesce(chunking, 'off') as chunking, count(*) as n from (select coalesce(segments, 1) as segments, chunking from runs)
  group by all""")
def agg23_value_counts(spark, sf_dir):
    return runs_of(spark, sf_dir).groupBy("segments", "chunking").agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select provider_id, model_id, sample_id, count(*) as n, median(processing_ms) as ms, median(audio_ms) as audio from transcribe_results where not cold_start
  group by all),
v as (select provider_id, model_id, max(load_ms) as load_max, max(peak_memory_mb) as peak_max from transcribe_results group by all)
select s.provider_id, s.model_id, sample_id, n, round(ms, 6) as ms, round(audio, 6) as audio, round(ms / nullif(audio, 0), 6) as rtf, load_max, round(peak_max, 6)
  as peak_max
from s join v on s.provider_id = v.provider_id and s.model_id = v.model_id""")
def agg24_synthesis_summary(spark, sf_dir):
    t = table(spark, sf_dir, "transcribe_results")
    voice = ["provider_id", "model_id"]
    key, rows = [*voice, "sample_id"], t.filter("not cold_start")
    ranked = R.order_statistics(R.measures_in_rows(rows, key, {"ms": F.col("processing_ms"), "audio": F.col("audio_ms")}), [*key, "measure"], "value", {"median": R.mid_median()})
    warm = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(R.measures_in_columns(ranked, key, {"ms": ("ms", "median"), "audio": ("audio", "median")}), key, "left")
    most = t.groupBy(*voice).agg(F.max("load_ms").alias("load_max"), F.max("peak_memory_mb").alias("peak_max"))
    return rounded(warm.withColumn("rtf", F.try_divide("ms", "audio")).join(most, voice))


@query("""with m as (select model_id, sample_id, median(case when decoding = 'greedy search' then processing_ms end) as whole, median(case
  when decoding like 'beam search%' then processing_ms end) as pieces
  from transcribe_results where not cold_start group by all)
select model_id, sample_id, round(whole, 6) as whole, round(pieces, 6) as pieces, round((pieces - whole) * 100 / whole, 6) as overhead_percent from m where whole > 0
  and pieces is not null""")
def agg25_mode_overhead(spark, sf_dir):
    t = table(spark, sf_dir, "transcribe_results").filter("not cold_start")
    mode = F.when(F.col("decoding") == "greedy search", "whole").when(F.col("decoding").startswith("beam search"), "pieces")
    medians = R.order_statistics(t.withColumn("mode", mode).filter("mode is not null"), ["model_id", "sample_id", "mode"], "processing_ms", {"median": R.mid_median()})
    wide = medians.groupBy("model_id", "sample_id").pivot("mode", ["whole", "pieces"]).agg(F.max("median"))
    return rounded(wide.filter("whole > 0 and pieces is not null").withColumn("overhead_percent", (F.col("pieces") - F.col("whole")) * 100 / F.col("whole")))


@query("""with s as (select category, list_sort(list("durationMs") filter ("durationMs" is not null)) as d, count(*) as n, sum("durationMs") as total from samples group by all)
select category, n, round(coalesce(total, 0) / 60000.0::double, 6) as minutes, d[1] as shortest, d[len(d) // 2 + 1] as upper_median, d[len(d)] as longest from s""")
def agg26_dataset_check(spark, sf_dir):
    d = F.col("durationMs")
    samples = table(spark, sf_dir, "samples")
    by = samples.groupBy("category").agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum(d), F.lit(0)) / 60000.0).alias("minutes"), F.min(d).alias("shortest"), F.max(d).alias("longest"))
    middle = R.order_statistics(samples, ["category"], "durationMs", {"upper_median": R.upper_median()}).select("category", F.col("upper_median").cast("long").alias("upper_median"))
    return rounded(by.join(middle, "category", "left"))


@query("""select "runId", "modelId", "decoding", "sampleId", cast(sum("inferenceMs") as bigint) as "inferenceMs", cast(sum("loadMs") as bigint) as "loadMs", cast(sum("cpuMs")
  as bigint) as "cpuMs",
  bool_or("coldStart") as "coldStart", round(max("peakMemoryMb"), 6) as "peakMemoryMb", round(sum("inferenceMs")::double / nullif(max("audioMs"), 0)::double, 5) as rtf,
  coalesce(string_agg(trim(text, ' '), ' ' order by repetition, text) filter (trim(text, ' ') <> ''), '') as text from runs group by all""")
def agg27_folded_pieces(spark, sf_dir):
    return rounded(A.folded_pieces(runs_of(spark, sf_dir), ["runId", "modelId", "decoding", "sampleId"], "repetition").withColumn("rtf", F.round("rtf", 5)))


@query('select category, count(case when "durationMs" is not null then 1 end) as recorded, count(*) as total from samples group by all')
def agg28_progress(spark, sf_dir):
    return table(spark, sf_dir, "samples").groupBy("category").agg(F.count("durationMs").alias("recorded"), F.count(F.lit(1)).alias("total"))


@query('select "modelId", round(sum(wer * "referenceWords") / nullif(sum(case when wer is not null then "referenceWords" end), 0)::double, 6) as pooled_rate from runs where error is null group by all')
def agg29_pooled_rate(spark, sf_dir):
    return rounded(A.pooled_rate(runs_of(spark, sf_dir).filter(A.succeeded()), ["modelId"]))


@query("""select "modelId", "sampleId", count(case when regexp_matches(text, '[0-9]+ ?(mg|µg|%)') then 1 end) as heard, count(*) as repetitions from runs where error is null
  group by all""")
def agg30_keys_heard(spark, sf_dir):
    heard = F.count_if(F.col("text").rlike("[0-9]+ ?(mg|µg|%)"))
    return runs_of(spark, sf_dir).filter(A.succeeded()).groupBy("modelId", "sampleId").agg(heard.alias("heard"), F.count(F.lit(1)).alias("repetitions"))


@query('select threads, round(avg("avgCores"), 6) as cores, round(avg("cpuMs"), 4) as cpu_ms from runs where "avgCores" is not null and not isnan("avgCores") and "cpuMs" > 0 group by all')
def agg31_average_load(spark, sf_dir):
    measured = runs_of(spark, sf_dir).filter("avgCores is not null and not isnan(avgCores) and cpuMs > 0")
    return measured.groupBy("threads").agg(F.round(F.avg("avgCores"), 6).alias("cores"), F.round(F.avg("cpuMs"), 4).alias("cpu_ms"))


@query(f"""with f as (select "sampleId", wer, "modelId", "decoding", "runId", text from runs where {_FIRST} and wer is not null),
m as (select "sampleId", quantile_disc(wer, 0.5) as wer_median, count(*) as outputs from f group by all),
b as (select "sampleId", wer as best_wer, "modelId" as best_model, text as best_text from (select *, row_number() over (partition by "sampleId" order by wer, "modelId",
  "decoding", "runId", text) as nth from f) where nth = 1)
select m."sampleId", round(wer_median, 6) as wer_median, outputs, round(best_wer, 6) as best_wer, best_model, best_text from m join b on m."sampleId" = b."sampleId"
  where wer_median >= 0.25""")
def srt03_win03_hard_samples(spark, sf_dir):
    return rounded(A.hard_samples(runs_of(spark, sf_dir)))


_PAIR = """l as (select * from (select *, row_number() over (partition by "modelId", "decoding", "sampleId", repetition order by "timestampMs" desc, "runId" desc, "ingestedAt" desc)
  as nth
  from runs where error is null and "runId" like '%-{name}-%') where nth = 1)"""
_PAIRS = "with " + _PAIR.format(name="control") + ", " + _PAIR.replace("l as", "r as").format(name="postcorrect")
_ON = ' on l."modelId" = r."modelId" and l."decoding" = r."decoding" and l."sampleId" = r."sampleId" and l.repetition = r.repetition'
_PAIR_KEY, _PAIR_ORDER = ["modelId", "decoding", "sampleId", "repetition"], ["timestampMs", "runId", "ingestedAt"]


def two_runs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    runs = runs_of(spark, sf_dir)
    return [runs.filter(F.col("runId").contains(f"-{name}-")) for name in ("control", "postcorrect")]


@query(_PAIRS + ' select l."modelId", l."decoding", cast(count(case when trim(l.text, \' \') = trim(r.text, \' \') then 1 end) as bigint) as identical, count(*) as total from l join r' + _ON + " group by all")
def agg19_joi01_determinism(spark, sf_dir):
    return A.determinism(A.pairs_of_runs(*two_runs(spark, sf_dir), _PAIR_KEY, _PAIR_ORDER))


_MEDIANS = ", ".join(
    f'round(median(case when {s}."{m}" is not null and not isnan({s}."{m}"::double) then {s}."{m}" end), 6) as "{m}_{n}"'
    for m in ("loadMs", "inferenceMs", "rtf", "peakMemoryMb", "avgCores")
    for s, n in (("l", "old"), ("r", "new"))
)


@query(_PAIRS + f' select l."modelId", l."decoding", {_MEDIANS} from l join r' + _ON + " group by all")
def agg20_joi02_speed_changes(spark, sf_dir):
    return rounded(A.speed_changes(A.pairs_of_runs(*two_runs(spark, sf_dir), _PAIR_KEY, _PAIR_ORDER)))


@query("""with c as (select distinct "modelId", "decoding", "sampleId" from runs), n as (select count(*) as n from (select distinct "modelId", "decoding" from runs))
select "sampleId" from c group by "sampleId" having count(*) = (select n from n)""")
def joi07_common_samples(spark, sf_dir):
    return A.complete_samples(runs_of(spark, sf_dir))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
