"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm import lookalikes, mixing, quantiles, repetition, spans, tokens, truncation
from sonoframe.llm.records import text_records
from sonoframe.session import cut_lineage, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = table(spark, sf_dir, "text_comparisons").select("comparison_id", "normalized_reference", "normalized_hypothesis")
    return lookalikes.differing_only_in_characters(compared, "normalized_reference", "normalized_hypothesis").select("comparison_id").distinct()


def p1_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = table(spark, sf_dir, "text_comparisons").select("comparison_id", "normalized_reference", "normalized_hypothesis")
    return lookalikes.normalize(compared, ["normalized_reference", "normalized_hypothesis"])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_records(table(spark, sf_dir, "transcribe_results"), table(spark, sf_dir, "samples"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.assess(_records(spark, sf_dir)).filter("truncated").select("origin", "record_key")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(truncation.assess(_records(spark, sf_dir)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = repetition.with_share(_records(spark, sf_dir).select("origin", "record_key", "text"))
    return repetition.cases(measured).select("origin", "record_key").distinct()


def p3_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated share of each record, without its group's threshold."""
    return p3_shares(spark, sf_dir).select("origin", "record_key", "n_words", "repeated", F.round("share", 9).alias("share")).distinct()


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.assess(_records(spark, sf_dir))


_RUN_KEY = ["runId", "modelId", "decoding", "sampleId", "repetition"]
_CONFIGURATION = ["modelId", "decoding", "metric"]


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each run's configurations, and (runId null) of all runs together, added up from the runs' sketches."""
    by = ["runId", "modelId", "decoding"]
    once = quantiles.deliveries_once(table(spark, sf_dir, "runs"), _RUN_KEY, ["rtf", "inferenceMs"], by)
    single = quantiles.sketches(quantiles.long_form(once, ["rtf", "inferenceMs"], *by), ["runId", *_CONFIGURATION])
    whole = quantiles.add_sketches(single, _CONFIGURATION).withColumn("runId", F.lit(None).cast("string"))
    return quantiles.percentiles(single.unionByName(whole), ["runId", *_CONFIGURATION])


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = quantiles.deliveries_once(table(spark, sf_dir, "runs"), _RUN_KEY, ["timestampMs", "rtf", "inferenceMs"], ["modelId", "decoding"])
    day = F.to_date(F.timestamp_millis("timestampMs")).alias("day")
    return quantiles.sketches(quantiles.long_form(once, ["rtf", "inferenceMs"], "modelId", "decoding", day), ["day", *_CONFIGURATION])


def p4_days_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of all days, added up from the days' sketches."""
    return quantiles.percentiles(quantiles.add_sketches(_daily(spark, sf_dir), _CONFIGURATION), _CONFIGURATION)


def p4_within_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days' merged percentiles held against the values: how many values each group has, and whether every percentile's rank is
    within its bound (rank_error, and the width of a code)."""
    found = p4_days_merged(spark, sf_dir)
    once = quantiles.deliveries_once(table(spark, sf_dir, "runs"), _RUN_KEY, ["rtf", "inferenceMs"], ["modelId", "decoding"])
    values = quantiles.long_form(once, ["rtf", "inferenceMs"], "modelId", "decoding").filter("value is not null and not isnan(value)")
    wide = 2.0**-quantiles.MANTISSA_BITS
    counts = [f(F.col("value"), F.col(f"p{p}") * (1 + sign * wide)).alias(f"{name}{p}") for p in quantiles.PERCENTILES for name, f, sign in (("low", lambda v, x: F.count_if(v < x), -1), ("high", lambda v, x: F.count_if(v <= x), 1))]
    of = ["modelId", "decoding", "metric"]
    ranked = values.join(found, of).groupBy(*of, "n", "rank_error").agg(F.count(F.lit(1)).alias("values"), *counts)
    place = lambda p: F.floor(F.lit(p / 100) * (F.col("n") - 1))
    slack = F.col("rank_error") * F.col("n")
    within = [(F.col(f"low{p}") - slack <= place(p)) & (place(p) < F.col(f"high{p}") + slack) for p in quantiles.PERCENTILES]
    return ranked.select(*of, "n", (F.col("values") == F.col("n")).alias("counted"), F.array_min(F.array(*within)).alias("within"))


def p4_day_withdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles without the last day: its sketches are taken out again from the sum of all days'."""
    daily = cut_lineage(_daily(spark, sf_dir))
    last = daily.agg(F.max("day").alias("last"))  # one row
    withdrawn = daily.join(F.broadcast(last), F.col("day") == F.col("last")).select(*_CONFIGURATION, "cell", (-F.col("n")).alias("n"))
    return quantiles.percentiles(quantiles.add_sketches(daily.select(*_CONFIGURATION, "cell", "n").unionByName(withdrawn), _CONFIGURATION), _CONFIGURATION)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each text as its ids give it back."""
    return tokens.decode(p6_ids(spark, sf_dir)).select("doc_id", F.md5("text").alias("digest"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(p7_mix(spark, sf_dir), table(spark, sf_dir, "source_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.pairs(table(spark, sf_dir, "documents"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_parts(table(spark, sf_dir, "documents"))


def p8_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_shared without the spans themselves: how many there are and how much of each text they make up."""
    return p8_shared(spark, sf_dir).select("doc_id", "n_chars", F.size("spans").cast("long").alias("spans"), "shared_chars", F.round("shared_part", 9).alias("shared_part"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_normalized, p2_found, p2_rates, p3_found, p3_measured, p3_shares, p4_percentiles, p4_days_merged, p4_within_bounds, p4_day_withdrawn, p6_ids, p6_decoded, p7_mix, p7_shares, p8_found, p8_shared, p8_parts]
    return {f.__name__: f for f in found}




def _p1_sql() -> tuple[str, str]:
    """p1_found and p1_normalized: the table of look-alikes in SQL, and Unicode's composed form where the operator has a collation."""
    table = lookalikes.look_alike_table()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    several = "v"
    for char, letters in table.items():
        if len(letters) > 1:
            several = f"replace({several}, {quoted(char)}, {quoted(letters)})"
    single = {c: r for c, r in table.items() if len(r) == 1}
    plain = f"translate(translate({several}, {quoted(''.join(single))}, {quoted(''.join(single.values()))}), {quoted(lookalikes.INVISIBLE)}, '')"
    forms = f"""with p as (select v, {plain} as p from (select distinct normalized_reference as v from text_comparisons union select normalized_hypothesis from text_comparisons) where v is not null),
c as (select nfc_normalize(p) as k, first(p order by strlen(p), p) as f from p group by all), f as (select v, f from p join c on k = nfc_normalize(p))"""
    joined = " from text_comparisons left join f a on a.v = normalized_reference left join f b on b.v = normalized_hypothesis"
    found = f"{forms} select distinct comparison_id{joined} where a.f = b.f and normalized_reference <> normalized_hypothesis"
    return found, f"{forms} select comparison_id, a.f as normalized_reference, b.f as normalized_hypothesis{joined}"


#: Words, their runs of three, the runs met before, and the words in them; every place is looked at by itself.
_P3 = r"""with t as (select distinct 'transcribe_results' as origin, result_id::varchar as record_key, text from transcribe_results union select 'samples', id, reference from samples),
w as (select row_number() over () as i, origin, record_key, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from t where text is not null),
g as (select i, len(w) as n, unnest(range(1, len(w) - 1)) as p, w from w where len(w) >= 12),
r as (select i, n, p, w[p] as a, w[p + 1] as b, w[p + 2] as c from g),
x as (select i, n, p from (select *, min(p) over (partition by i, a, b, c) as first from r) where p > first),
m as (select distinct i, n, unnest([p, p + 1, p + 2]) as q from x)"""
_P3_FOUND = _P3 + ", s as (select i from m group by i, n having count(*) >= 0.3 * n) select distinct origin, record_key from s join w using (i)"
_P3_MEASURED = _P3.replace("where len(w) >= 12", "where len(w) >= 3") + """, s as (select i, count(*) as repeated from m group by i), a as (select distinct t.origin, t.record_key, coalesce(len(w.w), 0) as n, coalesce(repeated, 0) as repeated from t left join w on w.origin = t.origin and w.record_key = t.record_key and w.text = t.text left join s using (i))
select distinct origin, record_key, cast(n as bigint) as n_words, cast(repeated as bigint) as repeated, round(case when n > 0 then repeated::double / n else 0.0::double end, 9) as share from a"""

#: How many values a group has; that ranks are within their bounds is what the query claims.
_P4 = """with o as (select "modelId", "decoding", "runId", "sampleId", repetition, max(case when not isnan(rtf) then rtf end) as rtf, max("inferenceMs") as ms from runs group by all)
select "modelId", "decoding", metric, count(*) as n, true as counted, true as within from (select "modelId", "decoding", 'rtf' as metric, rtf as v from o union all select "modelId", "decoding", 'inferenceMs', ms from o) where v is not null group by all"""

#: Every window of 120 characters.
_P8 = """with d as (select distinct doc_id, string_split(text, '') as c from documents where length(text) >= 120),
w as (select doc_id, unnest(range(1, len(c) - 118)) as p, c from d), s as (select distinct doc_id, md5(array_to_string(c[p:p + 119], '')) as h from w)
select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from s a join s b on a.h = b.h and a.doc_id < b.doc_id"""


#: Windows that other documents have too, put together where they overlap or touch.
_P8_PARTS = """with d as (select doc_id, max(coalesce(length(text), 0)) as n, any_value(text) as text from documents group by doc_id), c as (select doc_id, string_split(text, '') as c from d where n >= 120),
w as (select doc_id, unnest(range(0, len(c) - 119)) as p, c from c), h as (select doc_id, p, md5(array_to_string(c[p + 1:p + 120], '')) as h from w),
s as (select doc_id, p from h where h in (select h from h group by h having min(doc_id) < max(doc_id))), g as (select *, case when p <= lag(p) over (partition by doc_id order by p) + 120 then 0 else 1 end as fresh from s),
i as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as i from g), u as (select doc_id, max(p) + 120 - min(p) as size from i group by doc_id, i), t as (select doc_id, count(*) as spans, sum(size) as shared from u group by doc_id)
select d.doc_id, cast(n as bigint) as n_chars, coalesce(spans, 0) as spans, cast(coalesce(shared, 0) as bigint) as shared_chars, round(case when n > 0 then coalesce(shared, 0)::double / n else 0.0::double end, 9) as shared_part from d left join t using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    found, normalized = _p1_sql()
    return {"p1_found": found, "p1_normalized": normalized, "p4_within_bounds": _P4, "p3_found": _P3_FOUND, "p3_measured": _P3_MEASURED, "p6_decoded": "select doc_id, md5(coalesce(text, '')) as digest from documents", "p8_found": _P8, "p8_parts": _P8_PARTS}
