"""Queries of joins, filters, set operations, windows, validation and projections on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.functions import audio as U
from sonoframe.functions import text as T
from sonoframe.operators import aggregates as A
from sonoframe.operators import sequences as S
from sonoframe.operators import validation as V
from sonoframe.operators import voices as O
from sonoframe.plans import provider
from sonoframe.plans import twins as W
from sonoframe.plans.aggregates import rounded, runs_of, two_runs
from sonoframe.session import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in milliseconds and the number in their properties."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))


_EVENTS = "e as (select event_id, user_id, event_type, value, epoch_us(ts) // 1000 as ms, cast(json_extract(props, '$.k') as bigint) as k from events)"

# ------------------------------------------------------------------ filters and projections


@query("""select * from (select "runId", "sampleId", "modelId", "decoding", repetition, wer from runs where repetition = 1 and error is null) r
where not exists (select 1 from samples s where s.id = r."sampleId" and s.private)""")
def src05_flt04_rated_runs(spark, sf_dir):
    private = table(spark, sf_dir, "samples").filter("private").select(F.col("id").alias("sampleId"))
    kept = runs_of(spark, sf_dir).filter(A.first_repetition()).select("runId", "sampleId", "modelId", "decoding", "repetition", "wer")
    return kept.join(private, "sampleId", "left_anti").select("runId", "sampleId", "modelId", "decoding", "repetition", "wer")


@query("""select "runId", "modelId", "decoding", "sampleId", repetition, wer, text from (select *, row_number() over (partition by "runId", "modelId", "decoding", "sampleId",
  repetition order by "ingestedAt" desc) as nth from runs) where nth = 1""")
def src06_last_delivery(spark, sf_dir):
    return A.latest_deliveries(runs_of(spark, sf_dir), A.RUN_KEY, ["ingestedAt"]).select(*A.RUN_KEY, "wer", "text")


@query("select distinct id, category, language from samples where not private and category in ('fr-medical', 'en-technical', 'fr-legal')")
def flt02_03_selected_samples(spark, sf_dir):
    wanted = F.col("category").isin("fr-medical", "en-technical", "fr-legal")
    return table(spark, sf_dir, "samples").filter(~F.col("private") & wanted).select("id", "category", "language").distinct()


@query("""select b."sampleId", b."modelId", b."decoding", b."referenceWords", b.wer as wer_whole, v.wer as wer_other from runs b join runs v
on b."modelId" = v."modelId" and b."decoding" = v."decoding" and b."sampleId" = v."sampleId" and b.repetition = v.repetition
where b."runId" like '%-control-%' and v."runId" like '%-postcorrect-%' and b.error is null and v.error is null and b."referenceWords" >= 12 and b.wer is not null
  and v.wer is not null""")
def flt05_joi04_long_in_both(spark, sf_dir):
    control, variant = two_runs(spark, sf_dir)
    key = ["modelId", "decoding", "sampleId", "repetition"]
    b = control.filter(A.succeeded() & (F.col("referenceWords") >= 12) & F.col("wer").isNotNull()).select(*key, "referenceWords", F.col("wer").alias("wer_whole"))
    v = variant.filter(A.succeeded() & F.col("wer").isNotNull()).select(*key, F.col("wer").alias("wer_other"))
    return b.join(v, key).select("sampleId", "modelId", "decoding", "referenceWords", "wer_whole", "wer_other")


@query("select id, provider, family from models where list_contains(languages, 'fr') and role = 'stt'")
def flt07_src13_models_of_language(spark, sf_dir):
    return table(spark, sf_dir, "models").filter(F.array_contains("languages", "fr") & (F.col("role") == "stt")).select("id", "provider", "family")


@query("select event_id, user_id, value from events where value > 1 order by value desc, event_id limit 5")
def flt08_srt04_busiest(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value > 1").orderBy(F.desc("value"), "event_id").limit(5).select("event_id", "user_id", "value")


@query("""select "modelId" || ' (' || "decoding" || ')' as label, "modelId" || ' | ' || "decoding" as short_label, count(*) as n from runs group by all""")
def prj01_labels(spark, sf_dir):
    label, short = F.concat("modelId", F.lit(" ("), "decoding", F.lit(")")), F.concat_ws(" | ", "modelId", "decoding")
    return runs_of(spark, sf_dir).groupBy(label.alias("label"), short.alias("short_label")).agg(F.count(F.lit(1)).alias("n"))


@query("""select "runId", "modelId", "decoding", "sampleId", repetition, round("inferenceMs"::double / nullif("audioMs", 0), 9) as rtf_again,
  round("cpuMs"::double / nullif("loadMs" + "inferenceMs", 0), 9) as cores_again, round("inferenceMs"::double / nullif(min("inferenceMs") over (partition by "runId",
  "sampleId"), 0), 9) as times_fastest from runs""")
def prj02_derived_measures(spark, sf_dir):
    fastest = F.min("inferenceMs").over(Window.partitionBy("runId", "sampleId"))
    per = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    return rounded(runs_of(spark, sf_dir).select(
        *A.RUN_KEY, per("inferenceMs", F.col("audioMs")).alias("rtf_again"), per("cpuMs", F.col("loadMs") + F.col("inferenceMs")).alias("cores_again"), per("inferenceMs", fastest).alias("times_fastest"),
    ), 9)


@query("""select "decoding", case when position(' + ' in "decoding") > 0 then substr("decoding", position(' + ' in "decoding") + 3) else 'ignored by engine' end as biasing_label,
  count(*) as n from runs group by all""")
def prj03_biasing_label(spark, sf_dir):
    at = F.instr("decoding", " + ")
    label = F.when(at > 0, F.expr("substring(decoding, instr(decoding, ' + ') + 3)")).otherwise("ignored by engine")
    return runs_of(spark, sf_dir).groupBy("decoding", label.alias("biasing_label")).agg(F.count(F.lit(1)).alias("n"))


@query("""select "runId", strftime(make_timestamp("timestampMs" * 1000), '%Y%m%d-%H%M%S') as stamp, count(*) as n from runs group by all""")
def dat01_utc_stamps(spark, sf_dir):
    stamp = F.date_format(F.timestamp_millis("timestampMs"), "yyyyMMdd-HHmmss")
    return runs_of(spark, sf_dir).groupBy("runId", stamp.alias("stamp")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def jsn01_src17_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select doc_id, sha256(coalesce(text, '')) as digest from documents")
def jsn02_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


# ------------------------------------------------------------------ joins and sets


@query("""select side, count(*) as n from (
  (select 'only_old' as side, * from ((select "modelId", "decoding", "sampleId", repetition from runs where "runId" like '%-control-%') except (select "modelId",
  "decoding", "sampleId", repetition from runs where "runId" like '%-postcorrect-%')))
  union all (select 'only_new' as side, * from ((select "modelId", "decoding", "sampleId", repetition from runs
  where "runId" like '%-postcorrect-%') except (select "modelId", "decoding", "sampleId", repetition from runs where "runId" like '%-control-%')))
  union all (select 'both' as side, * from ((select "modelId", "decoding", "sampleId", repetition from runs
  where "runId" like '%-postcorrect-%') intersect (select "modelId", "decoding", "sampleId", repetition from runs where "runId" like '%-control-%')))) group by all""")
def joi03_set02_only_old_new(spark, sf_dir):
    key = ["modelId", "decoding", "sampleId", "repetition"]
    old, new = (df.select(*key).distinct() for df in two_runs(spark, sf_dir))
    both = old.withColumn("o", F.lit(1)).join(new.withColumn("n", F.lit(1)), key, "full_outer")
    side = F.when(F.col("n").isNull(), "only_old").when(F.col("o").isNull(), "only_new").otherwise("both")
    return both.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("""select r."runId", r."modelId", r."decoding", r."sampleId", r.repetition, cast(coalesce(len(s."keyTerms"), 0) as bigint) as terms from runs r left
  join (select distinct id, "keyTerms" from samples) s on s.id = r."sampleId" """)
def joi05_key_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "samples").dropDuplicates(["id"]).select(F.col("id").alias("sampleId"), "keyTerms")
    joined = runs_of(spark, sf_dir).join(terms, "sampleId", "left")
    return joined.select(*A.RUN_KEY, F.coalesce(F.size("keyTerms"), F.lit(0)).cast("long").alias("terms"))


@query("""select "sampleId", count(*) as n from runs where "runId" like '%-control-%' and "sampleId" in (select "sampleId" from runs where "runId" like '%-postcorrect-%'
  and error is null) group by all""")
def joi06_semi_restricted(spark, sf_dir):
    control, variant = two_runs(spark, sf_dir)
    return control.join(variant.filter(A.succeeded()).select("sampleId"), "sampleId", "left_semi").groupBy("sampleId").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_EVENTS}, a as (select * from e where event_type = 'click'), b as (select user_id, ms, max(event_id) as view_id from e where event_type = 'view' group by all)
select a.event_id, a.user_id, b.view_id from a asof left join b on a.user_id = b.user_id and a.ms >= b.ms""")
def joi08_as_of(spark, sf_dir):
    e = _events(spark, sf_dir)
    views = e.filter("event_type = 'view'").groupBy("user_id", "ms").agg(F.max("event_id").alias("view_id"))
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ms")
    return S.as_of(clicks, views, ["user_id"], "ms", "view_id").select("event_id", "user_id", "view_id")


@query("select r.result_id, r.model_id, m.family, m.license from transcribe_results r join models m on m.id = r.model_id")
def joi09_point_lookup(spark, sf_dir):
    """Each result with its model; a model that isn't known is an error."""
    models = table(spark, sf_dir, "models").select(F.col("id").alias("model_id"), "family", "license")
    results = table(spark, sf_dir, "transcribe_results").select("result_id", "model_id")
    return S.looked_up(results, models, "model_id").select("result_id", "model_id", "family", "license")


_WORDS = "select comparison_id, unnest(string_split({c}, ' ')) as word from (select distinct comparison_id, normalized_reference, normalized_hypothesis from text_comparisons)"


@query(f"""with l as ({_WORDS.format(c="normalized_reference")}), r as ({_WORDS.format(c="normalized_hypothesis")}),
lc as (select comparison_id, word, count(*) as n from l group by all), rc as (select comparison_id, word, count(*) as n from r group by all)
select coalesce(lc.comparison_id, rc.comparison_id) as comparison_id, coalesce(lc.word, rc.word) as word, greatest(coalesce(lc.n, 0) - coalesce(rc.n, 0), 0) as only_left,
  greatest(coalesce(rc.n, 0) - coalesce(lc.n, 0), 0) as only_right
from lc full outer join rc on lc.comparison_id = rc.comparison_id and lc.word = rc.word where coalesce(lc.n, 0) <> coalesce(rc.n, 0)""")
def set03_joi11_word_differences(spark, sf_dir):
    once = table(spark, sf_dir, "text_comparisons").select("comparison_id", "normalized_reference", "normalized_hypothesis").distinct()
    words = lambda c: once.select("comparison_id", F.explode(F.split(c, " ")).alias("word"))
    return S.multiset_difference(words("normalized_reference"), words("normalized_hypothesis"), ["comparison_id"], "word")


@query("select id, origin from (select id, 'private' as origin from samples where private union all select id, 'public' as origin from samples where not private)")
def set01_src03_both_folders(spark, sf_dir):
    s = table(spark, sf_dir, "samples")
    tagged = [s.filter(F.col("private") == p).select("id").withColumn("origin", F.lit(n)) for p, n in ((True, "private"), (False, "public"))]
    return tagged[0].unionByName(tagged[1])


@query("""select provider, min("timestampMs") as first_seen, row_number() over (order by min("timestampMs"), provider) as rank from runs group by provider""")
def set05_first_seen_order(spark, sf_dir):
    seen = runs_of(spark, sf_dir).groupBy("provider").agg(F.min("timestampMs").alias("first_seen"))
    return seen.withColumn("rank", F.row_number().over(Window.orderBy("first_seen", "provider")).cast("long"))  # a row a provider


@query("""with t as (select id, unnest("keyTerms") as t from samples), d as (select t.text as term, id from t)
select term from (select term, row_number() over (partition by lower(term) order by id, term) as nth from d) where nth = 1""")
def set06_src09_vocabulary(spark, sf_dir):
    terms = table(spark, sf_dir, "samples").select("id", F.explode("keyTerms").alias("t")).select("id", F.col("t.text").alias("term"))
    return terms.groupBy(F.lower("term").alias("k")).agg(F.min_by("term", F.struct("id", "term")).alias("term")).select("term")


@query("select id, count(*) - 1 as repeats from samples group by id having count(*) > 1")
def set07_repeated_ids(spark, sf_dir):
    return table(spark, sf_dir, "samples").groupBy("id").agg((F.count(F.lit(1)) - 1).alias("repeats")).filter("repeats > 0")


# ------------------------------------------------------------------ order and windows

_RANK = {"fr-general": 0, "fr-with-english-terms": 1, "fr-medical": 2, "fr-administrative": 3, "fr-legal": 4, "en-general": 5, "en-technical": 6, "fr-dictation": 7, "en-dictation": 8}


@query(f"""with r as (select distinct id, category, case category {' '.join(f"when '{c}' then {n}" for c, n in _RANK.items())} else 9 end as rank from samples)
select id, category, cast(rank as integer) as rank, row_number() over (partition by category order by id) as place from r""")
def srt01_category_order(spark, sf_dir):
    rank = F.coalesce(F.create_map(*(F.lit(x) for pair in _RANK.items() for x in pair))[F.col("category")], F.lit(9))
    place = F.row_number().over(Window.partitionBy("category").orderBy("id")).cast("long")
    return table(spark, sf_dir, "samples").select("id", "category").distinct().withColumns({"rank": rank, "place": place})


@query("""with s as (select speaker.id as speaker, avg("durationMs") as mean from samples group by all)
(select speaker, round(mean, 6) as mean, 'best' as side from s where mean is not null order by mean, speaker limit 12) union all (select speaker, round(mean, 6) as mean,
  'worst' as side from s where mean is not null order by mean desc, speaker desc limit 5)""")
def srt05_best_and_worst(spark, sf_dir):
    s = table(spark, sf_dir, "samples").groupBy(F.col("speaker.id").alias("speaker")).agg(F.avg("durationMs").alias("mean")).filter("mean is not null")
    best = s.orderBy("mean", "speaker").limit(12).withColumn("side", F.lit("best"))
    return rounded(best.unionByName(s.orderBy(F.desc("mean"), F.desc("speaker")).limit(5).withColumn("side", F.lit("worst"))))


@query("""select "modelId", "decoding", row_number() over (order by wer, "modelId", "decoding") as place from (select "modelId", "decoding", round(avg(wer), 9) as wer from runs
  where error is null and repetition = 1 group by all)""")
def srt06_order_by_rate(spark, sf_dir):
    by = runs_of(spark, sf_dir).filter(A.first_repetition()).groupBy(*A.CONFIG).agg(F.round(F.avg("wer"), 9).alias("wer"))
    return by.select(*A.CONFIG, F.row_number().over(Window.orderBy("wer", *A.CONFIG)).cast("long").alias("place"))  # a row a configuration


@query("""select "modelId", "decoding", "runId", "sampleId", repetition from (select *, row_number() over (partition by "modelId", "decoding" order by "timestampMs", "runId",
  "sampleId", repetition, "ingestedAt") as nth from runs where len(critical) > 0) where nth <= 6""")
def win01_02_first_flagged(spark, sf_dir):
    order = Window.partitionBy(*A.CONFIG).orderBy("timestampMs", "runId", "sampleId", "repetition", "ingestedAt")
    flagged = runs_of(spark, sf_dir).filter(F.size("critical") > 0).withColumn("nth", F.row_number().over(order))
    return flagged.filter("nth <= 6").select(*A.CONFIG, "runId", "sampleId", "repetition")


@query("""select "sampleId", "modelId", "decoding" from (select *, row_number() over (partition by "sampleId" order by wer, "modelId", "decoding", "runId") as nth
  from (select distinct "sampleId", "modelId", "decoding", "runId", wer from runs where error is null and repetition = 1 and wer is not null)) where nth = 1""")
def win03_04_best_configuration(spark, sf_dir):
    rated = runs_of(spark, sf_dir).filter(A.first_repetition() & F.col("wer").isNotNull())
    best = rated.groupBy("sampleId").agg(F.min(F.struct("wer", *A.CONFIG, "runId")).alias("b"))
    return best.select("sampleId", "b.modelId", "b.decoding")


@query(f"""with {_EVENTS}, g as (select *, case when ms - lag(ms) over w <= 3600000 then 0 else 1 end as fresh from e window w as (partition by user_id order by ms)),
n as (select *, sum(fresh) over (partition by user_id order by ms rows unbounded preceding) as island from g)
select user_id, min(ms) as first, max(ms) as last, count(*) as n from n group by user_id, island""")
def win05_str04_islands(spark, sf_dir):
    return S.islands(_events(spark, sf_dir), ["user_id"], "ms", 3_600_000)


_SPANS = f"with {_EVENTS}, s as (select user_id, ms as start, ms + k * 60000 as stop from e where k > 0)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter("k > 0").select("user_id", F.col("ms").alias("start"), (F.col("ms") + F.col("k") * 60_000).alias("stop"))


_UNION = _SPANS + """, m as (select *, case when start <= max(stop) over (partition by user_id order by start, stop rows between unbounded preceding and 1 preceding) then 0 else 1 end
  as fresh from s),
n as (select *, sum(fresh) over (partition by user_id order by start, stop rows unbounded preceding) as island from m), u as (select user_id, min(start) as start,
  max(stop) as "end" from n group by user_id, island)"""


@query(_UNION + ' select user_id, start, "end" from u')
def win06_interval_union(spark, sf_dir):
    return S.interval_union(_spans(spark, sf_dir), ["user_id"], "start", "stop")


@query(_UNION + """ select user_id, start, "end", greatest(start - 600000, 0, (lag("end") over w + start) // 2) as padded_start, least("end" + 600000, ("end" + lead(start) over w) // 2)
  as padded_end from u window w as (partition by user_id order by start, "end")""")
def win07_clamped(spark, sf_dir):
    return S.clamped(S.interval_union(_spans(spark, sf_dir), ["user_id"], "start", "stop"), ["user_id"], "start", "end", 600_000)


@query("""with recursive n as (select supplier, day, row_number() over (partition by supplier order by day) as i from (select l_suppkey as supplier, date_diff('day',
  date '1992-01-01', cast(l_shipdate as date))::double as day from lineitem)),
g as (select supplier, day, i, day as beginning, 1 as grp from n where i = 1
  union all select n.supplier, n.day, n.i, case when n.day - g.beginning <= 30 then g.beginning else n.day end, case when n.day - g.beginning <= 30 then g.grp
  else g.grp + 1 end from g join n on n.supplier = g.supplier and n.i = g.i + 1)
select supplier, min(day) as first, max(day) as last, count(*) as n from g group by supplier, grp""")
def win08_greedy_groups(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("at"))
    return S.greedy_groups(lines, ["supplier"], "at", 30)


_LONG = "select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings"


@query(f"""with l as ({_LONG}), f as (select vec_id, i, avg(v * v) over w as ms, count(*) over w as n from l window w as (partition by vec_id order by i rows between current row
  and 7 following))
select vec_id, cast(i as bigint) as start, round(sqrt(ms), 6) as rms from f where i % 4 = 0 and n = 8""")
def win10_str03_frames(spark, sf_dir):
    """Root mean square of frames of eight values, every four."""
    starts = F.sequence(F.lit(0), F.size("embedding") - 8, F.lit(4))
    power = lambda i: F.aggregate(F.slice("embedding", i + 1, 8), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    frames = F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.sqrt(power(i) / 8).alias("rms")))
    long = table(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 8).select("vec_id", F.explode(frames).alias("f"))
    return rounded(long.select("vec_id", "f.start", "f.rms"))


@query("""with l as (select vec_id, list_sort(list_transform(embedding, lambda x: abs(x::double))) as s from embeddings), q as (select vec_id, s[len(s) // 10 + 1] as noise,
  s[len(s) * 9 // 10 + 1] as loud from l)
select vec_id, round(noise, 6) as noise, round(loud, 6) as loud, round(greatest(least(noise * 3, loud * 0.3::double), loud * 0.05::double, 0.003::double), 6) as threshold
  from q""")
def win11_thresholds(spark, sf_dir):
    levels = F.array_sort(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    ranked = table(spark, sf_dir, "embeddings").select("vec_id", levels.alias("s"))
    at = lambda tenths: F.element_at("s", (F.floor(F.size("s") * tenths / 10) + 1).cast("int"))
    q = ranked.select("vec_id", at(1).alias("noise"), at(9).alias("loud"))
    return rounded(q.withColumn("threshold", F.greatest(F.least(F.col("noise") * 3, F.col("loud") * 0.3), F.col("loud") * 0.05, F.lit(0.003))))


@query(f"""with l as ({_LONG}), m as (select vec_id, min(case when abs(v) >= 0.05 then i end) as a, max(case when abs(v) >= 0.05 then i end) as b, max(i) + 1 as n from l
  group by all)
select vec_id, cast(coalesce(a, n) as bigint) as leading, cast(n - 1 - coalesce(b, -1) as bigint) as trailing from m""")
def win12_silent_ends(spark, sf_dir):
    """How many values at the beginning and at the end are quiet."""
    positions = F.filter(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.abs(F.get("embedding", i)) >= F.lit(0.05))
    n = F.size("embedding")
    return table(spark, sf_dir, "embeddings").filter(n > 0).select(
        "vec_id", F.coalesce(F.array_min(positions), n).cast("long").alias("leading"), (n - 1 - F.coalesce(F.array_max(positions), F.lit(-1))).cast("long").alias("trailing")
    )


@query(f"""with {_EVENTS} select event_id, user_id, cast(coalesce(sum(k * 1000 + 250) over (partition by user_id order by ms, event_id rows between unbounded preceding
  and 1 preceding), 0) as bigint) as "begin",
  cast(coalesce(sum(k * 1000 + 250) over (partition by user_id order by ms, event_id rows between unbounded preceding and 1 preceding), 0) + k * 1000 as bigint) as "end"
  from e""")
def win14_segment_clock(spark, sf_dir):
    parts = _events(spark, sf_dir).withColumns({"length": F.col("k") * 1000, "pause": F.lit(250).cast("long")})
    return S.running_clock(parts, ["user_id"], ["ms", "event_id"], "length", "pause").select("event_id", "user_id", "begin", "end")


@query("""with s as (select distinct id, category, "durationMs" from samples), n as (select *, row_number() over (partition by category order by id) as i,
  count(*) over (partition by category) as n from s)
select category, arg_min(id, ((i - 3) % n + n) % n) as next_id from n where "durationMs" is null group by category""")
def win15_next_to_record(spark, sf_dir):
    """The next sample without a recording, going round from the third of its category."""
    by = Window.partitionBy("category")
    s = table(spark, sf_dir, "samples").select("id", "category", "durationMs").distinct()
    n = s.withColumns({"i": F.row_number().over(by.orderBy("id")), "n": F.count(F.lit(1)).over(by)})
    return n.filter("durationMs is null").groupBy("category").agg(F.min_by("id", F.pmod(F.col("i") - 3, F.col("n"))).alias("next_id"))


@query(f"""with l as ({_LONG}) select vec_id, round(max(abs(v)), 6) as peak, round(sqrt(avg(v * v)), 6) as rms, round(avg(case when abs(v) >= 0.3 then 1.0::double else 0 end), 6)
  as hot_ratio from l group by all""")
def num01_signal_statistics(spark, sf_dir):
    e, n = F.col("embedding"), F.size("embedding").cast("double")
    power = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    hot = F.size(F.filter(e, lambda x: F.abs(x.cast("double")) >= 0.3)).cast("double")
    peak = F.array_max(F.transform(e, lambda x: F.abs(x.cast("double"))))
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", peak.alias("peak"), F.sqrt(power / n).alias("rms"), (hot / n).alias("hot_ratio")))


@query("""with w as (select id, "durationMs" as d, len(string_split(reference, ' '))::double as n from (select distinct id, "durationMs", reference from samples)
  where "durationMs" > 0)
select id, case when n / (d / 1000.0::double) < 1.2::double then 'slow' when n / (d / 1000.0::double) > 5.0::double then 'fast' else 'usual' end as reading, d // 1000
  as seconds from w""")
def num02_03_reading_speed(spark, sf_dir):
    s = table(spark, sf_dir, "samples").select("id", "durationMs", "reference").distinct().filter("durationMs > 0")
    speed = F.size(F.split("reference", " ")) / (F.col("durationMs") / 1000.0)
    return s.select("id", F.when(speed < 1.2, "slow").when(speed > 5.0, "fast").otherwise("usual").alias("reading"), F.expr("durationMs div 1000").alias("seconds"))


@query("select result_id, cast(floor((case when text like '%\n\n%' then 650 else 350 end) / (0.5 + threads / 4.0::double)) as bigint) as pause from transcribe_results")
def num08_pauses(spark, sf_dir):
    speed = 0.5 + F.col("threads") / 4.0
    base = F.when(F.col("text").contains("\n\n"), 650).otherwise(350)
    return table(spark, sf_dir, "transcribe_results").select("result_id", F.floor(base / speed).cast("long").alias("pause"))


@query(f"with {_EVENTS} select user_id, ms // 600000 as slot, count(*) as n, round(avg(value), 6) as mean from e group by all")
def str02_tumbling(spark, sf_dir):
    return rounded(_events(spark, sf_dir).groupBy("user_id", F.expr("ms div 600000").alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


# ------------------------------------------------------------------ validation


_ISSUES = """with s as (select *, row_number() over (partition by id order by reference, "audioFile") as nth from samples),
i as (select id, unnest(list_filter([
  case when nth > 1 then 'duplicate id' end, case when language is null or language not in ('fr', 'en') then 'unknown language' end,
  case when domain is null or domain not in ('general', 'medical', 'legal', 'administrative', 'it', 'dictation', 'technical') then 'unknown domain' end,
  case when "utteranceType" is null or "utteranceType" not in ('statement', 'question', 'command', 'paragraph', 'dictation') then 'unknown utterance type' end,
  case when source.kind is null or source.kind not in ('own-recording', 'synthetic', 'public-domain', 'licensed', 'third-party-private') then 'unknown source kind' end,
  case when trim(coalesce(reference, '')) = '' then 'reference is empty' end, case when trim(coalesce(source.license, '')) = '' then 'license is missing' end,
  case when source.kind = 'third-party-private' and not private then 'third-party recording must be private' end, case when source.kind = 'third-party-private'
  and committable then 'third-party recording must not be committable' end,
  case when "durationMs" is null then 'audio duration is missing' end], lambda x: x is not null)) as message from s)"""


@query(_ISSUES + " select id, message, count(*) as n from i group by all")
def val01_02_flt06_issues(spark, sf_dir):
    return V.sample_issues(table(spark, sf_dir, "samples")).groupBy("id", "message").agg(F.count(F.lit(1)).alias("n"))


@query(_ISSUES + " select distinct id from samples where id not in (select id from i where message like '%audio%' or message like '%WAV%' or message like '%duplicate%')")
def flt01_runnable(spark, sf_dir):
    samples = table(spark, sf_dir, "samples")
    return V.runnable(samples, V.sample_issues(samples)).select("id").distinct()


@query("""select result_id, case when length(text) > 500 then 'too long' when trim(coalesce(text, '')) = '' then 'nothing to read' when language not in ('fr',
  'en') then 'language not supported' else 'ok' end as verdict from transcribe_results""")
def val06_request_checks(spark, sf_dir):
    verdict = F.when(F.length("text") > 500, "too long").when(F.trim(F.coalesce("text", F.lit(""))) == "", "nothing to read").when(~F.col("language").isin("fr", "en"), "language not supported").otherwise("ok")
    return table(spark, sf_dir, "transcribe_results").select("result_id", verdict.alias("verdict"))


@query("select id, len(list_filter(['fr', 'en'], lambda x: not list_contains(languages, x))) = 0 as complete from models")
def val07_install_check(spark, sf_dir):
    return table(spark, sf_dir, "models").select("id", F.forall(F.array(F.lit("fr"), F.lit("en")), lambda x: F.array_contains("languages", x)).alias("complete"))


@query("""select "runId", "sampleId", repetition, "modelId", "decoding", cast(len(list_filter([case when "avgCores" > threads then 'busy' end, case
  when "loadMs" > 3000 then 'slow load' end], lambda x: x is not null)) as bigint) as problems from runs""")
def val09_preflight(spark, sf_dir):
    problems = F.filter(F.array(F.when(F.col("avgCores") > F.col("threads"), "busy"), F.when(F.col("loadMs") > 3000, "slow load")), lambda x: x.isNotNull())
    return runs_of(spark, sf_dir).select("runId", "sampleId", "repetition", "modelId", "decoding", F.size(problems).cast("long").alias("problems"))


@query("""select "modelId", round(avg(case when category = 'fr-general' then wer end), 9) as fr_general, round(avg(case when category = 'en-general' then wer end), 9)
  as en_general, round(avg(case when category = 'fr-medical' then wer end), 9) as fr_medical from runs where error is null and repetition = 1 group by all""")
def snk03_category_pivot(spark, sf_dir):
    names = {"fr-general": "fr_general", "en-general": "en_general", "fr-medical": "fr_medical"}
    wide = runs_of(spark, sf_dir).filter(A.first_repetition()).groupBy("modelId").pivot("category", list(names)).agg(F.avg("wer"))
    return rounded(wide.withColumnsRenamed(names), 9)


# ------------------------------------------------------------------ audio and speech engines


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector a hundred times over, loud and quiet in turn, as an audio signal."""
    loudness = lambda x, i: x * F.when(F.pmod(F.floor(i / 1600), F.lit(2)) == 0, 1.0).otherwise(0.001)
    repeated = F.flatten(F.array_repeat("embedding", 100))
    return spread(table(spark, sf_dir, "embeddings").select("vec_id", F.transform(repeated, loudness).alias("samples")))


#: The signals that _signals makes, as single-precision numbers.
_SIGNALS = "r as (select vec_id, flatten(list_transform(range(100), lambda k: embedding)) as e from embeddings), s as (select vec_id, list_transform(range(1, len(e) + 1), lambda i: (e[i]::double * case when ((i - 1) // 1600) % 2 = 0 then 1.0::double else 0.001::double end)::float) as s from r)"
_LEVELS = "fr as (select vec_id, len(s) as n, list_transform(range(0, (len(s) - 320) // 160 + 1), lambda f: sqrt(list_sum(list_transform(s[f * 160 + 1:f * 160 + 320], lambda x: x::double * x::double)) / 320)) as e from s)"


@query(f"""with {_SIGNALS}, {_LEVELS}, th as (select vec_id, n, e, list_sort(e) as q from fr), sp as (select vec_id, n, list_filter(range(1, len(e) + 1),
  lambda i: e[i] >= greatest(least(q[len(q) // 10 + 1] * 3, q[len(q) * 9 // 10 + 1] * 0.3::double), q[len(q) * 9 // 10 + 1] * 0.05::double, 0.003::double)) as f from th),
u as (select vec_id, unnest(f) as i from sp), g as (select *, case when i - lag(i) over w <= 30 then 0 else 1 end as fresh from u window w as (partition by vec_id
  order by i)), j as (select *, sum(fresh) over (partition by vec_id order by i) as island from g),
c as (select vec_id, count(*) as k from (select vec_id, island from j group by all having max(i) - min(i) + 1 >= 25) group by vec_id)
select vec_id, coalesce(k, 0)::int as spans, 0::int as place, 0::bigint as start, n as "end" from fr left join c using (vec_id) where n > 0""")
def num06_07_speech_segments(spark, sf_dir):
    spans = _signals(spark, sf_dir).select("vec_id", "samples", U.energy_spans("samples").alias("spans"))
    return spans.select("vec_id", F.size("spans").alias("spans"), F.posexplode(U.plan_segments("samples", "spans")).alias("place", "s")).select("vec_id", "spans", "place", "s.start", "s.end")


@query(f"""with {_SIGNALS}, q as (select vec_id, len(s) as n, list_max(list_transform(s, lambda x: abs(x::double))) as peak, sqrt(list_sum(list_transform(s,
  lambda x: x::double * x::double)) / len(s)) as rms,
  list_transform(range(0, (len(s) + 319) // 320), lambda f: sqrt(list_avg(list_transform(s[f * 320 + 1:f * 320 + 320], lambda x: x::double * x::double))) >= 0.01::double)
  as loud, len(list_filter(s, lambda x: abs(x::double) >= 0.9::double)) as hot from s)
select vec_id, n * 1000 // 16000 as "durationMs", round(peak, 6) as peak, round(rms, 6) as rms, coalesce(nullif(list_position(loud, true), 0) - 1, len(loud))::bigint * 20
  as "leadingSilenceMs",
  array_to_string(list_filter([case when peak < 0.1::double then 'very quiet: peak ' || printf('%.0f', peak * 100) || ' %' end,
  'unusual reading speed: ' || printf('%.1f', 3 / (n / 16000.0::double)) || ' words/s (wrong sentence read?)'], lambda x: x is not null), '; ') as warnings from q""")
def num01_02_quality(spark, sf_dir):
    q = U.quality("samples", F.lit(16_000), F.lit("le chat dort"))
    return rounded(_signals(spark, sf_dir).select("vec_id", q.alias("q")).select("vec_id", "q.durationMs", "q.peak", "q.rms", "q.leadingSilenceMs", F.array_join("q.warnings", "; ").alias("warnings")))


@query(f"""with {_SIGNALS}, o as (select vec_id, list_transform(range(0, 2 * len(s)), lambda i: (s[least(i // 2 + 1, len(s))]::double + (s[least((i + 1) // 2 + 1,
  len(s))]::double - s[least(i // 2 + 1, len(s))]::double) * 0.5::double * (i % 2))::float) as o from s)
select vec_id, len(o)::int as samples, round(list_sum(list_transform(o, lambda x: x::double)), 3) as total, round(o[len(o) // 2]::double, 6) + 0.0::double as middle,
  round(o[-1]::double, 6) + 0.0::double as last from o""")
def num04_resampled(spark, sf_dir):
    """Signals of 8 kHz at 16 kHz: how many samples, their sum, and two of them."""
    out = _signals(spark, sf_dir).select("vec_id", U.resample("samples", F.lit(8_000)).alias("o"))
    total = F.aggregate("o", F.lit(0.0), lambda a, x: a + x.cast("double"))
    at = lambda i: F.round(F.element_at("o", i).cast("double"), 6) + 0.0
    return out.select("vec_id", F.size("o").alias("samples"), F.round(total, 3).alias("total"), at((F.size("o") / 2).cast("int")).alias("middle"), at(F.lit(-1)).alias("last"))


@query("""select distinct id as sample_id, 'mock' as provider_id, case when language in ('fr', 'en') and trim(coalesce("audioFile",
  '')) <> '' then '[MOCK] no real transcription was performed' end as text, true as is_mock,
  case when language is null or language not in ('fr', 'en') then 'language not supported: ' || language when trim(coalesce("audioFile",
  '')) = '' then 'audio path is empty' end as error from samples""")
def udf01_04_mock_results(spark, sf_dir):
    asked = table(spark, sf_dir, "samples").dropDuplicates(["id"]).select(F.col("id").alias("sample_id"), F.col("audioFile").alias("audio_path"), F.lit("mock").alias("model_id"), "language", F.col("durationMs").alias("audio_ms"))
    return provider.transcribe(asked, provider.Mock).select("sample_id", "provider_id", "text", "is_mock", "error")


@query(f"""with recursive {W.words('select reference as t from samples union select unnest("keyTerms").text from samples')}, ra as (select row_number() over () as r, * from samples
  where reference is not null), {W.flags('select r, reference, reference as text, id as "sampleId" from ra')} select distinct id from ra join fl using (r)""")
def val05_consistent_references(spark, sf_dir):
    """Samples whose own reference raises a flag against itself: there should be none."""
    s = table(spark, sf_dir, "samples").filter("reference is not null")
    return s.filter(F.size(T.critical_flags("reference", "reference", "keyTerms")) > 0).select("id").distinct()


@query()
def srt07_shuffled_codes(spark, sf_dir):
    """Voices of each language in a seeded order of Python's generator, with anonymous codes."""
    voices = table(spark, sf_dir, "transcribe_results").select("language", "model_id").distinct()
    return O.shuffled_codes(voices, "language", "model_id", 7)


@query("select id, reference from (select distinct id, reference from samples) order by id limit 40")
def srt08_first_samples(spark, sf_dir):
    """The first forty samples by id: the limit is the feature."""
    return table(spark, sf_dir, "samples").select("id", "reference").distinct().orderBy("id").limit(40)


@query("""with p as (select comparison_id, row_number() over (partition by sample_id order by comparison_id) as nth, normalized_reference as t from (select distinct comparison_id,
  sample_id, normalized_reference from text_comparisons where normalized_reference is not null)),
s as (select comparison_id, t, cast((nth * 7) % 20 as bigint) as a, cast((nth * 7) % 20 + 15 as bigint) as b from p) select comparison_id, a, b, substr(t, 1, a)
  as before, substr(t, a + 1, b - a) as piece, substr(t, b + 1) as after from s where b <= length(t)""")
def win13_pieces(spark, sf_dir):
    """A text taken apart at a segment: what is before, in and after it; segments out of range are dropped."""
    once = table(spark, sf_dir, "text_comparisons").select("comparison_id", "sample_id", "normalized_reference").filter("normalized_reference is not null").distinct()
    nth = F.row_number().over(Window.partitionBy("sample_id").orderBy("comparison_id"))
    s = once.withColumn("a", (nth * 7 % 20).cast("long")).withColumn("b", F.col("a") + 15).filter(F.col("b") <= F.length("normalized_reference"))
    part = lambda e: F.expr(f"substring(normalized_reference, {e})")
    return s.select("comparison_id", "a", "b", part("1, cast(a as int)").alias("before"), part("cast(a as int) + 1, cast(b - a as int)").alias("piece"), part("cast(b as int) + 1").alias("after"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
