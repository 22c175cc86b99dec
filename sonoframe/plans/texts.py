"""Queries of the text functions on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.functions import native as N
from sonoframe.functions import text as T
from sonoframe.operators import aggregates as A
from sonoframe.operators import corrections as C
from sonoframe.operators import termstudy as K
from sonoframe.plans import aggregates
from sonoframe.plans import twins as W
from sonoframe.plans.aggregates import _PAIR_KEY, _PAIR_ORDER, rounded, two_runs
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


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(aggregates.runs_of(spark, sf_dir))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "transcribe_results").select("result_id", "text").filter("text is not null"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct comparison's reference words, in order."""
    once = table(spark, sf_dir, "text_comparisons").select("comparison_id", "normalized_reference", "normalized_hypothesis").distinct()
    return once.withColumn("tokens", F.split("normalized_reference", " "))


_T = "t as (select result_id, text from transcribe_results where text is not null)"
_W = "w as (select comparison_id, normalized_reference, normalized_hypothesis, string_split(normalized_reference, ' ') as tokens from (select distinct comparison_id, normalized_reference, normalized_hypothesis from text_comparisons))"
_E = "e as (select comparison_id, unnest(tokens) as token from w)"
_UNIT_CASE = f"({W.UNIT})[token]"


@query(f"""with recursive {W.words("select text as t from transcribe_results")} select result_id, array_to_string(w, ' ') as words, len(w)::int as n from transcribe_results
  join nw on t = text""")
def txt01_07_scoring_words(spark, sf_dir):
    words = T.normalize_words("text")
    return _transcripts(spark, sf_dir).select("result_id", F.array_join(words, " ").alias("words"), F.size(words).alias("n"))


@query(f"""with recursive {W.words("select text as t from transcribe_results")} select result_id, array_to_string(w, ' ') as words, len(w)::int as n from transcribe_results
  join n4 on t = text""")
def txt01_native_words(spark, sf_dir):
    """Words for scoring before numbers and units are brought to one spelling, of every text."""
    words = N.scoring_words(F.col("text"))
    return _transcripts(spark, sf_dir).select("result_id", F.array_join(words, " ").alias("words"), F.size(words).alias("n"))


@query(rf"""with {_W}, p as (select comparison_id, '  ' || array_to_string(list_filter(string_split(replace(normalized_reference, '%', 'pour cent'), ' '), lambda y: y <> ''),
  '  ') || '  ' as x from w)
select comparison_id, trim(regexp_replace(regexp_replace(regexp_replace(x, ' (pour|per)  cent ', ' % ', 'g'), ' (pourcent|percent) ', ' % ', 'g'), ' +', ' ', 'g'))
  as unified from p""")
def txt03_percent_words(spark, sf_dir):
    """References with every percent sign spelled out, brought back to signs."""
    spelled = F.regexp_replace(F.replace("normalized_reference", F.lit("%"), F.lit("pour cent")), " +", " ")
    return _words(spark, sf_dir).select("comparison_id", N.unify_percent(F.trim(spelled)).alias("unified"))


@query(rf"""with {_T}, p as (select result_id, '  ' || array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(text), '([0-9])[.,]([0-9])', '\1 virgule \2',
  'g'), '[\s.,;:?!()«»"]+', ' ', 'g'), ' '), lambda y: y <> ''), '  ') || '  ' as x from t)
select result_id, trim(regexp_replace(regexp_replace(x, ' ([0-9]+)  (?:virgule|point)  ([0-9]+) ', ' \1.\2 ', 'g'), ' +', ' ', 'g')) as written from p""")
def txt05_spoken_decimals(spark, sf_dir):
    """Transcripts with every decimal spoken, brought back to digits."""
    spoken = F.regexp_replace(F.regexp_replace(F.lower("text"), "([0-9])[.,]([0-9])", "$1 virgule $2"), r"""[\s.,;:?!()«»"]+""", " ")
    return _transcripts(spark, sf_dir).select("result_id", N.spoken_decimals(F.trim(spoken)).alias("written"))


@query(rf"""with {_T}, n as (select distinct unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) as token from t),
k as (select token, regexp_matches(token, '^[1-9][0-9]{{0,2}}([.,][0-9]{{3}}){{2,}}$') or regexp_matches(token, '^[1-9][0-9]{{1,2}}[.,][0-9]{{3}}$') as grouped,
  regexp_matches(token, '^[0-9]+[.,][0-9]+$') as single from n)
select token, regexp_replace(case when single and not grouped then replace(token, ',', '.') else regexp_replace(token, '[.,]', '', 'g') end, '^0+([0-9])', '\1')
  as canonical from k""")
def txt06_canonical_numbers(spark, sf_dir):
    tokens = _transcripts(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:[.,][0-9]+)*)"), F.lit(1))).alias("token")).distinct()
    return tokens.select("token", N.canonical_number(F.col("token")).alias("canonical"))


@query(f"with {_W}, {_E} select token, {_UNIT_CASE} as unit, count(*) as n from e where {_UNIT_CASE} is not null group by all")
def txt07_units(spark, sf_dir):
    tokens = _words(spark, sf_dir).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return tokens.withColumn("unit", N.canonical_unit(F.col("token"))).filter("unit is not null").select("token", "unit", "n")


@query(f"""with recursive {_W}, {W.words("", "select distinct normalized_reference as t, tokens as w from w where tokens is not null")} select comparison_id, array_to_string(na.w,
  ' ') as folded from w left join na on na.t = normalized_reference""")
def txt02_04_folded_numbers(spark, sf_dir):
    return _words(spark, sf_dir).select("comparison_id", F.array_join(T.fold_numbers("tokens"), " ").alias("folded"))


#: The words of all texts of runs, and their alignments.
_RUN_WORDS = W.words('select text as t from runs union select reference from runs union select unnest("keyTerms").text from samples')
_RUN_ALIGNED = "rp as (select distinct reference, text from runs where error is null), rw as (select reference, text, x.w as a, y.w as b from rp join nw x on x.t = reference join nw y on y.t = text), " + W.aligned("select a, b from rw")
_RUN_CHARS = W.distances("select array_to_string(a, ' ') as a, array_to_string(b, ' ') as b from rw")


def _character_rates(compared: DataFrame) -> DataFrame:
    distance = F.levenshtein("normalized_reference", "normalized_hypothesis")
    rate = F.try_divide(distance.cast("double"), F.length("normalized_reference"))
    return rounded(compared.select("comparison_id", distance.cast("long").alias("distance"), rate.alias("cer")), 9)


@query(f"""with {_W}, {W.distances("select normalized_reference as a, normalized_hypothesis as b from w")}
select comparison_id, distance, round(distance::double / nullif(length(a), 0), 9) as cer from w left join nb on a = normalized_reference and b = normalized_hypothesis""")
def txt10_13_character_rate(spark, sf_dir):
    """Of every comparison; null where a text is, and the rate where the reference is empty."""
    return _character_rates(spread(_words(spark, sf_dir)))


_SIMPLE = r"regexp_extract_all(lower(nfc_normalize(replace({c}, '’', ''''))), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}'']+')"


@query(f"""with recursive sp as (select distinct reference, text, {_SIMPLE.format(c="reference")} as a, {_SIMPLE.format(c="text")} as b from runs where error is null
  and text is not null and reference is not null), {W.aligned("select a, b from sp")}
select reference, text, round(case when len(a) > 0 then (substitutions + deletions + insertions)::double / len(a) end, 9) as wer from sp join (select a, b, {W.COUNTS}
  from al) using (a, b)""")
def txt11_14_simple_rates(spark, sf_dir):
    pairs = table(spark, sf_dir, "runs").filter("error is null and text is not null and reference is not null").select("reference", "text").distinct()
    return rounded(spread(pairs).select("reference", "text", T.simple_wer("reference", "text").alias("wer")), 9)


@query(f"""with recursive {_RUN_WORDS}, {_RUN_ALIGNED}, {_RUN_CHARS},
c as (select reference, text, a, {W.COUNTS}, len(b) as n, h from rw join al using (a, b)), l as (select reference, text, distance::double / nullif(length(nb.a), 0) as cer
  from rw join nb on nb.a = array_to_string(rw.a, ' ') and nb.b = array_to_string(rw.b, ' '))
select "runId", "modelId", "decoding", "sampleId", repetition, round((c.substitutions + c.deletions + c.insertions)::double / nullif(len(a), 0), 9) as wer, round(l.cer,
  9) as cer, c.substitutions, c.deletions, c.insertions, cast(len(a) as bigint) as reference_words, (len(a) + c.insertions)::int as steps
from runs r join c on c.reference = r.reference and c.text = r.text join l on l.reference = r.reference and l.text = r.text where error is null""")
def txt12_13_compared(spark, sf_dir):
    """Counts of a fresh comparison beside those on record."""
    runs = aggregates.runs_of(spark, sf_dir).filter(A.succeeded()).select(*A.RUN_KEY, "reference", "text")
    runs = T.once(runs, ["reference", "text"], c=T.compare_texts("reference", "text"))
    return rounded(runs.select(*A.RUN_KEY, "c.wer", "c.cer", "c.substitutions", "c.deletions", "c.insertions", "c.reference_words", F.size("c.diff").alias("steps")), 9)


@query(f"""with recursive {_RUN_WORDS}, {_RUN_ALIGNED}, s as (select unnest(list_transform(list_filter(range(1, len(a) + 1), lambda i: h[i] > 0 and a[i] <> b[h[i]]),
  lambda i: [a[i], b[h[i]]])) as s from rw join al using (a, b))
select s[1] as reference, s[2] as hypothesis, count(*) as n from s group by all""")
def txt12_alignment_steps(spark, sf_dir):
    pairs = aggregates.runs_of(spark, sf_dir).filter(A.succeeded()).select("reference", "text").distinct()
    steps = spread(pairs).select(F.explode(T.compare_texts("reference", "text")["diff"]).alias("s")).filter("s.kind = 'substitute'")
    return steps.groupBy("s.reference", "s.hypothesis").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with recursive {_RUN_WORDS}, {_RUN_ALIGNED}, x as (select "modelId", unnest(a) as word, unnest(list_transform(range(1, len(a) + 1), lambda i: h[i] > 0
  and a[i] = b[h[i]])) as correct from runs r join rw on rw.reference = r.reference and rw.text = r.text join al using (a, b) where error is null)
select "modelId", word, count(*) as occurrences, count(case when correct then 1 end) as heard from x group by all""")
def txt15_word_statuses(spark, sf_dir):
    pairs = aggregates.runs_of(spark, sf_dir).filter(A.succeeded()).groupBy("modelId", "reference", "text").agg(F.count(F.lit(1)).alias("n"))
    words = T.once(pairs, ["reference", "text"], s=T.word_statuses("reference", "text")).select("modelId", "n", F.explode("s").alias("s"))
    return words.groupBy("modelId", "s.word").agg(F.sum("n").alias("occurrences"), F.sum(F.when(F.col("s.correct"), F.col("n")).otherwise(0)).alias("heard"))


@query(f"""with recursive {W.words('select unnest("keyTerms").text as t from samples')}, k as (select id, unnest("keyTerms").text as t from samples) select distinct id, p as word
  from (select id, unnest(flatten(list_transform(w, lambda y: string_split(y, '''')))) as p from k join nw using (t)) where p <> ''""")
def txt16_key_words(spark, sf_dir):
    return table(spark, sf_dir, "samples").select("id", F.explode(T.key_words("keyTerms")).alias("word")).distinct()


@query(f"""with recursive {_RUN_WORDS}, ra as (select row_number() over () as r, * from runs where error is null),
  {W.flags('select r, reference, text, "sampleId" from ra')} select "modelId", kind, severity, count(*) as flags from ra join fl using (r) group by all""")
def txt20_critical_flags(spark, sf_dir):
    runs = aggregates.runs_of(spark, sf_dir).filter(A.succeeded()).groupBy("modelId", "sampleId", "reference", "text").agg(F.count(F.lit(1)).alias("n"))
    scored = T.once(K.with_terms(runs, table(spark, sf_dir, "samples")), ["reference", "text", "keyTerms"], f=T.critical_flags("reference", "text", "keyTerms"))
    return scored.select("modelId", "n", F.explode("f").alias("f")).groupBy("modelId", "f.kind", "f.severity").agg(F.sum("n").alias("flags"))


@query(rf"""with {_W}, {_E} select comparison_id, cast(count(case when regexp_matches(token, '^[0-9]+([.,][0-9]+)*$') then 1 end) as bigint) as numbers, cast(count(case
  when {_UNIT_CASE} is not null then 1 end) as bigint) as units,
  cast(count(case when token in {W.DATE_WORDS} then 1 end) as bigint) as dates from e group by all""")
def txt21_numbers_units_dates(spark, sf_dir):
    count = lambda test: F.sum(F.size(F.filter("tokens", test)).cast("long"))
    return _words(spark, sf_dir).filter("tokens is not null").groupBy("comparison_id").agg(
        count(N.is_numeric).alias("numbers"), count(lambda t: N.canonical_unit(t).isNotNull()).alias("units"), F.sum(F.size(N.date_words(F.col("tokens"))).cast("long")).alias("dates")
    )


@query(rf"""with {_W}, {_E}, c as (select comparison_id, count(case when token in {W.NEGATIONS} or token like '%n''t' then 1 end) as strong, count(case when token = 'ne'
  or token like 'n''%' then 1 end) as weak from e group by all)
select comparison_id, cast(case when strong > 0 then strong when weak > 0 then 1 else 0 end as bigint) as negations from c""")
def txt23_negations(spark, sf_dir):
    return _words(spark, sf_dir).filter("tokens is not null").select("comparison_id", N.negation_count(F.col("tokens")).cast("long").alias("negations"))


@query(rf"""with {_W}, {_E}, n as (select comparison_id, side, token, row_number() over (partition by comparison_id, side, token) as i from (
  select comparison_id, 'r' as side, unnest(string_split(normalized_reference, ' ')) as token from w union all select comparison_id, 'h' as side,
  unnest(string_split(normalized_hypothesis, ' ')) as token from w) where regexp_matches(token, '^[0-9]+([.,][0-9]+)*$')),
d as (select coalesce(r.comparison_id, h.comparison_id) as comparison_id, r.token as missing, h.token as extra from (select * from n where side = 'r') r full outer
  join (select * from n where side = 'h') h on r.comparison_id = h.comparison_id and r.token = h.token and r.i = h.i)
select comparison_id, least(count(missing), count(extra)) as changed, greatest(count(missing) - count(extra), 0) as lost, greatest(count(extra) - count(missing), 0)
  as added from d where missing is null or extra is null group by comparison_id""")
def txt22_paired_numbers(spark, sf_dir):
    """Numbers that were changed, lost and added: what is missing and what is extra, paired."""
    once = _words(spark, sf_dir).filter("normalized_reference is not null and normalized_hypothesis is not null")
    picked = lambda c: F.filter(F.split(c, " "), N.is_numeric)
    tokens = once.select("comparison_id", F.explode(F.concat(F.transform(picked("normalized_reference"), lambda t: F.struct(t.alias("t"), F.lit(1).alias("d"))), F.transform(picked("normalized_hypothesis"), lambda t: F.struct(t.alias("t"), F.lit(-1).alias("d"))))).alias("x"))
    by = tokens.groupBy("comparison_id", "x.t").agg(F.sum("x.d").alias("d")).filter("d != 0").groupBy("comparison_id")
    both = by.agg(F.sum(F.greatest(F.col("d"), F.lit(0))).alias("missing"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("extra"))
    more = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    return both.select("comparison_id", F.least("missing", "extra").alias("changed"), more("missing", "extra").alias("lost"), more("extra", "missing").alias("added"))


def _similarities(compared: DataFrame) -> DataFrame:
    return rounded(compared.select("comparison_id", N.similarity(F.col("normalized_reference"), F.col("normalized_hypothesis")).alias("similarity")), 9)


@query(f"""with {_W}, {W.distances("select normalized_reference as a, normalized_hypothesis as b from w")}
select comparison_id, round(case when length(a) + length(b) = 0 then 1.0::double else 1 - distance::double / greatest(length(a), length(b)) end, 9) as similarity from w
  left join nb on a = normalized_reference and b = normalized_hypothesis""")
def txt24_similarity(spark, sf_dir):
    """Of every comparison; null where a text is, 1 where both are empty."""
    return _similarities(spread(_words(spark, sf_dir)))


@query(f"with {_W}, {_E}, p as (select comparison_id, unnest(string_split(token, '''')) as part from e) select part, count(*) as n from p where part <> '' group by all")
def txt25_split_elisions(spark, sf_dir):
    return _words(spark, sf_dir).select(F.explode(N.split_elisions(F.col("tokens"))).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with recursive {_RUN_WORDS}, ra as (select row_number() over () as r, * from runs where error is null),
  {W.flags('select r, reference, text, "sampleId" from ra')} select "modelId", "decoding", kind, count(*) as occurrences, count(case when not found then 1 end) as missed
  from ra join fo using (r) group by all""")
def txt26_27_agg16_key_terms(spark, sf_dir):
    return K.key_term_summary(runs_of(spark, sf_dir), table(spark, sf_dir, "samples"))


@query(f"""with recursive {_RUN_WORDS}, ra as (select row_number() over () as r, * from runs where error is null and repetition = 1),
  {W.flags('select r, reference, text, "sampleId" from ra')} select "modelId", "decoding", kind, count(*) as occurrences, count(case when found then 1 end) as found
  from ra join fo using (r) group by all""")
def agg17_found_from_flags(spark, sf_dir):
    """Terms found and their occurrences by kind, from the messages of flags worked out anew."""
    samples = table(spark, sf_dir, "samples")
    return K.found_from_flags(K.rescored(aggregates.runs_of(spark, sf_dir), samples), samples)


#: Words of pairs of runs that one heard and the other didn't, by position.
_CHANGES = f"""pp as (select row_number() over () as r, l."modelId", l."decoding", l."sampleId", l.repetition, l.reference as lr, l.text as lt, r.reference as rr, r.text as rt,
  r.insertions - l.insertions as more from l join r on l."modelId" = r."modelId" and l."decoding" = r."decoding" and l."sampleId" = r."sampleId"
  and l.repetition = r.repetition),
ws as (select rw.reference, rw.text, a, list_transform(range(1, len(a) + 1), lambda i: coalesce(b[nullif(h[i], 0)], '(missing)')) as heard, list_transform(range(1,
  len(a) + 1), lambda i: h[i] > 0 and a[i] = b[h[i]]) as correct from rw join al using (a, b)),
ks as (select id, list(distinct p) as keys from (select id, unnest(flatten(list_transform(w, lambda y: string_split(y, '''')))) as p from (select id,
  unnest("keyTerms").text as t from samples) k join nw using (t)) where p <> '' group by id),
zz as (select r, "modelId", "decoding", "sampleId", repetition, unnest(range(len(x.a))) as place, unnest(x.a) as reference_word, unnest(x.heard) as baseline,
  unnest(y.heard) as variant, unnest(x.correct) as xc, unnest(y.correct) as yc from pp join ws x on x.reference = lr and x.text = lt join ws y on y.reference = rr
  and y.text = rt where len(x.a) = len(y.a)),
ch as (select r, "modelId", "decoding", "sampleId", repetition, place::int as place, reference_word, baseline, variant, yc as fixed,
  coalesce(len(list_filter(string_split(reference_word, ''''), lambda q: list_contains(keys, q))) > 0, false) as in_key_term from zz left join ks on id = "sampleId"
  where xc <> yc)"""
_STUDIED = f"with recursive {aggregates._PAIRS.removeprefix('with ')}, {_RUN_WORDS}, {_RUN_ALIGNED}, {_CHANGES} "


@query(_STUDIED + """, e as (select "modelId", "decoding", count(*) as pairs, cast(sum(more) as bigint) as insertions_delta from pp group by all)
select "modelId", "decoding", pairs, coalesce(insertions_delta, 0) as insertions_delta, count(case when fixed then 1 end) as fixes, count(case when not fixed then 1 end)
  as regressions, count(case when not fixed and not in_key_term then 1 end) as regressions_outside from e left join ch using ("modelId", "decoding") group by all""")
def agg18_arr02_word_deltas(spark, sf_dir):
    return K.word_deltas(A.pairs_of_runs(*two_runs(spark, sf_dir), _PAIR_KEY, _PAIR_ORDER), table(spark, sf_dir, "samples"))


@query(_STUDIED + """select * exclude (r) from (select *, row_number() over (partition by "modelId", "decoding", fixed order by "sampleId", repetition, place)::int as nth from ch)
  where nth <= 25""")
def win02_changed_words(spark, sf_dir):
    return K.first_examples(K.word_changes(A.pairs_of_runs(*two_runs(spark, sf_dir), _PAIR_KEY, _PAIR_ORDER), table(spark, sf_dir, "samples")))


@query(rf"""with r as (select *, regexp_extract("runId", '^[0-9]+-[0-9]+-(\w+)-', 1) as mode from runs where error is null and repetition = 1),
  {W.loops("select text as t from r union select reference from r")}, {W.endings("select reference, text from r")},
j as (select r.*, a.size > 0 and a.repeats > b.repeats as loop, lost, len(regexp_extract_all(lower(r.text),
  '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+'))::double / greatest(1, "referenceWords") as ratio from r left join lp a on a.t = r.text left join lp b on b.t = r.reference
  left join en on en.reference = r.reference and en.text = r.text)
select "modelId", "decoding", mode, count(*) as samples, round(sum(substitutions + deletions + insertions)::double / nullif(sum("referenceWords"), 0)::double, 9)
  as wer_micro, count(case when wer >= 1 then 1 end) as runaway, count(case when loop then 1 end) as loops, count(case when lost then 1 end) as endings_missing,
  round(min(ratio), 9) as length_ratio_min, round(max(ratio), 9) as length_ratio_max, cast(sum("inferenceMs") as bigint) as inference_ms, cast(sum(coalesce("chunkingMs",
  0)) as bigint) as chunking_ms from j group by all""")
def agg22_chunking_study(spark, sf_dir):
    runs = runs_of(spark, sf_dir).filter(A.first_repetition()).withColumn("mode", F.regexp_extract("runId", "^[0-9]+-[0-9]+-(\\w+)-", 1))
    return rounded(K.chunking_study(runs), 9)


@query()
def agg14_bootstrap(spark, sf_dir):
    return K.bootstrap(runs_of(spark, sf_dir))


@query("""with f as (select * from (select *, row_number() over (partition by "modelId", "decoding", "sampleId" order by "timestampMs" desc, "runId" desc, "ingestedAt" desc) as nth
  from runs where error is null and repetition = 1) where nth = 1),
c as (select "sampleId" from f group by "sampleId" having count(*) = (select count(*) from (select distinct "modelId", "decoding" from f))), t as (select * from f
  where "sampleId" in (select "sampleId" from c))
select "modelId", "decoding", count(*) as samples, round(coalesce(sum(substitutions + deletions + insertions)::double / nullif(sum("referenceWords"), 0)::double, 0), 9)
  as wer, true as within from t group by all""")
def agg14_spread_bootstrap(spark, sf_dir):
    """Rates with intervals whose draws are made where the rows are; the SQL has the rates, which lie within them."""
    found = K.spread_bootstrap(aggregates.runs_of(spark, sf_dir))
    inside = (F.col("low") <= F.col("wer")) & (F.col("wer") <= F.col("high")) & (F.col("diff_low") <= F.col("diff_high"))
    return rounded(found.select(*A.CONFIG, "samples", "wer", inside.alias("within")), 9)


@query()
def agg15_bootstrap_by_language(spark, sf_dir):
    return K.bootstrap_by_language(runs_of(spark, sf_dir))


@query(f"""with recursive {_RUN_WORDS}, {_RUN_ALIGNED}, {_RUN_CHARS}, ra as (select row_number() over () as r, * from runs),
  {W.flags('select r, reference, text, "sampleId" from ra where error is null')},
c as (select reference, text, a, b, {W.COUNTS} from rw join al using (a, b)), g as (select r, count(*) as n, count(case when severity = 'critical' then 1 end) as critical
  from fl group by r)
select "runId", "modelId", "decoding", "sampleId", repetition, case
  when error is null then round((c.substitutions + c.deletions + c.insertions)::double / nullif(len(c.a), 0), 9) end as wer, case
  when error is null then round(nb.distance::double / nullif(length(nb.a), 0), 9) end as cer,
  case when error is null then coalesce(g.critical, 0) > 0 else len(list_filter(ra.critical, lambda f: f.severity = 'critical')) > 0 end as "hasCritical", (case
  when error is null then coalesce(g.n, 0) else len(ra.critical) end)::int as flags
from ra left join c on c.reference = ra.reference and c.text = ra.text left join nb on nb.a = array_to_string(c.a, ' ') and nb.b = array_to_string(c.b, ' ') left
  join g using (r)""")
def rescored_runs(spark, sf_dir):
    return rounded(K.rescored(aggregates.runs_of(spark, sf_dir), table(spark, sf_dir, "samples")).select(*A.RUN_KEY, "wer", "cer", "hasCritical", F.size("critical").alias("flags")), 9)


@query("""select doc_id, cast(len(regexp_extract_all(text, '[\\p{L}\\p{Nd}]')) as bigint) as letters from documents where text is not null and regexp_matches(text,
  '[\\p{L}\\p{Nd}]')""")
def txt30_31_letters_of_sentences(spark, sf_dir):
    """Sentences hold every letter and digit of a text: how many they hold together."""
    docs = spread(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text"))
    said = docs.select("doc_id", F.explode(T.split_sentences("text")).alias("s"))
    letters = F.length(F.regexp_replace("s.text", r"[^\p{L}\p{Nd}]", "")).cast("long")
    return said.groupBy("doc_id").agg(F.sum(letters).alias("letters")).filter("letters > 0")


@query()
def txt30_31_sentences(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").filter("text is not null"))
    return docs.select("doc_id", F.posexplode(T.split_sentences("text")).alias("place", "s")).select("doc_id", "place", "s.start", "s.end", "s.paragraph_end", "s.text")


@query()
def txt50_60_spoken_texts(spark, sf_dir):
    s = spread(table(spark, sf_dir, "samples").select("id", "language", "reference").distinct())
    return s.select("id", T.spoken_text("reference", "language").alias("spoken"))


@query()
def txt32_sentence_plans(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    plan = T.plan_sentences(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")))
    return docs.select("doc_id", F.posexplode(plan).alias("place", "s")).select("doc_id", "place", "s.text", "s.spoken", "s.start", "s.end", "s.paragraph_end")


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term): the samples' key terms, one spelling each, as a vocabulary file would list them."""
    terms = table(spark, sf_dir, "samples").select(F.explode("keyTerms").alias("t")).select(F.col("t.text").alias("term"))
    return terms.groupBy(F.lower("term").alias("k")).agg(F.min("term").alias("term")).select("term")


@query(f"""with recursive {W.corrections("select text as t from transcribe_results", 'select min(term) as term from (select unnest("keyTerms").text as term from samples) group by lower(term)')}
  select "from", "to", distance, count(*) as n from ch group by all""")
def txt40_45_post_corrected(spark, sf_dir):
    done = C.post_corrected(_transcripts(spark, sf_dir).select("text"), _vocabulary(spark, sf_dir))
    changes = done.select(F.explode("changes").alias("c"))
    return changes.groupBy("c.from", "c.to", "c.distance").agg(F.count(F.lit(1)).alias("n"))


_FOLD = "replace(replace(translate(lower({x}), 'àâäáãéèêëîïíôöóõùûüúçÿ', 'aaaaaeeeeiiioooouuuucy'), 'œ', 'oe'), 'æ', 'ae')"
_WINDOWS = rf"""ww as (select distinct list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda y: {_FOLD.format(x="y")}) as w from transcribe_results
  where text is not null),
wk as (select w, unnest([1, 2, 3]) as k from ww), wi as (select w, k, unnest(range(1, len(w) - k + 2)) as i from wk), wx
  as (select distinct array_to_string(w[i:i + k - 1], '') as x from wi),
vt as (select distinct array_to_string(list_transform(regexp_extract_all(t.text, '[\p{{L}}\p{{N}}]+'), lambda y: {_FOLD.format(x="y")}), '') as term
  from (select unnest("keyTerms") as t from samples)), vw as (select term from vt where length(term) >= 6),
cp as (select x, term from wx join vw on substr(x, 1, 1) = substr(term, 1, 1) and abs(length(x) - length(term)) <= 2 where x <> term and length(x) >= 6)"""


@query(f"with {_WINDOWS}, {W.distances('select x as a, term as b from cp')} select a as stretch, b as term, distance from nb where distance <= least(floor(length(b) * 0.17::double), 2)")
def joi10_near_terms(spark, sf_dir):
    """Stretches of up to three words and terms within the allowed distance, blocked by first letter and length."""
    return K.near_terms(_transcripts(spark, sf_dir).select("text").distinct(), table(spark, sf_dir, "samples").select(F.explode("keyTerms.text").alias("term")).distinct(), 3)


@query("""select distinct t.text as term, cast(floor(length(t.text) * 0.17::double) as bigint) as by_length, least(cast(floor(length(t.text) * 0.17::double) as bigint), 2)
  as strict, least(cast(floor(length(t.text) * 0.22::double) as bigint), 2) as medium, least(cast(floor(length(t.text) * 0.3::double) as bigint), 3) as loose
  from (select unnest("keyTerms") as t from samples)""")
def txt41_allowed_distances(spark, sf_dir):
    terms = table(spark, sf_dir, "samples").select(F.explode("keyTerms").alias("t")).select(F.col("t.text").alias("term")).distinct()
    allowed = lambda ratio, most: F.least(F.floor(F.length("term") * ratio), F.lit(most).cast("long"))
    return terms.select("term", F.floor(F.length("term") * 0.17).alias("by_length"), allowed(0.17, 2).alias("strict"), allowed(0.22, 2).alias("medium"), allowed(0.3, 3).alias("loose"))


@query(f"""with {_T} select result_id, replace(replace(translate(lower(text), 'àâäáãéèêëîïíôöóõùûüúçÿ', 'aaaaaeeeeiiioooouuuucy'), 'œ', 'oe'), 'æ', 'ae') as folded from t""")
def txt42_folded_accents(spark, sf_dir):
    return _transcripts(spark, sf_dir).select("result_id", N.fold_accents(F.col("text")).alias("folded"))


@query(rf"""with {_T}, w as (select unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) as token from t), c as (select token, count(*) as n from w group by all)
select token, n, regexp_matches(token, '[0-9]') or lower(token) in {W.NEGATIONS} or lower(token) in {W.DATE_WORDS} or ({W.UNIT})[lower(token)] is not null as protected
  from c""")
def txt43_44_protected_words(spark, sf_dir):
    words = _transcripts(spark, sf_dir).select(F.explode(N.word_list(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return words.select("token", "n", F.coalesce(N.is_protected(F.col("token")), F.lit(False)).alias("protected"))


_DIGITS = ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"]


@query(f"""select result_id, array_to_string(list_transform(string_split(result_id::varchar, ''), lambda c: ([{', '.join(f"'{d}'" for d in _DIGITS)}])[cast(c as integer) + 1]), ' ')
  as said from transcribe_results""")
def txt53_digits_one_by_one(spark, sf_dir):
    return table(spark, sf_dir, "transcribe_results").select("result_id", N.digits_one_by_one(F.col("result_id").cast("string"), _DIGITS).alias("said"))


@query(f"""with {_T}, {W.loops("select text as t from t")} select distinct result_id, repeats, size from t join lp on lp.t = text where size > 0""")
def txt61_loops(spark, sf_dir):
    t = T.once(_transcripts(spark, sf_dir).distinct(), ["text"], r=T.max_repeat("text"))
    return t.filter("r.size > 0").select("result_id", "r.repeats", "r.size").distinct()


@query(f"""with {W.endings("select reference, text from runs where error is null")} select distinct "runId", "modelId", "decoding", "sampleId", repetition from runs
  join en using (reference, text) where error is null and lost""")
def txt62_endings(spark, sf_dir):
    r = aggregates.runs_of(spark, sf_dir).filter(A.succeeded()).select(*A.RUN_KEY, "reference", "text").distinct()
    return T.once(r, ["text", "reference"], lost=T.ending_missing("text", "reference")).filter("lost").select(*A.RUN_KEY)


@query(r"""with t as (select distinct notes || ' ' || category || '/' || id as raw from samples)
select raw, substr(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw, ' ')), '[^a-z0-9_]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 60) as safe from t""")
def txt63_safe_ids(spark, sf_dir):
    raw = table(spark, sf_dir, "samples").select(F.concat("notes", F.lit(" "), "category", F.lit("/"), "id").alias("raw")).distinct()
    return raw.select("raw", N.sanitize_id(F.col("raw")).alias("safe"))


@query(r"""select doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') as cleaned from documents where text is not null""")
def txt64_cleaned_references(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", N.clean_reference(F.col("text")).alias("cleaned"))


@query("""select distinct id, case lower(trim(substr(notes, 1, 3), ' ')) when 'yes' then 'private voice, no redistribution, speaker consent: yes' when 'no' then 'refused'
  else 'private voice, no redistribution, speaker consent: unknown' end as license from samples where private""")
def txt65_consent(spark, sf_dir):
    word = F.lower(F.trim(F.substring("notes", 1, 3)))
    license_text = F.when(word == "yes", "private voice, no redistribution, speaker consent: yes").when(word == "no", "refused").otherwise("private voice, no redistribution, speaker consent: unknown")
    return table(spark, sf_dir, "samples").filter("private").select("id", F.coalesce(license_text, F.lit("private voice, no redistribution, speaker consent: unknown")).alias("license")).distinct()


@query("""select distinct id, array_to_string(list_transform("keyTerms", lambda t: trim(t.text, ' ')), ', ') || '.' as prompt, array_to_string(list_transform("keyTerms",
  lambda t: t.text), '/') as hotwords from samples where len("keyTerms") > 0""")
def txt66_prompts(spark, sf_dir):
    texts = F.transform("keyTerms", lambda t: t["text"])
    return table(spark, sf_dir, "samples").filter(F.size("keyTerms") > 0).select("id", N.vocabulary_prompt(texts).alias("prompt"), F.array_join(texts, "/").alias("hotwords")).distinct()


@query(r"""with v as (select distinct id || ' ' || row_number() over (order by id) as line from models) select line, regexp_extract(line, '^(.*) ([0-9]+)$',
  1) || chr(9) || '-' || regexp_extract(line, '^(.*) ([0-9]+)$', 2) as surrogate from v""")
def txt67_surrogate_vocabulary(spark, sf_dir):
    line = F.concat_ws(" ", "id", F.row_number().over(Window.orderBy("id")))
    part = lambda i: F.regexp_extract("line", "^(.*) ([0-9]+)$", i)
    return table(spark, sf_dir, "models").select(line.alias("line")).select("line", F.concat(part(1), F.lit("\t-"), part(2)).alias("surrogate"))


@query("""select event_id, m.k as key, m.v as value from (select event_id, unnest([{'k': 'k', 'v': cast(json_extract(props, '$.k') as bigint)}]) as m from events)""")
def txt68_token_map(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string, bigint>")).alias("key", "value"))


@query(r"""with t as (select distinct result_id, text from transcribe_results where text is not null), p as (select result_id, unnest(range(1, len(string_split(text, chr(10))) + 1))
  as i, string_split(text, chr(10)) as parts from t)
select result_id, coalesce(string_agg(trim(parts[i], ' '), ' ' order by i) filter (trim(parts[i], ' ') <> ''), '') as cleaned from p group by result_id""")
def src15_joined_lines(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return _transcripts(spark, sf_dir).distinct().select("result_id", F.array_join(lines, " ").alias("cleaned"))


@query(r"""with t as (select result_id, 'load time = ' || load_ms || '.50 ms' || chr(10) || 'total time = ' || processing_ms || '.25 ms' as report from transcribe_results)
select result_id, cast(regexp_extract(report, 'load time\s*=\s*([0-9.]+)', 1) as double) as load_time, cast(regexp_extract(report, 'total time\s*=\s*([0-9.]+)', 1)
  as double) as total_time from t""")
def src14_16_timing_reports(spark, sf_dir):
    report = F.concat(F.lit("load time = "), "load_ms", F.lit(".50 ms\ntotal time = "), "processing_ms", F.lit(".25 ms"))
    read = lambda name: F.regexp_extract("report", name + r"\s*=\s*([0-9.]+)", 1).cast("double")
    return table(spark, sf_dir, "transcribe_results").select("result_id", report.alias("report")).select("result_id", read("load time").alias("load_time"), read("total time").alias("total_time"))


@query(r"""with r as (select distinct "sampleId", lower(reference) as a, lower(text) as b from runs where error is null),
w as (select "sampleId", a, b, regexp_extract_all(a, '[a-zà-ÿ0-9_]+') as ra, regexp_extract_all(b, '[a-zà-ÿ0-9_]+') as rb from r), l as (select "sampleId", a, b,
  unnest(ra[greatest(len(ra) - 7, 1):]) as token, 'r' as side from w union all select "sampleId", a, b, unnest(rb[greatest(len(rb) - 15, 1):]) as token, 'h' as side
  from w),
c as (select "sampleId", a, b, token, count(case when side = 'r' then 1 end) as x, count(case when side = 'h' then 1 end) as y from l group by all)
select "sampleId", a, b, cast(sum(least(x, y)) as bigint) as common, cast(sum(x) as bigint) as wanted from c group by all having sum(x) > 0""")
def set04_common_endings(spark, sf_dir):
    """How many of the last eight reference words stand among the last sixteen of the text."""
    pairs = runs_of(spark, sf_dir).filter(A.succeeded()).select("sampleId", F.lower("reference").alias("a"), F.lower("text").alias("b"), "reference", "text").distinct().drop("reference", "text")
    tail = lambda c, n: F.slice(w(c), F.greatest(F.size(w(c)) - (n - 1), F.lit(1)), F.lit(n))
    w = lambda c: F.regexp_extract_all(c, F.lit("([a-zà-ÿ0-9_]+)"), F.lit(1))
    side = lambda c, n, name: F.transform(tail(c, n), lambda t: F.struct(t.alias("t"), F.lit(name).alias("s")))
    tokens = pairs.distinct().select("sampleId", "a", "b", F.explode(F.concat(side("a", 8, "r"), side("b", 16, "h"))).alias("x"))
    by = tokens.groupBy("sampleId", "a", "b", "x.t").agg(F.count_if(F.col("x.s") == "r").alias("x"), F.count_if(F.col("x.s") == "h").alias("y"))
    return by.groupBy("sampleId", "a", "b").agg(F.sum(F.least("x", "y")).alias("common"), F.sum("x").alias("wanted")).filter("wanted > 0")


@query("""with w as (select distinct comparison_id, string_split(normalized_reference, ' ') as a, string_split(normalized_hypothesis, ' ') as b from text_comparisons
  where normalized_reference is not null and normalized_hypothesis is not null)
select comparison_id, len(list_filter(range(1, greatest(len(b) - 1, 1)), lambda i: b[i] = a[1] and b[i + 1] = a[2] and b[i + 2] = a[3])) > 0 as holds from w
  where len(a) >= 3 and len(b) >= 3""")
def arr01_contiguous_words(spark, sf_dir):
    """Whether the first three words of the reference stand in a row in the text."""
    w = _words(spark, sf_dir).filter("normalized_hypothesis is not null").withColumn("b", F.split("normalized_hypothesis", " ")).filter("size(tokens) >= 3 and size(b) >= 3")
    head = F.slice("tokens", 1, 3)
    return w.select("comparison_id", F.exists(F.sequence(F.lit(1), F.size("b") - 2), lambda i: F.slice("b", i, F.lit(3)) == head).alias("holds"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
