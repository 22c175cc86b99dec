"""Queries of sources, sinks and streams: what is written from the test tables is read again."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe import sources, streaming
from sonoframe.operators import aggregates as A
from sonoframe.operators import validation as V
from sonoframe.operators import voices as O
from sonoframe.plans.aggregates import SQL as AGGREGATES
from sonoframe.plans.aggregates import rounded, runs_of
from sonoframe.session import shared_folder, table
from sonoframe.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _local(path: str) -> str:
    return path.removeprefix("file:")


def _as_on_disk(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c != "ingestedAt"))


_RUN = '"runId", "modelId", "decoding", "sampleId", repetition'

# ------------------------------------------------------------------ files that are read


@query("""select distinct id, language, coalesce(domain, '-') as domain, category, "durationMs", reference, private, source.kind as kind, speaker.id as speaker,
  len("keyTerms")::int as terms from samples""")
def src01_sample_files(spark, sf_dir):
    """Samples as files of one object each, in a public and a private folder."""
    root = shared_folder(spark, "samples")
    samples = table(spark, sf_dir, "samples").distinct()
    for folder, private in (("samples", False), ("samples-private", True)):
        samples.filter(F.col("private") == private).drop("private").write.option("maxRecordsPerFile", 1).json(f"{root}/{folder}")
    read = sources.samples(spark, root)
    return read.select("id", "language", F.coalesce("domain", F.lit("-")).alias("domain"), "category", "durationMs", "reference", "private", F.col("source.kind").alias("kind"), F.col("speaker.id").alias("speaker"), F.size("keyTerms").alias("terms"))


@query("""select distinct id, language, category, reference as text, len("keyTerms")::int as terms from samples""")
def src02_script_arrays(spark, sf_dir):
    """Scripts as files of one array each, a file a category and language."""
    root = shared_folder(spark, "scripts")
    item = F.struct("id", "language", "domain", "utteranceType", F.col("reference").alias("text"), "keyTerms", "category")
    arrays = table(spark, sf_dir, "samples").distinct().groupBy("category", "language").agg(F.to_json(F.collect_list(item)).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/scripts")
    read = sources.scripts(spark, root, "*.txt")
    return read.select("id", "language", "category", "text", F.size("keyTerms").alias("terms"))


@query(f"""select {_RUN}, "timestampMs", coalesce("scoringVersion", 1)::int as "scoringVersion", coalesce(chunking, 'off') as chunking, coalesce(segments, 1)::int as segments,
  round(wer, 9) as wer, text, len(critical)::int as flags, error, round(case when not isnan(rtf) then rtf end, 9) as rtf from runs""")
def src04_run_lines(spark, sf_dir):
    """Run records as lines of JSON; columns that old runs lack have their defaults."""
    path = shared_folder(spark, "runs")
    _as_on_disk(table(spark, sf_dir, "runs")).write.json(path)
    read = sources.runs(spark, path)
    return rounded(read.select(*A.RUN_KEY, "timestampMs", "scoringVersion", "chunking", "segments", "wer", "text", F.size("critical").alias("flags"), "error", A.number("rtf").alias("rtf")), 9)


@query("""select 'provider=' || provider_id as folder, model_id as voice, language as lang, decoding as mode, count(*) as n, cast(sum(processing_ms) as bigint) as generation_ms,
  count(case when cold_start then 1 end) as cold from transcribe_results group by all""")
def src07_measurements(spark, sf_dir):
    """Measurements of many folders as lines of JSON."""
    root = shared_folder(spark, "measures")
    t = table(spark, sf_dir, "transcribe_results").select(
        F.col("provider_id").alias("provider"), F.col("model_id").alias("voice"), F.col("language").alias("lang"), F.col("decoding").alias("mode"), F.col("processing_ms").alias("generationMs"),
        F.col("audio_ms").alias("audioMs"), "rtf", F.col("load_ms").alias("loadMs"), F.col("cold_start").alias("cold"), F.col("peak_memory_mb").alias("peakMemoryMb"),
    )
    t.write.partitionBy("provider").json(root)
    read = sources.tts_measures(spark, f"{root}/*/*.json")
    return read.groupBy("folder", "voice", "lang", "mode").agg(F.count(F.lit(1)).alias("n"), F.sum("generationMs").alias("generation_ms"), F.count_if("cold").alias("cold"))


@query("""select family as clip, id as model, role as mode, "sizeMb" as size_mb from models""")
def src08_clip_results(spark, sf_dir):
    """Result files whose key is their name; the table is that of the models, which is fixed."""
    root = shared_folder(spark, "clips")
    for r in table(spark, sf_dir, "models").select("id", "family", "role", F.to_json(F.struct("sizeMb")).alias("j")).collect():
        sources.write_text(spark, f"{root}/{r['family']}__{r['id']}__{r['role']}.json", r["j"])
    return sources.clip_results(spark, f"{root}/*.json", "sizeMb double").select("clip", "model", "mode", F.col("sizeMb").alias("size_mb"))


@query("""with t as (select distinct trim(unnest("keyTerms").text) as term from samples where language = 'fr'), s as (select term from t where term <> '' and term not like '#%')
select kind, term from (select 'list' as kind, term from s union all select 'vocabulary', min(term) from s group by lower(term))""")
def src09_10_term_lists(spark, sf_dir):
    """A list of terms as a text file with a mark, comments and blanks; read as a list, and as a vocabulary of one spelling each."""
    path = f"{shared_folder(spark, 'terms')}"
    term = table(spark, sf_dir, "samples").filter("language = 'fr'").select(F.explode("keyTerms").alias("t")).select(F.col("t.text").alias("term")).distinct()
    lines = term.agg(F.array_sort(F.collect_list("term")).alias("terms"))  # a vocabulary file is one text
    lines.select(F.concat(F.lit("﻿# comment\r\n\r\n  "), F.array_join("terms", "  \r\n\r\n  ")).alias("value")).write.text(path)
    read = [sources.text_lines(spark, path).withColumn("kind", F.lit("list")), sources.vocabulary(spark, path).withColumn("kind", F.lit("vocabulary"))]
    return read[0].unionByName(read[1]).select("kind", F.col("text").alias("term"))


_HEARD = "list_transform(embedding, lambda x: trunc(x * 32767::float + case when x < 0 then -0.5::float else 0.5::float end) / 32768.0::double)"


@query(f"""with w as (select vec_id, {_HEARD} as s from embeddings) select vec_id, len(s)::int as n, len(s) * 1000 // 16000 as duration_ms, 44 + 2 * len(s) as bytes,
  round(list_sum(s), 9) as total, round(s[1], 9) as first, round(s[-1], 9) as last from w""")
def src11_snk06_audio(spark, sf_dir):
    """Audio written as 16-bit files and decoded again."""
    folder = shared_folder(spark, "audio")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("samples"), F.lit(16_000).alias("sampleRate"))
    sinks.write_wavs(e, _local(folder))
    read = sources.wav_files(spark, f"{folder}/*.wav").filter("error is null")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    at = lambda i: F.element_at("samples", i).cast("double")
    return rounded(read.select(F.regexp_extract("path", "([0-9]+)[.]wav$", 1).cast("long").alias("vec_id"), F.size("samples").alias("n"), F.col("durationMs").alias("duration_ms"), "bytes", total.alias("total"), at(1).alias("first"), at(-1).alias("last")), 9)


@query("""with s as (select vec_id, row_number() over (order by vec_id) as place from embeddings where label % 2 = 0) select vec_id, 1000::int as rate, 'clip' as kind from s""")
def src12_stored_clips(spark, sf_dir):
    """Stored clips that can be read; what isn't audio is left out."""
    folder = shared_folder(spark, "stored")
    e = table(spark, sf_dir, "embeddings")
    sinks.write_wavs(e.filter("label % 2 = 0").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("samples"), F.lit(1000).alias("sampleRate")), _local(folder))
    sources.write_text(spark, f"{folder}/broken.wav", "RIFF but no audio")
    listed = sources.clips(spark, f"{folder}/*.wav")
    return listed.select(F.regexp_extract("path", "([0-9]+)[.]wav$", 1).cast("long").alias("vec_id"), F.col("sampleRate").alias("rate"), F.lit("clip").alias("kind"))


@query("""select result_id, trim(regexp_extract(text, '^[^\n]*')) as text, '/out/' || sample_id || '.wav' as wav, round(case when rtf is not null
  and not isnan(rtf) then cast(printf('%.3f', rtf) as double) end, 3) as rtf from transcribe_results where text is not null and trim(regexp_extract(text,
  '^[^\n]*')) <> ''""")
def src16_printed_results(spark, sf_dir):
    """Text, file and real-time factor from what a command printed."""
    t = table(spark, sf_dir, "transcribe_results").filter("text is not null")
    first = F.trim(F.substring_index("text", "\n", 1))
    rtf = F.coalesce(F.concat(F.lit("RTF "), F.format_string("%.3f", A.number("rtf"))), F.lit("no time"))
    printed = F.concat(F.lit("loaded\n  text: "), first, F.lit("\nwrote -> /out/"), "sample_id", F.lit(".wav ("), F.when(A.number("rtf").isNotNull(), rtf).otherwise("no time"), F.lit(")\n"))
    return t.filter(first != "").select("result_id", O.scraped(printed).alias("r")).select("result_id", "r.text", "r.wav", F.round("r.rtf", 3).alias("rtf"))


# ------------------------------------------------------------------ files that are written


_DECIMALS = {"wer_micro": 4, "wer_macro": 4, "cer_macro": 4, "rtf_median": 3, "inference_ms_median": 0, "inference_ms_p95": 0, "load_ms_cold_median": 0, "peak_memory_mb_max": 0, "avg_cores_median": 2}
_PLAIN = {"modelId": "model", "decoding": "decoding", "group": "group"}
_COUNTS = ("samples", "runs", "failures", "runaway_outputs", "samples_with_critical", "critical_flags", "unstable_samples")


@query(
    f"select {', '.join([*(f'coalesce(x."{a}", \'\') as "{b}"' for a, b in _PLAIN.items()), *(f'{c}::varchar as {c}' for c in _COUNTS), *(f"coalesce(printf('%.{n}f', {c}::double), '') as {c}" for c, n in _DECIMALS.items())])} from ({AGGREGATES['agg01_summary']}) x"
)
def snk01_02_summary_csv(spark, sf_dir):
    """The summary of a written run folder, as its CSV file has it."""
    folder = shared_folder(spark, "run")
    sinks.write_run_folder(_as_on_disk(runs_of(spark, sf_dir)), _local(folder), {"cpus": 8}, {"repetitions": 3})
    text = spark.read.text(f"{folder}/summary.csv", wholetext=True).first()[0]
    rows = list(csv.reader(io.StringIO(text)))
    return spark.createDataFrame([tuple(r) for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0]))


_MEASURES = """m as (select model_id as voice, unicode(sample_id[-1]) % 7 as sentence, decoding as mode, processing_ms as ms, audio_ms as audio, rtf, load_ms, cold_start as cold,
  peak_memory_mb as peak from transcribe_results)"""


@query(f"""with {_MEASURES}, s as (select voice, sentence, count(*) as n, median(ms) as generation, median(audio) as audio, median(case when not isnan(rtf) then rtf end) as rtf
  from m where not cold group by all), v as (select voice, max(load_ms) as load_max, max(peak) as peak_max from m group by all),
o as (select voice, sentence, median(case when mode = 'greedy search' then ms end) as whole, median(case when mode = 'beam search (5 beams)' then ms end) as pieces from m
  where not cold group by all)
select 'summary' as part, voice, sentence::bigint as sentence, n, round(generation, 6) as a, round(audio, 6) as b, round(rtf, 6) as c, round(peak_max, 6) as d from s
  join v using (voice)
union all select 'overhead', voice, sentence, null, round(whole, 6), round(pieces, 6), round((pieces - whole) * 100 / whole, 6), null from o where whole > 0
  and pieces is not null""")
def snk09_measure_tables(spark, sf_dir):
    """Summary and overhead of written measurements, as their CSV files have them."""
    folder = shared_folder(spark, "measured")
    t = table(spark, sf_dir, "transcribe_results").select(
        F.col("model_id").alias("voice"), (F.ascii(F.substring("sample_id", -1, 1)) % 7).cast("long").alias("sentence"), F.col("decoding").alias("mode"), F.col("processing_ms").alias("generationMs"),
        F.col("audio_ms").alias("audioMs"), "rtf", F.col("load_ms").alias("loadMs"), F.col("cold_start").alias("cold"), F.col("peak_memory_mb").alias("peakMemoryMb"),
    )
    sinks.write_measures(t, folder, "greedy search", "beam search (5 beams)")
    read = lambda name, shape: spark.read.schema(shape).option("header", True).csv(f"{folder}/{name}.csv")
    summary = read("summary", "voice string, sentence long, n long, generation double, audio double, rtf double, load_max long, peak_max double")
    overhead = read("overhead", "voice string, sentence long, whole double, pieces double, overhead_percent double")
    none = lambda kind: F.lit(None).cast(kind)
    parts = summary.select(F.lit("summary").alias("part"), "voice", "sentence", "n", F.col("generation").alias("a"), F.col("audio").alias("b"), F.col("rtf").alias("c"), F.col("peak_max").alias("d"))
    return rounded(parts.unionByName(overhead.select(F.lit("overhead").alias("part"), "voice", "sentence", none("long").alias("n"), F.col("whole").alias("a"), F.col("pieces").alias("b"), F.col("overhead_percent").alias("c"), none("double").alias("d"))))


@query(f"""select {_RUN}, 2::int as "scoringVersion", text, wer from runs""")
def snk07_rescored_copy(spark, sf_dir):
    """Rescored records beside the old ones."""
    folder = shared_folder(spark, "rescored")
    path = sinks.write_rescored(_as_on_disk(table(spark, sf_dir, "runs")), folder, 2)
    return sources.runs(spark, path).select(*A.RUN_KEY, "scoringVersion", "text", "wer")


@query("""select "modelId" as model, "decoding", "sampleId" as sample, f.expected as "from", f.found as "to", count(*) as n from (select "modelId", "decoding", "sampleId",
  unnest(critical) as f from runs where error is null) where f.found is not null group by all""")
def snk08_change_log(spark, sf_dir):
    """A line a change, written and read; the changes are what the flags of a record expected and found."""
    path = shared_folder(spark, "changes")
    changes = F.transform(F.filter("critical", lambda f: f["found"].isNotNull()), lambda f: F.struct(f["expected"].alias("from"), f["found"].alias("to"), F.lit(1).alias("distance")))
    ok = runs_of(spark, sf_dir).filter(A.succeeded()).select(F.col("modelId").alias("model"), "decoding", F.col("sampleId").alias("sample"), changes.alias("changes"))
    sinks.change_log(ok, path)
    read = spark.read.schema("model string, decoding string, sample string, `from` string, `to` string, distance bigint").json(path)
    return read.groupBy("model", "decoding", "sample", "from", "to").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select {_RUN}, wer, "inferenceMs" from runs""")
def snk10_without_texts(spark, sf_dir):
    """Records as they may be shown: nobody's words are among the columns."""
    shown = sinks.without_texts(runs_of(spark, sf_dir))
    if {"text", "rawText", "reference", "critical"} & set(shown.columns):
        raise AssertionError("texts are left")
    return shown.select(*A.RUN_KEY, "wer", "inferenceMs")


# ------------------------------------------------------------------ validation


_AUDIO = """s as (select distinct id, "audioFile", "durationMs" from samples), a as (select sample_id || '.wav' as f, max(audio_ms) as ms, case
  when max(audio_ms) is null then 'no samples' end as error from transcribe_results group by all)"""


def _audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio as measured by the engines that had it."""
    by = table(spark, sf_dir, "transcribe_results").groupBy("sample_id").agg(F.max("audio_ms").alias("durationMs"))
    return by.select(F.concat("sample_id", F.lit(".wav")).alias("audioFile"), "durationMs", F.when(F.col("durationMs").isNull(), "no samples").alias("error"))


@query(f"""with {_AUDIO} select id, case when f is null then 'audio file is missing: ' || "audioFile" else 'audio can''t be read: ' || error end as message from s left
  join a on f = "audioFile" where f is null or error is not null""")
def val03_audio_issues(spark, sf_dir):
    samples = table(spark, sf_dir, "samples").select("id", "audioFile", "durationMs").distinct()
    return V.audio_issues(samples, _audio(spark, sf_dir))[1]


@query(f"""with {_AUDIO} select id, coalesce(ms, "durationMs") as "durationMs" from s left join a on f = "audioFile" """)
def val03_measured_durations(spark, sf_dir):
    samples = table(spark, sf_dir, "samples").select("id", "audioFile", "durationMs").distinct()
    return V.audio_issues(samples, _audio(spark, sf_dir))[0].select("id", "durationMs")


@query("""with s as (select distinct * from samples) select id, case when trim(coalesce(id, '')) = '' or not regexp_full_match(id, '[a-z0-9_]+(-[a-z0-9_]+)*')
  or length(id) > 60 then 'id must be lower-case letters, digits, - and _'
  when trim(coalesce(speaker.id, '')) = '' then 'speaker is missing' when trim(coalesce(speaker.profile, '')) = '' then 'speaker profile is missing'
  when trim(coalesce(source.license, '')) = '' then 'license is missing'
  when trim(coalesce(reference, '')) = '' then 'reference is empty' when not private and source.kind = 'public-domain' and trim(coalesce(source.url,
  '')) = '' then 'a public recording needs its address'
  when language is null or language not in ('fr', 'en') then 'unknown language' when domain is null or domain not in ('general', 'medical', 'legal', 'administrative',
  'it', 'dictation', 'technical') then 'unknown domain'
  when "utteranceType" is null or "utteranceType" not in ('statement', 'question', 'command', 'paragraph', 'dictation') then 'unknown utterance type'
  when source.kind is null or source.kind not in ('own-recording', 'synthetic', 'public-domain', 'licensed', 'third-party-private') then 'unknown source kind'
  when source.kind = 'third-party-private' and not private then 'third-party recording must be private' when source.kind = 'third-party-private'
  and committable then 'third-party recording must not be committable' end as message from s""")
def val04_import_checks(spark, sf_dir):
    return V.first_broken_rule(table(spark, sf_dir, "samples").distinct())


@query("""select doc_id, case when strlen(coalesce(text, '')) not between 44 and 209715200 then 'size is outside the accepted range' when substr(text, 1, 4) = 'RIFF'
  and substr(text, 9, 4) = 'WAVE' then null else 'not a WAV file' end as verdict from documents""")
def val08_clip_uploads(spark, sf_dir):
    """What becomes of the documents if they are sent as clips."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", V.clip_verdict(content).alias("verdict"))


# ------------------------------------------------------------------ voices


@query(r"""with v as (select distinct model_id || ':' || (threads - 2) as voice, model_id as name from transcribe_results union select distinct id, family from models)
select voice, case when regexp_full_match(voice, '.*:[0-9]+') then regexp_extract(voice, '^(.*):([0-9]+)$', 1) end as model, case when regexp_full_match(voice,
  '.*:[0-9]+') then cast(regexp_extract(voice, '^(.*):([0-9]+)$', 2) as integer) end as speaker,
  case when name[1] in ('a', 'b') then 'en' when name[1] = 'f' then 'fr' end as language, case name[2] when 'f' then 'female' when 'm' then 'male' else 'unknown' end
  as gender from v""")
def prj04_voices(spark, sf_dir):
    """Voice ids, some without a speaker or with a negative one, and what the letters of their names tell."""
    named = table(spark, sf_dir, "transcribe_results").select(F.concat_ws(":", "model_id", F.col("threads") - 2).alias("voice"), F.col("model_id").alias("name"))
    v = named.unionByName(table(spark, sf_dir, "models").select(F.col("id").alias("voice"), F.col("family").alias("name"))).distinct()
    id = O.parsed_id(F.col("voice"))
    return v.select("voice", id["model"].alias("model"), id["speaker"].alias("speaker"), O.language_of(F.col("name")).alias("language"), O.gender_of(F.col("name")).alias("gender"))


@query("""with q as (select distinct model_id as model, threads as speaker from transcribe_results union select id, 3 from models), v as (select distinct model_id as model, threads
  as speaker from transcribe_results where cold_start and threads <> 4),
f as (select model, min(speaker) as first, max(speaker) + 1 as speakers from v group by model), m as (select q.model, q.speaker, case
  when v.speaker is not null then q.speaker when d.family in ('brume', 'tarn') and q.speaker < f.speakers then f.first end as listed, f.speakers from q left
  join v using (model, speaker) left join f on f.model = q.model left join models d on d.id = q.model)
select model, speaker, listed, case when speakers is null then 'unknown model ' || model when listed is null then 'voice ' || model || ' has no speaker ' || speaker end
  as error from m""")
def joi12_selected_voices(spark, sf_dir):
    """The voice of the speaker asked for, or the first listed one of a model that takes any speaker."""
    t = table(spark, sf_dir, "transcribe_results")
    models = table(spark, sf_dir, "models").select(F.col("id").alias("model"), F.col("family").isin("brume", "tarn").alias("any_speaker"))
    asked = t.select(F.col("model_id").alias("model"), F.col("threads").alias("speaker")).union(models.select("model", F.lit(3))).distinct()
    listed = t.filter("cold_start and threads != 4").select(F.col("model_id").alias("model"), F.col("threads").alias("speaker")).distinct()
    many = listed.groupBy("model").agg((F.max("speaker") + 1).alias("speakers"))
    voices = O.listed_order(listed.join(many, "model").join(models, "model", "left"), "model", "speaker")
    return O.selected(asked, voices).select("model", "speaker", "listed", "error")


@query("""with c as (select distinct language, unnest(string_split(reference, '')) as symbol from samples) select language, symbol || ' ' || unicode(symbol) as line from c
  where symbol <> ''""")
def txt68_voice_tokens(spark, sf_dir):
    """The token files of two voices, a line a symbol, from their JSON."""
    symbols = table(spark, sf_dir, "samples").select("language", F.explode(F.split("reference", "")).alias("s")).filter("s != ''").distinct()
    configs = symbols.groupBy("language").agg(F.map_from_entries(F.collect_list(F.struct("s", F.array(F.expr("ascii(s)"), F.lit(0))))).alias("m"))  # an alphabet a language
    json = F.to_json(F.struct(F.col("m").alias("phoneme_id_map")))
    return configs.select("language", F.explode(O.token_lines(json)).alias("line"))


@query("""select id as model, 'vits' as model_type, 'piper' as comment, family as language, languages[1] as voice, 1::int as has_espeak, greatest(len(languages) - 1, 1)::int
  as n_speakers, floor("sizeMb")::int as sample_rate from models""")
def src17_txt68_voice_metadata(spark, sf_dir):
    """Metadata of voices from their nested JSON."""
    config = F.to_json(F.struct(F.struct(F.col("family").alias("name_english")).alias("language"), F.struct(F.col("languages")[0].alias("voice")).alias("espeak"), (F.size("languages") - 1).alias("num_speakers"), F.struct(F.floor("sizeMb").alias("sample_rate")).alias("audio")))
    return table(spark, sf_dir, "models").select(F.col("id").alias("model"), O.metadata(config).alias("m")).select("model", "m.*")


#: Months in order, French and English.
_MONTHS = {
    "fr": ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"],
    "en": ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"],
}


@query(r"""with w as (select language, unnest(regexp_extract_all(lower(text), '\p{L}+')) as word from transcribe_results where text is not null),
m as (select language, word, case language when 'fr' then list_position(['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre',
  'novembre', 'décembre'], word) else list_position(['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november',
  'december'], word) end as month from w)
select language, word, month::int as month, count(*) as n from m where month > 0 group by all""")
def dat02_months(spark, sf_dir):
    """The months that the texts name, by their number."""
    words = table(spark, sf_dir, "transcribe_results").select("language", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    place = lambda names: F.array_position(F.array(*map(F.lit, names)), F.col("word")).cast("int")
    month = F.when(F.col("language") == "fr", place(_MONTHS["fr"])).otherwise(place(_MONTHS["en"]))
    counted = words.groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("month", month).filter("month > 0").select("language", "word", "month", "n")


# ------------------------------------------------------------------ streams


def _events_folder(spark: SparkSession, sf_dir: str) -> str:
    folder = shared_folder(spark, "events")
    table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at")).write.parquet(folder)
    return folder


def _streamed(spark: SparkSession, result: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of all that is there, from a table in memory."""
    checkpoint = shared_folder(spark, "stream")
    name = "stream_" + checkpoint[-32:]
    streaming.run_available(result, name, checkpoint, mode)
    return spark.table(name)


def _streamed_files(spark: SparkSession, result: DataFrame, folder: str, after: str) -> DataFrame:
    """The windows or sessions of a folder's events from files, closed by one more event. A stream without a limit of files takes
    all in its first batch, where none is late."""
    streaming.closing(spark.read.parquet(folder), "at", after).write.mode("append").parquet(folder)
    out = shared_folder(spark, "closed")
    streaming.write_available(result, out, shared_folder(spark, "stream"))
    return spark.read.schema(result.schema).parquet(out)


@query("""select "modelId", "decoding", count(*) as runs, count(case when error is not null then 1 end) as failures, cast(sum(case when error is null
  and repetition = 1 then substitutions + deletions + insertions end) as bigint) as word_errors, cast(sum(case when error is null
  and repetition = 1 then "referenceWords" end) as bigint) as words from runs group by all""")
def str01_running_rates(spark, sf_dir):
    """Rates of each configuration from a stream of written records."""
    folder = shared_folder(spark, "arriving")
    _as_on_disk(table(spark, sf_dir, "runs")).write.json(folder)
    return _streamed(spark, streaming.running_rates(streaming.run_records(spark, folder)))


@query("""select epoch_us(time_bucket(interval 10 minutes, ts)) // 1000 as "start", user_id, count(*) as n from events group by all""")
def str02_streamed_windows(spark, sf_dir):
    folder = _events_folder(spark, sf_dir)
    stream = spark.readStream.schema("event_id long, user_id long, at timestamp").parquet(folder)
    counted = _streamed_files(spark, streaming.tumbling(stream, "at", "10 minutes", "user_id"), folder, "10 minutes")
    return counted.select(F.unix_millis("window.start").alias("start"), "user_id", "n")


@query("""with e as (select user_id, epoch_us(ts) // 1000 as ms from events), g as (select *, case when ms - lag(ms) over w < 3600000 then 0 else 1 end as fresh from e window w
  as (partition by user_id order by ms)), n as (select *, sum(fresh) over (partition by user_id order by ms rows unbounded preceding) as island from g)
select user_id, min(ms) as "start", max(ms) + 3600000 as "end", count(*) as n from n group by user_id, island""")
def str04_streamed_sessions(spark, sf_dir):
    folder = _events_folder(spark, sf_dir)
    stream = spark.readStream.schema("event_id long, user_id long, at timestamp").parquet(folder)
    counted = _streamed_files(spark, streaming.sessions(stream, "at", "1 hour", "user_id"), folder, "1 hour")
    return counted.select("user_id", F.unix_millis("session_window.start").alias("start"), F.unix_millis("session_window.end").alias("end"), "n")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
