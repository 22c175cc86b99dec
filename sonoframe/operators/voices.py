"""Voices of speech synthesis: their ids, which one a request gets, their token tables, and what command lines print of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_METADATA = "struct<num_speakers: int, language: struct<name_english: string>, espeak: struct<voice: string>, audio: struct<sample_rate: int>>"


def parsed_id(voice: Column) -> Column:
    """struct(model, speaker) of model:speaker, parted at the last colon; null where the speaker is no whole number from 0 up."""
    part = lambda i: F.regexp_extract(voice, "(?s)^(.*):([+]?[0-9]+)$", i)
    speaker = part(2).try_cast("int")
    return F.when(speaker.isNotNull(), F.struct(part(1).alias("model"), speaker.alias("speaker")))


def language_of(name: Column) -> Column:
    """Language by the first letter of a voice's name, null where it tells none."""
    first = F.substring(name, 1, 1)
    return F.when(first.isin("a", "b"), "en").when(first == "f", "fr")


def gender_of(name: Column) -> Column:
    second = F.substring(name, 2, 1)
    return F.when(second == "f", "female").when(second == "m", "male").otherwise("unknown")


def selected(requests: DataFrame, voices: DataFrame) -> DataFrame:
    """Requests (model, speaker, ...) with listed, the speaker number of the voice that each gets, and error.

    ``voices`` has model, place, speaker, speakers (how many the model has) and any_speaker. It is the voice of that speaker;
    models with any_speaker take their first listed voice for a speaker below ``speakers`` that isn't listed. Otherwise, and
    where the model is unknown, listed is null and error says so.
    """
    exact = voices.select("model", "speaker", F.lit(True).alias("__exact")).distinct()
    first = voices.groupBy("model").agg(F.min(F.struct("place", "speaker")).getField("speaker").alias("__first"), F.max("speakers").alias("__speakers"), F.bool_or("any_speaker").alias("__any"))
    met = requests.join(exact, ["model", "speaker"], "left").join(first, "model", "left")
    listed = F.when(F.col("__exact"), F.col("speaker")).when(F.col("__any") & (F.col("speaker") < F.col("__speakers")), F.col("__first"))
    error = F.when(F.col("__speakers").isNull(), F.concat(F.lit("unknown model "), "model")).when(F.col("listed").isNull(), F.concat_ws(" ", F.lit("voice"), "model", F.lit("has no speaker"), "speaker"))
    return met.withColumn("listed", listed).withColumn("error", error).drop("__exact", "__first", "__speakers", "__any")


def scraped(stdout: Column) -> Column:
    """struct(text, wav, rtf) that a command printed; null where it printed none."""
    found = lambda pattern: F.when(stdout.rlike(pattern), F.trim(F.regexp_extract(stdout, pattern, 1)))
    return F.struct(found(r"(?m)^[ \t]*text: (.*)$").alias("text"), found(r"-> (.+\.wav)").alias("wav"), found("RTF ([0-9.]+)").try_cast("double").alias("rtf"))


def token_lines(config: Column) -> Column:
    """The lines of a token file, "symbol id", from the phoneme_id_map of a voice's JSON; each symbol's first id counts."""
    ids = F.from_json(F.get_json_object(config, "$.phoneme_id_map"), "map<string, array<int>>")
    return F.transform(F.map_entries(ids), lambda e: F.concat_ws(" ", e["key"], e["value"][0].cast("string")))


def metadata(config: Column) -> Column:
    """What an engine wants to know of a voice, from its JSON: one speaker where none are named."""
    read = F.from_json(config, _METADATA)
    return F.struct(
        F.lit("vits").alias("model_type"), F.lit("piper").alias("comment"), read["language"]["name_english"].alias("language"), read["espeak"]["voice"].alias("voice"), F.lit(1).alias("has_espeak"),
        F.greatest(F.coalesce(read["num_speakers"], F.lit(1)), F.lit(1)).alias("n_speakers"), read["audio"]["sample_rate"].alias("sample_rate"),
    )


def shuffled_codes(voices: DataFrame, by: str, name: str, seed: int, most: int = 676) -> DataFrame:
    """(by, name, code): the names of each group in a seeded order of Python's generator, one alphabet of codes over all.

    The order is that generator's, so that it is made on the driver; as a listening test it is bounded by its codes, A to ZZ.
    More are an error.
    """
    import random

    rows = voices.select(by, name).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a listening test has at most {most} voices")
    generator, out = random.Random(seed), []
    for group in sorted({r[by] for r in rows}, reverse=True):
        names = sorted(r[name] for r in rows if r[by] == group)
        generator.shuffle(names)
        out += [(group, n) for n in names]
    letter = lambda i: (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)
    return voices.sparkSession.createDataFrame([(g, n, letter(i)) for i, (g, n) in enumerate(out)], f"`{by}` string, `{name}` string, code string")


def listed_order(voices: DataFrame, model: str, speaker: str) -> DataFrame:
    """voices with place, their order within a model."""
    return voices.withColumn("place", F.row_number().over(Window.partitionBy(model).orderBy(speaker)))
