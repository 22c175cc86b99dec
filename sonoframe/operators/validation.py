"""Data quality rules of samples, in long form: one row for each rule that a sample breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the fields of a sample may hold.
CHOICES = {
    "language": ("unknown language", ["fr", "en"]),
    "domain": ("unknown domain", ["general", "medical", "legal", "administrative", "it", "dictation", "technical"]),
    "utteranceType": ("unknown utterance type", ["statement", "question", "command", "paragraph", "dictation"]),
    "source.kind": ("unknown source kind", ["own-recording", "synthetic", "public-domain", "licensed", "third-party-private"]),
}


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) == ""


def sample_issues(samples: DataFrame) -> DataFrame:
    """(id, message). Second and later rows of an id count as duplicates."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("reference", "audioFile"))
    third_party = F.col("source.kind") == "third-party-private"
    rules = [
        (F.col("__nth") > 1, "duplicate id"),
        *((F.col(c).isNull() | ~F.col(c).isin(allowed), message) for c, (message, allowed) in CHOICES.items()),
        (_blank("reference"), "reference is empty"),
        (_blank("source.license"), "license is missing"),
        (third_party & ~F.col("private"), "third-party recording must be private"),
        (third_party & F.col("committable"), "third-party recording must not be committable"),
        (F.col("durationMs").isNull(), "audio duration is missing"),
    ]
    broken = F.filter(F.array(*(F.when(rule, F.lit(message)) for rule, message in rules)), lambda m: m.isNotNull())
    return samples.withColumn("__nth", nth).select("id", F.explode(broken).alias("message"))


def runnable(samples: DataFrame, issues: DataFrame) -> DataFrame:
    """Samples without an issue of their recording or id."""
    stopping = issues.filter(F.col("message").rlike("audio|WAV|duplicate")).select("id").distinct()
    return samples.join(stopping, "id", "left_anti")


def audio_issues(samples: DataFrame, audio: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples held against the audio files that are there: (samples with measured durations, issues).

    ``audio`` has audioFile, durationMs and error. The measured duration replaces the stored one; a missing file and one that
    can't be read are issues (id, message), and leave the stored duration.
    """
    known = audio.groupBy("audioFile").agg(F.max("durationMs").alias("__measured"), F.max("error").alias("__error"), F.lit(True).alias("__there"))
    met = samples.join(known, "audioFile", "left")
    message = F.when(F.col("__there").isNull(), F.concat(F.lit("audio file is missing: "), F.coalesce("audioFile", F.lit("")))).when(F.col("__error").isNotNull(), F.concat(F.lit("audio can't be read: "), "__error"))
    issues = met.select("id", message.alias("message")).filter("message is not null")
    measured = F.when(F.col("__error").isNull(), F.col("__measured"))
    return met.withColumn("durationMs", F.coalesce(measured, "durationMs")).select(*samples.columns), issues


#: Sizes in bytes that a stored clip may have.
SMALLEST_CLIP, LARGEST_CLIP = 44, 200 * 1024 * 1024


def clip_verdict(content: Column) -> Column:
    """Why a clip is refused (size, or no WAV), null where it is accepted."""
    size = F.octet_length(content)
    at = lambda i: F.substring(content, i, 4)
    magic = (at(1) == F.lit(b"RIFF")) & (at(9) == F.lit(b"WAVE"))
    return F.when(~size.between(SMALLEST_CLIP, LARGEST_CLIP), "size is outside the accepted range").when(~magic, "not a WAV file")


def first_broken_rule(samples: DataFrame) -> DataFrame:
    """(id, message): for each sample the first rule of an import that it breaks, in the order in which they are checked; null
    where it may be imported."""
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce("id", F.lit("")))), "[^a-z0-9_]", "-"), "-+", "-")
    rules = [
        (empty("id") | (F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 60) != F.col("id")), "id must be lower-case letters, digits, - and _"),
        (empty("speaker.id"), "speaker is missing"), (empty("speaker.profile"), "speaker profile is missing"), (empty("source.license"), "license is missing"), (empty("reference"), "reference is empty"),
        (~F.col("private") & (F.col("source.kind") == "public-domain") & empty("source.url"), "a public recording needs its address"),
        *((F.col(c).isNull() | ~F.col(c).isin(allowed), message) for c, (message, allowed) in CHOICES.items()),
        ((F.col("source.kind") == "third-party-private") & ~F.col("private"), "third-party recording must be private"),
        ((F.col("source.kind") == "third-party-private") & F.col("committable"), "third-party recording must not be committable"),
    ]
    return samples.select("id", F.coalesce(*(F.when(rule, F.lit(message)) for rule, message in rules)).alias("message"))
