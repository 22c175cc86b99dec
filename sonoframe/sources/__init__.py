"""Readers: run folders, samples, scripts, vocabularies, measurements, audio and model manifests as DataFrames."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe import schemas
from sonoframe.audio import wav

DECODED = "struct<samples: array<float>, sampleRate: int, error: string>"


def _any(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names a file, asked of the file system it lies on."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def json_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One object or one array of objects a file, with its path. A broken file stops the read and is named in the error;
    a pattern without files gives an empty table."""
    out = f"{schema}, file string"
    if not _any(spark, pattern):
        return spark.createDataFrame([], out)
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(pattern)
    return read.withColumn("file", F.col("_metadata.file_path"))


def samples(spark: SparkSession, root: str) -> DataFrame:
    """Public and private samples of a dataset folder, told apart by ``private``; key terms without a kind are terms."""
    both = [json_files(spark, os.path.join(root, d, "*.json"), schemas.SAMPLE).withColumn("private", F.lit(p)) for d, p in (("samples", False), ("samples-private", True))]
    terms = F.transform("keyTerms", lambda t: F.struct(t["text"].alias("text"), F.coalesce(t["kind"], F.lit("term")).alias("kind")))
    empty = {"category": F.coalesce("category", F.lit("")), "notes": F.coalesce("notes", F.lit("")), "committable": F.coalesce("committable", F.lit(False))}
    return both[0].unionByName(both[1]).withColumns({"keyTerms": F.coalesce(terms, F.expr("cast(array() as array<struct<text: string, kind: string>>)"))} | empty)


def scripts(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """Script items; each file holds an array of them."""
    return json_files(spark, os.path.join(root, "scripts", pattern), schemas.SCRIPT)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records, one a line; blank lines count for nothing and columns that old files lack have their defaults."""
    read = spark.read.schema(schemas.RUN).option("mode", "FAILFAST").json(path)
    return schemas.with_run_defaults(read.filter("runId is not null"))


def tts_measures(spark: SparkSession, pattern: str) -> DataFrame:
    """Measurements of speech synthesis from many folders, with the folder's name."""
    read = spark.read.schema(schemas.TTS_MEASURE).json(pattern)
    return read.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))


def clip_results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Result files named <clip>__<model>__<mode>.json, with the parts of their names."""
    read = json_files(spark, pattern, schema)
    parts = F.split(F.regexp_extract("file", r"([^/]+)\.json$", 1), "__")
    return read.withColumns({n: F.try_element_at(parts, F.lit(i)) for i, n in enumerate(("clip", "model", "mode"), 1)})


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of a list: trimmed, without blank lines and comments, in the file's order."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    cleaned = lines.withColumn("text", F.trim(F.regexp_replace(F.trim("text"), "^﻿+", "")))
    return cleaned.filter((F.col("text") != "") & ~F.col("text").startswith("#"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of a vocabulary: of spellings that differ in case the first stays."""
    nth = F.row_number().over(Window.partitionBy(F.lower("text")).orderBy("line"))
    return text_lines(spark, path).withColumn("nth", nth).filter("nth = 1").drop("nth")


def models(spark: SparkSession, path: str, role: str | None = None) -> DataFrame:
    read = spark.read.schema(schemas.MODEL).option("multiLine", True).json(path)
    read = read.withColumns({"role": F.coalesce("role", F.lit("stt")), "packaging": F.coalesce("packaging", F.lit("archive")), "licenseTier": F.coalesce("licenseTier", F.lit("unrated"))})
    return read.filter(F.col("role") == role) if role else read


def decode_wav(content):
    """Column function: WAV bytes to struct(samples, sampleRate, error); what can't be read has null samples and an error."""

    @F.arrow_udf(DECODED)
    def run(column: pa.Array) -> pa.Array:
        out = []
        for data in column:
            try:
                decoded, rate = wav.read(data.as_py() or b"")
                out.append({"samples": decoded.tolist(), "sampleRate": rate, "error": None})
            except wav.WavError as e:
                out.append({"samples": None, "sampleRate": None, "error": str(e)})
        return pa.array(out, pa.struct([("samples", pa.list_(pa.float32())), ("sampleRate", pa.int32()), ("error", pa.string())]))

    return run(content)


def wav_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, modified, samples, sampleRate, durationMs, error) of audio files."""
    read = spark.read.format("binaryFile").load(pattern).withColumn("d", decode_wav("content"))
    ms = F.expr("size(d.samples) * 1000L div d.sampleRate")
    return read.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "d.samples", "d.sampleRate", F.when(F.col("d.samples").isNotNull(), ms).alias("durationMs"), "d.error")


def clips(spark: SparkSession, pattern: str) -> DataFrame:
    """Stored clips that can be read, oldest first."""
    return wav_files(spark, pattern).filter("error is null").select("path", "durationMs", "sampleRate", "bytes", "modified").orderBy("modified", "path")
