"""Schemas of the records on disk, and the values that stand for columns which old files lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAG = "struct<kind: string, severity: string, expected: string, found: string, message: string>"
KEY_TERM = "struct<text: string, kind: string>"
RUN = (
    "runId string, scoringVersion int, timestampMs bigint, modelId string, provider string, decoding string, sampleId string, speakerId string, category string, "
    "language string, domain string, utteranceType string, private boolean, repetition int, coldStart boolean, loadMs bigint, inferenceMs bigint, audioMs bigint, "
    "rtf double, chunking string, segments int, chunkingMs bigint, biasing string, postCorrection string, rawText string, threads int, peakMemoryMb double, "
    f"cpuMs bigint, avgCores double, reference string, text string, wer double, cer double, substitutions bigint, deletions bigint, insertions bigint, "
    f"referenceWords bigint, critical array<{FLAG}>, hasCritical boolean, error string"
)
SAMPLE = (
    "id string, language string, domain string, utteranceType string, category string, speaker struct<id: string, profile: string, gender: string, accent: string>, "
    f"audioFile string, durationMs bigint, reference string, keyTerms array<{KEY_TERM}>, source struct<kind: string, url: string, license: string>, committable boolean, notes string"
)
SCRIPT = f"id string, language string, domain string, utteranceType string, text string, keyTerms array<{KEY_TERM}>, category string"
MODEL = (
    "id string, provider string, family string, role string, packaging string, languages array<string>, sizeMb double, license string, licenseTier string, files map<string, string>"
)
TTS_MEASURE = (
    "voice string, lang string, mode string, sentence bigint, chars bigint, rep bigint, speed double, normalised boolean, segments bigint, generationMs bigint, "
    "audioMs bigint, rtf double, loadMs bigint, cold boolean, sampleRate bigint, peakMemoryMb double"
)
#: What stands for a column that an old run record lacks.
RUN_DEFAULTS = {"scoringVersion": 1, "chunking": "off", "segments": 1, "chunkingMs": 0, "biasing": "none", "postCorrection": "none"}


def with_run_defaults(runs: DataFrame) -> DataFrame:
    types = dict(runs.dtypes)
    return runs.withColumns({c: F.coalesce(c, F.lit(v).cast(types[c])) for c, v in RUN_DEFAULTS.items() if c in types})
