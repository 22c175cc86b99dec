"""Audio functions for DataFrames, on arrays of samples."""

from __future__ import annotations

import numpy as np

from sonoframe.audio import signal
from sonoframe.functions.text import on_batches
from sonoframe.text.scoring import normalize_words

SPANS = "array<struct<start: bigint, end: bigint>>"
QUALITY = (
    "struct<durationMs: bigint, peak: double, rms: double, clippedRatio: double, hotRatio: double, leadingSilenceMs: bigint, trailingSilenceMs: bigint, "
    "wordsPerSecond: double, warnings: array<string>>"
)


def _samples(x: list[float]) -> np.ndarray:
    return np.array(x, dtype=np.float32)


def _spans(spans: list[signal.Span]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


energy_spans = on_batches(lambda x: _spans(signal.energy_spans(_samples(x), 0.3, 0.25)), SPANS, 1)
frame_levels = on_batches(lambda x: signal.frame_rms(_samples(x)).astype(float).tolist(), "array<double>", 1)
plan_segments = on_batches(lambda x, spans: _spans(signal.plan_segments(_samples(x), [(s["start"], s["end"]) for s in spans])), SPANS, 2)
resample = on_batches(lambda x, rate: signal.resample(_samples(x), rate).tolist(), "array<float>", 2)
quality = on_batches(lambda x, rate, reference: signal.analyze(_samples(x), rate, len(normalize_words(reference))), QUALITY, 3)
