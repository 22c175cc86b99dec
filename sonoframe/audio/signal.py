"""Frames, speech spans, segment planning and quality measures of mono audio."""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

RATE = 16_000
#: 20 ms frames every 10 ms.
FRAME, HOP = RATE // 50, RATE // 100
MAX_SEGMENT_S, PADDING_S = 25.0, 0.2
Span = tuple[int, int]


def duration_ms(samples: int, rate: int) -> int:
    return samples * 1000 // rate if rate else 0


def resample(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == to or not len(samples):
        return samples
    at = np.arange(int(len(samples) * to / rate)) * (rate / to)
    return np.interp(at, np.arange(len(samples)), samples).astype(np.float32)


def frame_rms(samples: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
    """Root mean square of each full frame from low to high."""
    part = np.asarray(samples[low:high], dtype=np.float32)
    if len(part) < FRAME:
        return np.zeros(0, dtype=np.float32)
    frames = sliding_window_view(part, FRAME)[::HOP]
    return np.sqrt(np.einsum("ij,ij->i", frames, frames, dtype=np.float32) / np.float32(FRAME))


def quietest_point(samples: np.ndarray, low: int, high: int) -> int:
    """The centre of the middle one of the quietest frames; the middle where there is no room for frames."""
    high = min(high, len(samples))
    if high <= low + FRAME:
        return (low + high) // 2
    energy = frame_rms(samples, low, high)
    quiet = np.flatnonzero(energy <= energy.min() * np.float32(1.05) + np.float32(1e-7))
    return low + int(quiet[len(quiet) // 2]) * HOP + FRAME // 2


def energy_spans(samples: np.ndarray, min_silence_s: float, min_speech_s: float) -> list[Span]:
    """Runs of frames that are louder than a threshold from the quiet and the loud tenth, over pauses that are short."""
    energy = frame_rms(samples)
    if not len(energy):
        return []
    ranked = np.sort(energy)
    noise, loud = float(ranked[len(ranked) // 10]), float(ranked[len(ranked) * 9 // 10])
    speech = np.flatnonzero(energy >= max(min(noise * 3, loud * 0.3), loud * 0.05, 0.003))
    if not len(speech):
        return []
    hop_s = HOP / RATE
    gaps = np.flatnonzero(np.diff(speech) > math.ceil(np.float32(min_silence_s) / np.float32(hop_s)))
    first, last = speech[np.r_[0, gaps + 1]], speech[np.r_[gaps, len(speech) - 1]]
    least = math.ceil(np.float32(min_speech_s) / np.float32(hop_s))
    return [(int(a) * HOP, min(int(b) * HOP + FRAME, len(samples))) for a, b in zip(first, last) if b - a + 1 >= least]


def merge_spans(spans: list[Span], n: int) -> list[Span]:
    """Union of the spans within 0..n; spans that touch become one."""
    merged: list[list[int]] = []
    for a, b in sorted((min(a, n), min(b, n)) for a, b in spans):
        if a >= b:
            continue
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [tuple(s) for s in merged]


def split_long(samples: np.ndarray, spans: list[Span], budget: int) -> list[Span]:
    """Spans longer than the budget cut at the quietest point of its second half, again and again."""
    out = []
    for a, b in spans:
        while b - a > budget:
            cut = quietest_point(samples, a + budget // 2, a + budget)
            out.append((a, cut))
            a = cut
        out.append((a, b))
    return out


def group_greedily(pieces: list[Span], limit: int, pad: int) -> list[Span]:
    """Neighbouring pieces joined while they and their padding stay within the limit."""
    groups: list[Span] = []
    for a, b in pieces:
        if groups and b - groups[-1][0] + 2 * pad <= limit:
            groups[-1] = groups[-1][0], b
        else:
            groups.append((a, b))
    return groups


def padded(groups: list[Span], n: int, pad: int) -> list[Span]:
    """Padding on both sides, but never past the middle of a pause."""
    middles = [(a[1] + b[0]) // 2 for a, b in pairwise(groups)]
    starts = [max(a - pad, 0, m) for (a, _), m in zip(groups, [0, *middles])]
    ends = [min(b + pad, m) for (_, b), m in zip(groups, [*middles, n])]
    return list(zip(starts, ends))


def plan_segments(samples: np.ndarray, spans: list[Span], max_segment_s: float = MAX_SEGMENT_S, padding_s: float = PADDING_S) -> list[Span]:
    """The segments to transcribe: the whole clip if it fits, nothing without speech."""
    n, limit = len(samples), max(int(max_segment_s * RATE), 2 * FRAME)
    if n <= limit:
        return [(0, n)] if n else []
    pad = min(int(padding_s * RATE), limit // 4)
    pieces = split_long(samples, merge_spans(spans, n), limit - 2 * pad)
    return padded(group_greedily(pieces, limit, pad), n, pad)


def segment_clock(lengths: list[int], pauses: list[int], rate: int) -> list[tuple[int, int]]:
    """(startMs, endMs) of segments that are played one after another, each followed by its pause."""
    out, at = [], 0
    for length, pause in zip(lengths, pauses):
        out.append((at * 1000 // rate, (at + length) * 1000 // rate))
        at += length + pause
    return out


def analyze(samples: np.ndarray, rate: int, words: int) -> dict:
    """Level, clipping, silence at both ends, reading speed, and what is wrong with them."""
    n, frame = len(samples), max(rate // 50, 1)
    level = np.abs(np.asarray(samples, dtype=np.float64))
    share = lambda mask: float(mask.sum()) / max(n, 1)

    def silent_run(x: np.ndarray, whole_only: bool) -> int:
        ends = range(frame, len(x) + 1, frame) if whole_only else range(frame, len(x) + frame, frame)
        run = 0
        for end in ends:
            if math.sqrt(float(np.mean(x[end - frame : end] ** 2))) >= 0.01:
                break
            run += 1
        return run

    ms = duration_ms(n, rate)
    out = {
        "durationMs": ms, "peak": float(level.max(initial=0)), "rms": math.sqrt(float((level**2).sum()) / max(n, 1)), "clippedRatio": share(level >= 0.99), "hotRatio": share(level >= 0.9),
        "leadingSilenceMs": silent_run(level, False) * frame * 1000 // max(rate, 1), "trailingSilenceMs": silent_run(level[::-1], True) * frame * 1000 // max(rate, 1),
        "wordsPerSecond": words / (ms / 1000) if ms and words else None,
    }
    speed = out["wordsPerSecond"]
    checks = [
        (out["clippedRatio"] > 0.001, f"clipping: {out['clippedRatio'] * 100:.2f} % of samples at full scale"),
        (out["hotRatio"] > 0.02, f"hot signal: {out['hotRatio'] * 100:.1f} % of samples above 90 % of full scale"),
        (out["peak"] < 0.1, f"very quiet: peak {out['peak'] * 100:.0f} %"),
        (out["leadingSilenceMs"] > 1500 or out["trailingSilenceMs"] > 2000, "long silence at the start or the end"),
        (speed is not None and not 1.2 <= speed <= 5.0, f"unusual reading speed: {speed or 0:.1f} words/s (wrong sentence read?)"),
    ]
    return out | {"warnings": [message for wrong, message in checks if wrong]}
