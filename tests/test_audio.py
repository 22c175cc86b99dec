import numpy as np
import pytest

from sonoframe.audio import signal as S
from sonoframe.audio import wav

RATE = S.RATE


def tone(seconds, level=0.5):
    return (level * np.sin(2 * np.pi * 220 * np.arange(int(seconds * RATE)) / RATE)).astype(np.float32)


def quiet(seconds):
    return np.zeros(int(seconds * RATE), dtype=np.float32)


def plan(samples):
    return S.plan_segments(samples, S.energy_spans(samples, 0.3, 0.25))


def test_short_clip_is_one_segment():
    assert plan(tone(20)) == [(0, 20 * RATE)]
    assert plan(quiet(0)) == [] and plan(quiet(40)) == []


def test_bursts_are_cut_in_a_pause():
    samples = np.concatenate([tone(10), quiet(1), tone(10), quiet(1), tone(10), quiet(1)])
    segments = plan(samples)
    assert len(segments) == 2 and 21 * RATE <= segments[0][1] <= 22 * RATE and segments[0][0] == 0 and segments[1][1] >= 32 * RATE


def test_long_tone_is_cut_where_it_is_quiet():
    samples = tone(40)
    samples[20 * RATE : int(20.1 * RATE)] *= 0.01
    segments = plan(samples)
    assert len(segments) == 2 and abs(segments[0][1] / RATE - 20.05) < 0.05 and segments[0][1] == segments[1][0]
    parts = plan(tone(70))
    assert len(parts) >= 3 and all(b - a <= 25 * RATE for a, b in parts) and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))


def test_cut_is_the_middle_of_a_short_pause():
    samples = np.concatenate([tone(14), quiet(0.2), tone(14)])
    segments = S.plan_segments(samples, [(0, 14 * RATE), (int(14.2 * RATE), len(samples))])
    assert abs(segments[0][1] / RATE - 14.1) < 0.01


def test_quality():
    samples = np.concatenate([quiet(1), np.where(np.arange(RATE) % 2, 1.0, -1.0).astype(np.float32)])
    q = S.analyze(samples, RATE, 7)
    assert q["durationMs"] == 2000 and q["clippedRatio"] > 0.4 and 900 <= q["leadingSilenceMs"] <= 1000 and any("clipping" in w for w in q["warnings"])


@pytest.mark.parametrize("scaling", ["round", "truncate", "asymmetric"])
def test_wav_round_trip(scaling):
    samples, rate = wav.read(wav.write(tone(0.1), 8000, scaling))
    assert rate == 8000 and np.abs(samples - tone(0.1)).max() < 1e-3


def test_wav_channels_widths_and_refusals():
    stereo = np.array([16384, -16384, 16384, 16384], "<i2").tobytes()
    data = wav.write(quiet(0.001), 8000)
    head = bytearray(data[:44])
    head[22:24] = (2).to_bytes(2, "little")
    head[40:44] = len(stereo).to_bytes(4, "little")
    assert wav.read(bytes(head) + stereo)[0].tolist() == [0.0, 0.5]
    for bad in (b"ID3" + bytes(60), b"OggS" + bytes(60), data[:44][:40] + bytes(4), b""):
        with pytest.raises(wav.WavError):
            wav.read(bad)
    assert wav.looks_like_wav(data) and not wav.looks_like_wav(data[:20])


def test_clock():
    assert S.segment_clock([8000, 16000], [4000, 0], 16000) == [(0, 500), (750, 1750)]
    assert S.merge_spans([(5, 9), (0, 3), (3, 4), (8, 20), (30, 30)], 15) == [(0, 4), (5, 15)]
