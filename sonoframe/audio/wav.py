"""WAV bytes to mono samples and back."""

from __future__ import annotations

import struct

import numpy as np

#: First bytes of other containers, where they stand, and the containers' names.
_OTHERS = (
    (b"ftyp", 4, "MP4/M4A (AAC)"), (b"OggS", 0, "Ogg (Vorbis/Opus)"), (b"fLaC", 0, "FLAC"), (b"ID3", 0, "MP3"), (b"\x1aE\xdf\xa3", 0, "WebM/Matroska"),
    (b"RF64", 0, "RF64 (extended WAV, not supported)"),
)
SMALLEST, LARGEST = 44, 200 * 1024 * 1024


class WavError(ValueError):
    pass


def other_container(head: bytes) -> str | None:
    if len(head) > 1 and head[0] == 0xFF and head[1] >= 0xE0:  # a frame of eleven set bits
        return "MP3"
    return next((name for magic, at, name in _OTHERS if head[at : at + len(magic)] == magic), None)


def looks_like_wav(data: bytes) -> bool:
    """Size and first bytes of a clip that may be stored."""
    return SMALLEST <= len(data) <= LARGEST and data[:4] == b"RIFF" and data[8:12] == b"WAVE"


def read(data: bytes) -> tuple[np.ndarray, int]:
    """Mono float samples and their rate; channels are averaged, whole numbers scaled by their largest magnitude."""
    if (other := other_container(data)) is not None:
        raise WavError(f"{other} instead of WAV")
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise WavError("no WAV")
    chunks, at = {}, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        chunks.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    if b"fmt " not in chunks or b"data" not in chunks or len(chunks[b"fmt "]) < 16:
        raise WavError("a part is missing")
    code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", chunks[b"fmt "])
    if code == 0xFFFE and len(chunks[b"fmt "]) >= 26:
        code = struct.unpack_from("<H", chunks[b"fmt "], 24)[0]
    body = chunks[b"data"]
    width = bits // 8
    if not channels or not width:
        raise WavError("no channels")
    body = body[: len(body) // (width * channels) * width * channels]
    if code == 3 and bits == 32:
        samples = np.frombuffer(body, "<f4")
    elif code == 1 and bits == 8:
        samples = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
    elif code == 1 and bits in (16, 32):
        samples = np.frombuffer(body, f"<i{width}").astype(np.float32) / np.float32(1 << (bits - 1))
    elif code == 1 and bits == 24:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        samples = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8).astype(np.float32) / np.float32(1 << 23)
    else:
        raise WavError(f"unknown encoding {code} of {bits} bits")
    if not len(samples):
        raise WavError("no samples")
    return samples.reshape(-1, channels).mean(axis=1, dtype=np.float32), rate


def write(samples: np.ndarray, rate: int, scaling: str = "round") -> bytes:
    """16-bit mono. ``scaling``: round or truncate times 32767, or asymmetric (negative values times 32768)."""
    x = np.clip(np.asarray(samples, dtype=np.float32), -1, 1)
    if scaling == "asymmetric":
        values = np.trunc(np.where(x < 0, x * 32768, x * 32767))
    else:
        scaled = x * np.float32(32767)
        values = np.trunc(scaled) if scaling == "truncate" else np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)
    body = values.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body
