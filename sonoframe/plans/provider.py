"""The slot for speech engines: a provider is loaded once a partition and turns requests into results."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

RESULT = (
    "sample_id string, provider_id string, model_id string, language string, text string, processing_ms bigint, load_ms bigint, cold_start boolean, audio_ms bigint, rtf double, "
    "threads int, peak_memory_mb double, cpu_ms bigint, decoding string, is_mock boolean, error string"
)


class SpeechToText(Protocol):
    id: str
    is_mock: bool
    languages: tuple[str, ...]

    def transcribe(self, audio_path: str, model_id: str, language: str) -> dict: ...


class Mock:
    """Recognises nothing and says so."""

    id, is_mock, languages = "mock", True, ("fr", "en")

    def transcribe(self, audio_path: str, model_id: str, language: str) -> dict:
        if not audio_path.strip():
            raise ValueError("audio path is empty")
        return {"text": "[MOCK] no real transcription was performed", "load_ms": 0, "cold_start": False, "threads": 1, "decoding": "none (mock)"}


class Registry:
    """Engines by id. The mock is none of them unless it is registered like any other."""

    def __init__(self):
        self._makers: dict[str, Callable[[], SpeechToText]] = {}

    def register(self, name: str, make: Callable[[], SpeechToText]) -> None:
        self._makers[name] = make

    def maker(self, name: str) -> Callable[[], SpeechToText]:
        if name not in self._makers:
            raise KeyError(f"unknown provider: {name}")
        return self._makers[name]


def transcribe(requests: DataFrame, make: Callable[[], SpeechToText]) -> DataFrame:
    """Results for (sample_id, audio_path, model_id, language, audio_ms); a failed request has an error and a null text."""
    columns = [part.split()[0] for part in RESULT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                began = time.perf_counter()
                row = {"sample_id": r.sample_id, "provider_id": engine.id, "model_id": r.model_id, "language": r.language, "is_mock": engine.is_mock, "audio_ms": r.audio_ms}
                try:
                    if r.language not in engine.languages:
                        raise ValueError(f"language not supported: {r.language}")
                    row |= engine.transcribe(r.audio_path or "", r.model_id, r.language)
                except ValueError as e:
                    row["error"] = str(e)
                ms = int((time.perf_counter() - began) * 1000)
                row |= {"processing_ms": ms, "rtf": ms / r.audio_ms if r.audio_ms and "error" not in row else None}
                rows.append(row)
            yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda x: x.notna(), None)

    return requests.select("sample_id", "audio_path", "model_id", "language", "audio_ms").mapInPandas(run, RESULT)
