"""Recorded samples as files: one JSON a sample beside its audio, in a public and a private folder.

These are single small files on the driver's file system; tables of them are read with sources.samples.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from sonoframe.audio import signal, wav
from sonoframe.operators.validation import CHOICES

PUBLIC, PRIVATE = "samples", "samples-private"
_CONSENT = {"yes": "yes", "oui": "yes", "unknown": "unknown", "inconnu": "unknown"}


class Refused(ValueError):
    """A request that breaks a rule; the message never holds the reference text."""


def sanitize_id(raw: str) -> str:
    return "-".join(p for p in re.sub("[^a-z0-9_]", "-", raw.strip().lower()).split("-") if p)[:60]


def private_voice_license(consent: str) -> str:
    """The licence text of a private recording; without consent there is none."""
    word = consent.strip().lower()
    if word in ("no", "non"):
        raise Refused("the speaker did not consent: the clip must not be imported")
    if word not in _CONSENT:
        raise Refused(f"consent must be yes, no or unknown, got '{word}'")
    return f"private voice, no redistribution, speaker consent: {_CONSENT[word]}"


def clean_reference(text: str) -> str:
    return " ".join(text.lstrip("﻿").split())


def broken_rules(sample: dict, private: bool) -> list[str]:
    """What is wrong with a sample's metadata, in the order in which it is checked."""
    source, speaker = sample.get("source") or {}, sample.get("speaker") or {}
    value = {"source.kind": source.get("kind")}
    rules = [
        (not sample.get("id") or sanitize_id(sample["id"]) != sample["id"], "id must be lower-case letters, digits, - and _"),
        (not (speaker.get("id") or "").strip(), "speaker is missing"),
        (not (speaker.get("profile") or "").strip(), "speaker profile is missing"),
        (not (source.get("license") or "").strip(), "license is missing"),
        (not clean_reference(sample.get("reference") or ""), "reference is empty"),
        (not private and source.get("kind") == "public-domain" and not source.get("url"), "a public recording needs its address"),
        *((value.get(c, sample.get(c)) not in allowed, message) for c, (message, allowed) in CHOICES.items()),
        (source.get("kind") == "third-party-private" and not private, "third-party recording must be private"),
        (source.get("kind") == "third-party-private" and bool(sample.get("committable")), "third-party recording must not be committable"),
    ]
    return [message for broken, message in rules if broken]


def _paths(root: str, name: str) -> dict[str, str]:
    return {"audio": os.path.join(root, "audio", f"{name}.wav"), **{folder: os.path.join(root, folder, f"{name}.json") for folder in (PUBLIC, PRIVATE)}}


def import_sample(root: str, sample: dict, audio: bytes, private: bool, replace: bool = False) -> dict:
    """Writes a sample and its audio (16 kHz, mono) and returns its metadata with the measured duration.

    Importing again with ``replace`` may move it between the folders. If anything is refused or fails, the files are as
    they were before.
    """
    if broken := broken_rules(sample, private):
        raise Refused(broken[0])
    paths = _paths(root, sample["id"])
    before = {p: open(p, "rb").read() for p in paths.values() if os.path.exists(p)}
    if not replace and any(paths[f] in before for f in (PUBLIC, PRIVATE)):
        raise Refused(f"sample {sample['id']} is there already")
    samples, rate = wav.read(audio)
    samples = signal.resample(samples, rate)
    stored = sample | {"reference": clean_reference(sample["reference"]), "audioFile": f"{sample['id']}.wav", "durationMs": signal.duration_ms(len(samples), signal.RATE)}
    try:
        for p in paths.values():
            os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(paths["audio"], "wb") as f:
            f.write(wav.write(np.asarray(samples), signal.RATE))
        with open(paths[PRIVATE if private else PUBLIC], "w", encoding="utf-8") as f:
            json.dump({k: v for k, v in stored.items() if k != "private"}, f, ensure_ascii=False, indent=2)
        other = paths[PUBLIC if private else PRIVATE]
        if os.path.exists(other):
            os.remove(other)
    except BaseException:
        for p in paths.values():
            if p in before:
                with open(p, "wb") as f:
                    f.write(before[p])
            elif os.path.exists(p):
                os.remove(p)
        raise
    return stored | {"private": private}


def delete_sample(root: str, name: str) -> bool:
    """Removes a sample's files; whether there were any."""
    if sanitize_id(name) != name:
        raise Refused("id must be lower-case letters, digits, - and _")
    found = [p for p in _paths(root, name).values() if os.path.exists(p)]
    for p in found:
        os.remove(p)
    return bool(found)


def read_stored(folder: str, name: str, suffix: str = ".wav") -> bytes:
    """A stored file of a folder; a name that leads out of it, by itself or by a link, is refused."""
    root = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(root, name))
    if os.path.dirname(path) != root or not path.endswith(suffix):
        raise Refused("the file lies outside the folder")
    if not os.path.isfile(path):
        raise Refused("no such file")
    with open(path, "rb") as f:
        return f.read()
