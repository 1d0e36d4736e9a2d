"""Interfaces to what needs models or codecs, each with a deterministic stand-in.

A plugin works on frames of rows on the workers (``mapInPandas``), so a model is
loaded once a worker and only where there are rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd


class Synthesizer(Protocol):
    """Makes takes of texts."""

    def params(self) -> dict[str, str]: ...

    def synthesize(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


class Writer(Protocol):
    """Rewrites windows; None for a window leaves it to the passthrough."""

    def rewrite(self, window: str) -> list[dict] | None: ...


class Transcriber(Protocol):
    """Hears takes."""

    def transcribe(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


class DummySynthesizer:
    """Takes without sound: their length is that of the words at a given pace."""

    def __init__(self, wpm: float = 150.0):
        self.wpm = wpm

    def params(self) -> dict[str, str]:
        return {"wpm": str(self.wpm)}

    def synthesize(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = frame["text"].fillna("").str.split().str.len()
            yield pd.DataFrame({"key": frame["key"], "duration_s": (words / self.wpm * 60).round(3), "chars": frame["text"].fillna("").str.len().astype("int32")})


class Passthrough:
    """A writer that writes nothing."""

    def rewrite(self, window: str) -> list[dict] | None:
        return None
