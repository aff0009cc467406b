"""What lies outside the engine and is handed in: encoders, detectors, translators, geocoders, assistants; and how they meet tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fotoloom.functions.media import parse_position


class Encoder(Protocol):
    """Texts or pictures to vectors, a row each; see ``media.encode``."""

    def __call__(self, values: list) -> np.ndarray: ...


class Detector(Protocol):
    """The faces of a picture as dicts with box, det_score and embedding; see ``media.detect_faces``."""

    def __call__(self, picture: bytes) -> list[dict]: ...


class Translator(Protocol):
    """Texts to texts in the encoder's language."""

    def __call__(self, texts: list[str]) -> list[str]: ...


class Geocoder(Protocol):
    """(latitude, longitude) of a place name, or None."""

    def __call__(self, name: str) -> tuple[float, float] | None: ...


class Assistant(Protocol):
    """A reply to a prompt, read by ``plans.actions.parse_actions``."""

    def __call__(self, prompt: str) -> str: ...


def translated(df: DataFrame, key: str, text: str, translator: Translator, batch: int = 64) -> DataFrame:
    """(key, text) in the translator's words; null texts stay null and are not sent."""
    kind = df.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out, at = pdf[text].to_list(), np.flatnonzero(pdf[text].notna()).tolist()
            for i in range(0, len(at), batch):
                for k, new in zip(at[i : i + batch], translator([out[k] for k in at[i : i + batch]])):
                    out[k] = new
            yield pd.DataFrame({key: pdf[key], text: out})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, {text} string")


def located(df: DataFrame, key: str, text: str, geocoder: Geocoder) -> DataFrame:
    """(key, latitude, longitude) of texts: coordinates and map links are read in the JVM, only what is left goes to the geocoder; null if it knows nothing."""
    kind = df.schema[key].dataType.simpleString()
    at = df.select(key, text, parse_position(F.col(text)).alias("at"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [geocoder(t) if t is not None and t.strip() else None for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "latitude": [f[0] if f else None for f in found], "longitude": [f[1] if f else None for f in found]}).astype({"latitude": "Float64", "longitude": "Float64"})

    read = at.filter("at is not null").select(key, "at.latitude", "at.longitude")
    return read.unionByName(at.filter("at is null").select(key, text).mapInPandas(run, f"{key} {kind}, latitude double, longitude double"))
