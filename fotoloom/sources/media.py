"""Work on image files through injected readers: the engine decodes nothing itself.

A decoder turns bytes into a two-dimensional array of grey values, a reader turns bytes into a dict of
EXIF entries, an encoder turns a list of inputs into vectors, a detector turns bytes into faces. All run in
Arrow batches; what fails gives null, or no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIDE, FACTOR = 16, 4


def perceptual_hash(grey: np.ndarray, side: int = SIDE) -> str:
    """Hex hash of side x side low frequencies of the picture, each bit telling whether one exceeds their median."""
    n = side * FACTOR
    grey = grey.astype(np.float64)
    for axis in (0, 1):  # shrink by the mean of equal parts, after repeating pixels where there are too few
        grey = np.repeat(grey, -(-n // grey.shape[axis]), axis=axis) if grey.shape[axis] < n else grey
        cut = (np.arange(n + 1) * grey.shape[axis]) // n
        size = np.diff(cut).reshape((-1, 1) if axis == 0 else (1, -1))
        grey = np.add.reduceat(grey, cut[:-1], axis=axis) / size
    k = np.arange(n)
    basis = np.cos(np.pi * np.outer(k[:side], 2 * k + 1) / (2 * n))
    low = basis @ grey @ basis.T
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()


def add_hashes(files: DataFrame, decode: Callable[[bytes], np.ndarray | None], content: str = "content", key: str = "file_path") -> DataFrame:
    """(key, phash); '' where the decoder fails, as a mark of a failed attempt."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for raw in pdf[content]:
                try:
                    grey = decode(bytes(raw)) if raw is not None else None
                    out.append(perceptual_hash(grey) if grey is not None else "")
                except Exception:  # an unreadable picture must not end the job
                    out.append("")
            yield pd.DataFrame({key: pdf[key], "phash": out})

    return files.select(key, content).mapInPandas(run, f"{key} string, phash string")


def add_exif(files: DataFrame, readers: Sequence[Callable[[bytes], dict | None]], content: str = "content", key: str = "file_path") -> DataFrame:
    """(key, exif_data): the entries of the first reader that finds any, as JSON text; null if none does."""

    def first(raw: bytes) -> str | None:
        for r in readers:
            try:
                found = r(raw)
            except Exception:  # the next reader may understand the file
                continue
            if found:
                return json.dumps({str(k): str(v) for k, v in found.items()}, ensure_ascii=False)
        return None

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({key: pdf[key], "exif_data": [None if r is None else first(bytes(r)) for r in pdf[content]]})

    return files.select(key, content).mapInPandas(run, f"{key} string, exif_data string")


def encode(df: DataFrame, key: str, value: str, encoder: Callable[[list], np.ndarray], batch: int = 16) -> DataFrame:
    """(key, embedding) of texts or pictures, ``batch`` at a time; null values have no row."""
    kind = df.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf = pdf[pdf[value].notna()]
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], "embedding": [np.asarray(v, np.float32) for v in encoder(list(part[value]))]})

    return df.select(key, value).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def detect_faces(files: DataFrame, detect: Callable[[bytes], list[dict]], least: float = 0.45, content: str = "content", key: str = "file_path") -> DataFrame:
    """(key, box, det_score, embedding) of the faces a detector is sure enough of."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(k, list(map(float, f["box"])), float(f["det_score"]), list(map(float, f["embedding"]))) for k, raw in zip(pdf[key], pdf[content]) if raw is not None for f in detect(bytes(raw)) if f["det_score"] >= least]
            yield pd.DataFrame(rows, columns=[key, "box", "det_score", "embedding"])

    return files.select(key, content).mapInPandas(run, f"{key} string, box array<float>, det_score float, embedding array<float>")
