"""Vector arithmetic as Columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Least raw similarity and range of raw similarity per model, fixed values; other models use DEFAULT_RANGE.
MODEL_LEAST = {"SigLIP": 0.06, "ViT-B/32": 0.18, "ViT-B/16": 0.18, "ViT-L/14": 0.15}
MODEL_RANGES = {"SigLIP": (0.06, 0.38), "ViT-B/32": (0.18, 0.45), "ViT-B/16": (0.18, 0.45), "ViT-L/14": (0.15, 0.42)}
DEFAULT_RANGE = (0.05, 0.40)


def doubles(c: Column | str) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for a null, zero or differently long vector."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def cosine_to(a: Column | str, query: Sequence[float]) -> Column:
    """Cosine to a constant vector; null for a null, zero or differently long vector or one with a null or non-number.

    Runs over Arrow batches: lambdas over arrays stay outside generated code, and products written out
    outgrow it; on 300,000 vectors of 128 this takes less than half the time of either.
    """
    q = np.asarray(query, np.float64)
    length = float(np.sqrt((q * q).sum()))

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        fit = np.fromiter((x is not None and len(x) == len(q) for x in v), bool, len(v))
        out = np.full(len(v), np.nan)
        if fit.any() and length > 0:
            m = np.stack(v[fit].to_list()).astype(np.float64)
            norm = np.sqrt((m * m).sum(axis=1))
            ok = norm > 0
            out[np.flatnonzero(fit)[ok]] = (m[ok] * q).sum(axis=1) / (norm[ok] * length)
        return pd.Series(out)

    return run(a)


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of length 1; NaN, which reaches no threshold, for zero vectors and those that are not all numbers."""
    x = np.stack(vectors.to_list()).astype(np.float64)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, np.nan)


def vector_matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Vectors of ``dim`` entries as rows, in double."""
    return np.concatenate([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), dim) if len(vectors) else np.empty((0, dim))


def dot_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of a with those of b, summed up from the first entry to the last as SQL engines do, so that equal rows give equal bits."""
    out = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T, np.float64), np.ascontiguousarray(b.T, np.float64)):
        out += x * y
    return out


def cosine_rows(a: np.ndarray, b: np.ndarray, square_a: np.ndarray, square_b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a with those of b, given their squared lengths; 1 at most."""
    return np.clip(dot_rows(a, b) / np.sqrt(square_a * square_b), -1.0, 1.0)


def normalized_similarity(sim: Column, model: Column) -> Column:
    """Similarity scaled to 0..1 by the model's range and clamped."""
    lo = hi = None
    for name, (a, b) in MODEL_RANGES.items():
        lo = F.when(model == name, a) if lo is None else lo.when(model == name, a)
        hi = F.when(model == name, b) if hi is None else hi.when(model == name, b)
    lo, hi = lo.otherwise(DEFAULT_RANGE[0]), hi.otherwise(DEFAULT_RANGE[1])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (sim - lo) / (hi - lo)))


def centroids(df: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """(group, centroid, n): element-wise mean of the group's vectors of length ``dim``.

    One average per position keeps the aggregation partial on the map side; no group is collected.
    """
    df = df.filter((F.size(vector) == dim) & F.col(group).isNotNull())
    parts = [F.avg(F.element_at(vector, i + 1).cast("double")).alias(f"v{i}") for i in range(dim)]
    wide = df.groupBy(group).agg(*parts, F.count("*").alias("n"))
    return wide.select(group, F.array(*[F.col(f"v{i}") for i in range(dim)]).alias("centroid"), "n")
