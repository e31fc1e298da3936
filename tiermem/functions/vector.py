"""Vector functions on ARRAY<DOUBLE> columns, as native higher-order expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once: the optimizer inlines columns even into lambdas, where they would be evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """dot / (|a||b| + EPS)"""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(EPS))


def normalised(a: Column) -> Column:
    return let(a, lambda v: let(norm(v) + F.lit(EPS), lambda n: F.transform(v, lambda x: x / n)))


def mean(vectors: Column) -> Column:
    """Per-position mean of an array of vectors, in array order."""
    return let(vectors, lambda all_: F.transform(F.sequence(F.lit(0), F.size(all_[0]) - 1), lambda i: F.aggregate(all_, F.lit(0.0), lambda s, v: s + v[i]) / F.size(all_)))


def centroid(vectors: Column) -> Column:
    """Unweighted mean of the vectors, L2-normalised."""
    return normalised(mean(vectors))


def weighted(vectors: Column, weights: Column) -> Column:
    """Weighted sum of an array of vectors."""
    return F.transform(F.sequence(F.lit(0), F.size(vectors[0]) - 1), lambda i: total(F.zip_with(vectors, weights, lambda v, w: v[i] * w)))


def softmax(scores: Column) -> Column:
    """Max-shifted; EPS in the denominator."""
    shifted = lambda s: let(F.array_max(s), lambda most: F.transform(s, lambda x: F.exp(x - most)))
    return let(scores, lambda s: let(shifted(s), lambda e: let(total(e) + F.lit(EPS), lambda t: F.transform(e, lambda x: x / t))))


def max_similarity(query: Column, vectors: Column) -> Column:
    return F.array_max(F.transform(vectors, lambda v: cosine(query, v)))


def matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Arrow lists as the rows of a matrix, filled up with zeros, and their lengths: -1 for what has no similarity, null lists and those with a null."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values, width = flat.to_numpy(zero_copy_only=False).astype(np.float64), max(0, int(sizes.max(initial=0)))
    if not flat.null_count and (sizes == width).all():
        return values.reshape(len(sizes), width), sizes
    inside = np.arange(width) < sizes[:, None]
    rows, bare = np.zeros(inside.shape), np.zeros(inside.shape, dtype=bool)
    rows[inside], bare[inside] = values, flat.is_null().to_numpy(zero_copy_only=False)
    return rows, np.where(bare.any(axis=1), -1, sizes)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """dot of the rows of two matrices, added up in the same order, so that both give the same bits. Quickest where columns are contiguous."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def to_bytes(dim: int):
    """Arrow UDF: vector to little-endian float32 bytes; null stays null."""
    @F.pandas_udf("binary")
    def encode(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())

    return encode


def from_bytes(dim: int):
    """Arrow UDF: bytes back to a vector; a size other than dim is an error."""
    @F.pandas_udf("array<float>")
    def decode(v: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            out = np.frombuffer(x, dtype="<f4")
            if len(out) != dim:
                raise ValueError(f"{len(out)} values where {dim} are declared")
            return out

        return v.map(one)

    return decode
