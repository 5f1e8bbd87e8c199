"""Vectors as blocks of exact integers: what operators 11 and 13 pack, write and compute with."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(rows: DataFrame, *keep: str) -> DataFrame:
    """``v`` (array of doubles) beside the columns to keep: vectors that are not null and hold only finite components."""
    v = rows.select(*keep, F.col("embedding").cast("array<double>").alias("v"))
    return v.filter(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))


def longest(rows: DataFrame) -> int:
    """The longest vector's length; 0 for an empty table."""
    return rows.agg(F.max(F.size("v"))).first()[0] or 0


def matrix(col: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows of doubles, filled up with zeros."""
    flat, sizes = col.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(col).to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(col), width)
    out = np.zeros((len(col), width))
    out[np.repeat(np.arange(len(col)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers, or Python's where those are too narrow."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(p) if math.isfinite(p) else math.floor(Fraction(v) * scale) for p, v in zip(y.ravel().tolist(), x.ravel().tolist())]
    return out


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def pack(x: np.ndarray) -> bytes:
    """Integers in the narrowest of 2, 4 or 8 bytes, or as decimal text; a byte says which."""
    top = largest(x)
    for width in (2, 4, 8):
        if top < 1 << (8 * width - 1):
            return bytes([width]) + x.astype(f"<i{width}").tobytes()
    return b"\0" + " ".join(map(str, x.ravel().tolist())).encode()


def unpack(raw: bytes) -> np.ndarray:
    """A row of integers."""
    if raw[0]:
        return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)
    return np.array([int(v) for v in raw[1:].split()], object)
