"""Exact inner products of vectors of whole numbers, as columns that order as the scores do."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = float(1 << 53)
_OFFSET, _BYTES = 1 << 2200, 276  # order-preserving keys of scores that 64 bits do not hold


def usable(vector: Column) -> Column:
    """Neither null nor empty, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & (F.size(vector) > 0), F.lit(False))


def whole_parts(vector: Column, scale: float) -> Column:
    """Every component as ``floor(scale * x)``, a double."""

    def whole(x: Column) -> Column:  # beyond 2**52 every double is whole, and more than a bigint may hold
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < float(1 << 52), F.floor(scaled).cast("double")).otherwise(scaled)

    return F.transform(vector, whole)


class Scores:
    """Scores as a column: 64-bit integers, or binary keys of the same order where those do not suffice."""

    def __init__(self, largest: int, width: int, factor: int = 1) -> None:
        """For components up to ``largest`` and products that are compared ``factor`` times over."""
        self.wide = wide = largest * largest * width * factor >= 1 << 62
        self.sql, self.arrow = ("binary", pa.binary()) if wide else ("bigint", pa.int64())

    def column(self, scores: np.ndarray) -> pa.Array:
        if not self.wide:
            return pa.array(scores.astype(np.int64))
        return pa.array([(int(s) + _OFFSET).to_bytes(_BYTES, "big") for s in scores], pa.binary())

    def values(self, items: list) -> list[int | None]:
        return [None if s is None else int.from_bytes(s, "big") - _OFFSET if self.wide else s for s in items]

    def as_long(self, key: str, sign: int = 1) -> Column:
        """The score, or what it is less than zero; null if 64 bits do not hold it."""
        if not self.wide:
            return F.col(key) * sign

        def convert(keys: pa.Array) -> pa.Array:
            found = [None if s is None else sign * s for s in self.values(keys.to_pylist())]
            return pa.array([s if s is not None and -(1 << 63) <= s < 1 << 63 else None for s in found], pa.int64())

        return F.arrow_udf(convert, "long")(key)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: 64-bit integers, or Python's where those could be too small."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(a) @ whole(b).T


def numbers(x: np.ndarray) -> bytes:
    """The least of a few types that holds the numbers, named by the first byte."""
    for kind in ("h", "i"):
        if not x.size or (np.abs(x).max() <= np.iinfo(kind).max):
            return kind.encode() + x.astype(f"<{np.dtype(kind).str[1:]}").tobytes()
    return b"d" + x.astype("<f8").tobytes()


def matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(chr(data[0])).newbyteorder("<"), offset=1).astype(np.float64).reshape(rows, -1)
