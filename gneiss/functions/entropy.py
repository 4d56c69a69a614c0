"""Byte statistics: Shannon entropy by window, and what they say about the content."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The window, the budget of sampled bytes, the bytes below which nothing is said, and the classes' limits.
WINDOW, BUDGET, LEAST = 4096, 8 << 20, 256
SPARSE_MAX, PACKED_MIN, TEXT_PRINTABLE, UNIFORM_LOW, UNIFORM_HIGH = 1.5, 7.2, 0.85, 0.65, 1.45

_PROFILE = "struct<windows:long,sampled:long,mean:double,low:double,high:double,printable:double,chi_square:double,fill:int>"
_PRINTABLE = np.array([0x20 <= b <= 0x7E or b in (9, 10, 13) for b in range(256)])


def shannon(counts: np.ndarray) -> float:
    """Bits a byte; 0 for nothing."""
    n = counts.sum()
    p = counts[counts > 0] / n if n else np.zeros(0)
    return float(-(p * np.log2(p)).sum()) + 0.0


def sample_offsets(size: int, window: int = WINDOW, budget: int | None = BUDGET) -> list[int]:
    """All windows if they are within the budget or there is none, else as many as are, spread evenly and aligned."""
    total = -(-size // window)
    most = total if budget is None else max(1, budget // window)
    if total <= most:
        return [k * window for k in range(total)]
    return [k * size // most // window * window for k in range(most)]


def profile_of(raw: bytes, budget: int | None = BUDGET) -> dict | None:
    data = np.frombuffer(raw, np.uint8)
    pooled, each = np.zeros(256, np.int64), []
    for at in sample_offsets(len(raw), budget=budget):
        counts = np.bincount(data[at : at + WINDOW], minlength=256)
        pooled += counts
        each.append(shannon(counts))
    n = int(pooled.sum())
    expected = n / 256
    chi = float(((pooled - expected) ** 2 / expected).sum() / 255) if n else 0.0
    used = np.flatnonzero(pooled)
    return {
        "windows": len(each), "sampled": n, "mean": float(np.mean(each)) if each else 0.0, "low": min(each, default=0.0), "high": max(each, default=0.0),
        "printable": float(pooled[_PRINTABLE].sum() / n) if n else 0.0, "chi_square": chi, "fill": int(used[0]) if len(used) == 1 else None,
    }


def profile(c: Column, budget: int | None = BUDGET) -> Column:
    """The profile of a binary column's bytes: of windows within the budget, of all for None."""
    kind = pa.struct([("windows", pa.int64()), ("sampled", pa.int64()), ("mean", pa.float64()), ("low", pa.float64()), ("high", pa.float64()), ("printable", pa.float64()), ("chi_square", pa.float64()), ("fill", pa.int32())])

    def run(raw: pa.Array) -> pa.Array:
        return pa.array([None if x is None else profile_of(x, budget) for x in raw.to_pylist()], kind)

    return F.arrow_udf(run, _PROFILE)(c.cast("binary"))


def bits(c: Column) -> Column:
    """Shannon entropy of a whole binary column's value."""

    def run(raw: pa.Array) -> pa.Array:
        return pa.array([None if x is None else shannon(np.bincount(np.frombuffer(x, np.uint8), minlength=256)) for x in raw.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(c.cast("binary"))


def classify(p: Column) -> Column:
    """unknown, erased, sparse, text, binary, random or packed."""
    return (
        F.when(p["sampled"] < LEAST, "unknown")
        .when(p["fill"].isNotNull(), "erased")
        .when(p["mean"] < SPARSE_MAX, "sparse")
        .when(p["printable"] >= TEXT_PRINTABLE, "text")
        .when(p["mean"] < PACKED_MIN, "binary")
        .when(p["chi_square"].between(UNIFORM_LOW, UNIFORM_HIGH), "random")
        .otherwise("packed")
    )
