"""Recurrences over arrays in time linear in their length: whole Arrow batches at once, one step of all rows at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = 1 << 20


def _solve(b: pa.Array, c: pa.Array) -> pa.Array:
    """x[t] = b[t] + c[t] * x[t + 1] of each row, 0 beyond its end; a null row gives a null one. Rows are taken in groups of at most
    CELLS places (or one row), longest first, so that short rows aren't padded to the length of long ones."""
    sizes = np.diff(np.asarray(b.offsets))
    known = np.asarray(b.is_valid()) & np.asarray(c.is_valid())
    starts_b, starts_c = np.asarray(b.offsets)[:-1] - b.offsets[0].as_py(), np.asarray(c.offsets)[:-1] - c.offsets[0].as_py()
    vb, vc = (x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for x in (b, c))
    if np.any(np.diff(np.asarray(c.offsets))[known] != sizes[known]):
        raise ValueError("both arrays of a recurrence have the same length")
    sizes = np.where(known, sizes, 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(ends[-1])
    order = np.argsort(-sizes, kind="stable")
    order = order[: np.count_nonzero(sizes)]
    while len(order):
        rows, order = order[: max(1, CELLS // sizes[order[0]])], order[max(1, CELLS // sizes[order[0]]) :]
        n = sizes[rows]
        x, live = np.zeros(len(rows)), len(rows)
        for t in range(n[0] - 1, -1, -1):
            live = np.searchsorted(-n, -t, side="left")  # rows longer than t come first
            r = rows[:live]
            x[:live] = vb[starts_b[r] + t] + vc[starts_c[r] + t] * x[:live]
            out[ends[r] + t] = x[:live]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out), mask=pa.array(~known))


def from_the_end(b: Column, c: Column) -> Column:
    """x[t] = b[t] + c[t] * x[t + 1] for arrays of doubles of one length."""
    return F.arrow_udf(_solve, "array<double>")(b.cast("array<double>"), c.cast("array<double>"))


def following(x: Column) -> Column:
    """The element after each one, 0 after the last."""
    return F.when(F.size(x) > 0, F.concat(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), F.array(F.lit(0.0)))).otherwise(x)


def running_sum(x: Column) -> Column:
    """Sum of the elements up to and with each one."""
    return F.reverse(from_the_end(F.reverse(x), F.transform(x, lambda _: F.lit(1.0))))
