"""Quasi-Newton fits of own losses: values and gradients are summed in tasks, the driver holds parameter vectors only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.session import ship_library, written_step

#: Shorter steps that one pass tries together when the full step does not lessen the loss enough.
STEPS = (0.5, 0.25, 0.1, 0.03, 0.01, 0.001, 0.0001)

#: Parameters and rows x values to the summed loss and its gradient.
Loss = Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]]


@dataclass(frozen=True)
class Fit:
    parameters: np.ndarray
    loss: float
    passes: int
    converged: bool


def fit_rows(df: DataFrame, values: list[Column], counted: bool = False) -> tuple[DataFrame, str]:
    """The values as doubles, written once and read by every pass; rows with a null or NaN are left out. ``counted``: equal rows once, with
    their number as the last value."""
    cast = [v.cast("double") for v in values]
    named = df.select(*[F.when(~F.isnan(c), c).alias(f"v{i}") for i, c in enumerate(cast)]).na.drop()
    return written_step(named.groupBy(*named.columns).agg(F.count("*").cast("double").alias(f"v{len(cast)}")) if counted else named, "fit")


def row_arrays(read: Callable[[np.ndarray], np.ndarray], values: list[Column]) -> Column:
    """An array column: what ``read`` makes of the matrix of the values (NaN for null), a row each."""

    @F.arrow_udf("array<double>")
    def found(*given: pa.Array) -> pa.Array:
        m = np.ascontiguousarray(read(np.column_stack([g.to_numpy(zero_copy_only=False).astype(float) for g in given])), float)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))

    return found(*values)


def loss_sums(rows: DataFrame, loss: Loss, tried: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """Loss and gradient over all rows at every parameter vector in ``tried``, in one pass."""
    size = len(tried[0]) + 1

    def add(batches):
        total = np.zeros((len(tried), size))
        for batch in batches:
            if batch.num_rows:
                v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                for k, p in enumerate(tried):
                    value, gradient = loss(p, v)
                    total[k, 0] += value
                    total[k, 1:] += gradient
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["slot", "value"])

    out = np.zeros(len(tried) * size)
    for r in rows.mapInArrow(add, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect():  # tried x (parameters + 1)
        out[r.slot] = r.value
    return [(float(s[0]), s[1:]) for s in out.reshape(len(tried), size)]


def minimise(rows: DataFrame, loss: Loss, start: np.ndarray, ridge: np.ndarray | None = None, max_passes: int = 400, tolerance: float = 1e-9, memory: int = 10) -> Fit:
    """Limited-memory BFGS with ``ridge`` . parameters^2 added to the loss. A pass values the full step, and a second one all shorter
    steps where that is not enough. Stops when the loss falls by less than ``tolerance`` of itself, or no gradient is left."""
    ship_library(rows.sparkSession)
    ridge = np.zeros(len(start)) if ridge is None else ridge

    def at(tried: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        return [(f + float(ridge @ (p * p)), g + 2 * ridge * p) for p, (f, g) in zip(tried, loss_sums(rows, loss, tried), strict=True)]

    p = np.asarray(start, float)
    (f, g), passes = at([p])[0], 1
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    while passes < max_passes:
        if np.abs(g).max(initial=0) <= 1e-7 * max(1.0, abs(f)):
            return Fit(p, f, passes, True)
        way, saved = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ way) / (s @ y)
            saved.append(a)
            way -= a * y
        way *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / np.linalg.norm(g)
        for (s, y), a in zip(pairs, reversed(saved), strict=True):
            way += s * (a - (y @ way) / (s @ y))
        way, slope, found = -way, float(-(g @ way)), None
        for steps in ((1.0,), STEPS):
            passes += 1
            for t, (value, gradient) in zip(steps, at([p + t * way for t in steps]), strict=True):
                if np.isfinite(value) and value <= f + 1e-4 * t * slope:
                    found = (p + t * way, value, gradient)
                    break
            if found:
                break
        if found is None:
            if not pairs:
                return Fit(p, f, passes, False)
            pairs = []  # start again down the gradient
            continue
        s, y, fell = found[0] - p, found[2] - g, f - found[1]
        p, f, g = found
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs[1 - memory :], (s, y)]
        if fell <= tolerance * max(1.0, abs(f)):
            return Fit(p, f, passes, True)
    return Fit(p, f, passes, False)
