"""Recalibrated and stacked log risk ratios: convex weights, an intercept and a slope of bounded size, by the offset likelihood."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.operators import boosting as bo
from tercet.operators.fitting import fit_rows, minimise
from tercet.operators.learners import weighted_log_rr
from tercet.operators.pricing import softplus
from tercet.operators.resampling import fold_of
from tercet.session import dropped_step

#: Bounds and softness of the fit.
MOST_SLOPE, MOST_INTERCEPT, SOFTNESS = 4.0, 12.0, 0.05


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _read(p: np.ndarray, k: int) -> tuple[np.ndarray, float, float]:
    e = np.exp(p[:k] - p[:k].max())
    return e / e.sum(), float(MOST_INTERCEPT * np.tanh(p[k] / MOST_INTERCEPT)), float(MOST_SLOPE * _sigmoid(p[k + 1]))


def stack_loss(k: int, direction: str, even: float):
    """Mean offset likelihood of k centred log ratios; values: ratios, y, offset, weight (summing to one). ``even`` pulls the weights together."""
    sign = {"high": -1.0, "low": 1.0, "none": 0.0}[direction]

    def loss(p: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray]:
        share, a, slope = _read(p, k)
        x, y, offset, w = v[:, :k], v[:, k], v[:, k + 1], v[:, k + 2]
        mixed = x @ share
        raw = a + slope * mixed
        g = sign * SOFTNESS * np.logaddexp(0, sign * raw / SOFTNESS) if sign else raw
        eta = offset + g
        value = (w * (np.logaddexp(0, eta) - y * eta)).sum() + even * w.sum() * ((share - 1 / k) ** 2).sum()
        d = w * (_sigmoid(eta) - y) * (_sigmoid(sign * raw / SOFTNESS) if sign else 1.0)
        by_share = slope * (d @ x) + 2 * even * w.sum() * (share - 1 / k)
        grad = np.concatenate([share * (by_share - share @ by_share), [d.sum() * (1 - (a / MOST_INTERCEPT) ** 2), (d @ mixed) * slope * (1 - slope / MOST_SLOPE)]])
        return float(value), grad

    return loss


@dataclass(frozen=True)
class Stack:
    weights: list[float]
    intercept: float
    slope: float
    centres: list[float]
    direction: str
    nll: float

    def log_rr(self, ratios: list[Column]) -> Column:
        """The ratio, held to its direction's side of 0."""
        mixed = sum(((r - c) * w for r, c, w in zip(ratios, self.centres, self.weights, strict=True)), F.lit(0.0))
        raw = F.lit(self.intercept) + self.slope * mixed
        return {"high": F.least(raw, F.lit(0.0)), "low": F.greatest(raw, F.lit(0.0)), "none": raw}[self.direction]

    def soft_log_rr(self, ratios: list[Column]) -> Column:
        raw = F.lit(self.intercept) + self.slope * sum(((r - c) * w for r, c, w in zip(ratios, self.centres, self.weights, strict=True)), F.lit(0.0))
        return {"high": -SOFTNESS * softplus(-raw / SOFTNESS), "low": SOFTNESS * softplus(raw / SOFTNESS), "none": raw}[self.direction]


def stack(pair: DataFrame, ratios: list[Column], treated: Column, offset: Column, direction: str = "none", even: float = 1e-4) -> Stack:
    """Convex weights of ``ratios`` (one of them: an affine calibration). Rows with a null do not teach; without rows it raises."""
    k = len(ratios)
    held = pair.select(*[r.cast("double").alias(f"r{i}") for i, r in enumerate(ratios)], treated.cast("double").alias("y"), offset.cast("double").alias("o")).na.drop()
    s = held.agg(F.count("*").alias("n"), *[F.avg(f"r{i}").alias(f"r{i}") for i in range(k)]).first()
    if not s.n:
        raise ValueError("no rows to learn from")
    centres = [float(s[f"r{i}"]) for i in range(k)]
    rows, path = fit_rows(held, [*[F.col(f"r{i}") - c for i, c in enumerate(centres)], F.col("y"), F.col("o"), F.lit(1.0 / s.n)])
    fit = minimise(rows, stack_loss(k, direction, even), np.concatenate([np.zeros(k + 1), [np.log(0.125 / 0.875)]]), tolerance=1e-12)
    dropped_step(pair.sparkSession, path)
    share, a, slope = _read(fit.parameters, k)
    return Stack(share.tolist(), a, slope, centres, direction, fit.loss)


def crossfit_pair(df: DataFrame, columns: list[str], arm: str, group: str, key: Column, folds: int = 5, seed: str = "0", **options) -> tuple[DataFrame, Stack]:
    """Buyers of ``arm`` or C with ``fold``, ``raw`` (their log ratio, learnt without their group's fold; all folds grow in the same passes)
    and ``calibrated`` (held to the arm's direction); and the calibration, learnt from the raw ones."""
    pair = df.filter((F.col("purchase") == 1) & F.col("arm").isin(arm, "C")).withColumn("fold", fold_of(F.col(group), folds, seed).cast("int"))
    treated, offset = F.col("arm") == arm, F.ln(F.col(f"pi_{arm}") / F.col("pi_C"))
    starts = [weighted_log_rr(pair.filter(F.col("fold") != f), arm) for f in range(folds)]
    fit = bo.boost(pair, columns, bo.logistic_by_arm(1, folds), [treated, F.lit(0), F.col("fold")], starts, offset=[offset] * folds, key=key, **options)
    out = pair.withColumn("__m", fit.predict()).withColumn("raw", F.col("__m")[F.col("fold")]).drop("__m")
    found = stack(out, [F.col("raw")], treated, offset, {"H": "high", "L": "low"}[arm])
    return out.withColumn("calibrated", found.log_rr([F.col("raw")])), found
