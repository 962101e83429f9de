"""Logistic conversion on log price: plain, or with splines and a slope that varies with columns. Closed-form elasticities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.operators.fitting import fit_rows, loss_sums, minimise, row_arrays
from tercet.operators.pricing import sigmoid
from tercet.session import dropped_step, ship_library


def spline_basis(x: np.ndarray, low: float, high: float, knots: int, degree: int = 3) -> np.ndarray:
    """B-splines on even knots, but for the last one; beyond the ends as at the ends."""
    step = (high - low) / (knots - 1) or 1.0
    at = low + step * np.arange(-degree, knots + degree)
    x = np.clip(x, low, high)[:, None]
    out = ((x >= at[:-1]) & (x < at[1:])).astype(float)
    for d in range(1, degree + 1):
        left, right = (x - at[: -d - 1]) / (d * step), (at[d + 1 :] - x) / (d * step)
        out = left * out[:, :-1] + right * out[:, 1:]
    return out[:, : knots + degree - 2]


@dataclass(frozen=True)
class Logit:
    """A fitted model: the design's columns are ``columns``, splines of some of them, log price and its products with others (standardised)."""

    columns: list[str]
    price: str
    curved: list[int]
    varying: list[int]
    knots: int
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    constant: float
    weights: np.ndarray

    def applied(self, df: DataFrame) -> DataFrame:
        """``df`` with ``conversion`` and ``elasticity``, the slope in log price times the share that does not convert; null without a column."""
        model = self

        def read(v: np.ndarray) -> np.ndarray:
            slope = -(model.weights[-1 - len(model.varying)] + _standard(model, v)[:, model.varying] @ model.weights[len(model.weights) - len(model.varying) :])
            return np.column_stack([model.constant + _design(model, v) @ model.weights, slope])

        values: list[Column] = [F.col(c).cast("double") for c in (*self.columns, self.price)]
        moved = df.withColumn("__m", row_arrays(read, values))
        whole = F.lit(True)
        for v in values:
            whole = whole & v.isNotNull()
        share = F.when(whole, sigmoid(F.col("__m")[0]))
        return moved.withColumns({"conversion": share, "elasticity": F.col("__m")[1] * (1 - share)}).drop("__m")


def _standard(model: Logit, v: np.ndarray) -> np.ndarray:
    return (v[:, : len(model.columns)] - model.centre) / model.spread


def _design(model: Logit, v: np.ndarray) -> np.ndarray:
    p = len(model.columns)
    curves = [spline_basis(v[:, i], model.low[i], model.high[i], model.knots) for i in model.curved]
    return np.column_stack([v[:, :p], *curves, v[:, p], v[:, p, None] * _standard(model, v)[:, model.varying]])


def logit(df: DataFrame, columns: list[str], price: str, bought: str, curved: tuple[str, ...] = (), varying: tuple[str, ...] = (), c: float = 1.0, knots: int = 5) -> Logit:
    """Ridge logistic regression (1 / (2 ``c``) times the squared weights of the standardised design). Rows with a null do not teach. Equal rows
    are counted once before the passes, which see each with its number."""
    ship_library(df.sparkSession)
    rows, path = fit_rows(df, [*[F.col(x) for x in columns], F.col(price), F.col(bought)], counted=True)
    p = len(columns)
    k = F.col(f"v{p + 2}")
    s = rows.agg(F.sum(k).alias("n"), *[f.alias(f"{n}{i}") for i in range(p) for n, f in (("m", F.sum(k * F.col(f"v{i}")) / F.sum(k)), ("l", F.min(f"v{i}")), ("h", F.max(f"v{i}")))]).first()
    if not s.n:
        raise ValueError("no rows without a null")
    m, low, high = (np.array([s[f"{n}{i}"] for i in range(p)], float) for n in "mlh")
    spread = rows.agg(*[F.sqrt(F.sum(k * (F.col(f"v{i}") - float(m[i])) ** 2) / F.sum(k)).alias(f"s{i}") for i in range(p)]).first()
    sd = np.array(spread, float)
    sd[sd <= 1e-12] = 1.0
    raw = Logit(columns, price, [columns.index(x) for x in curved], [columns.index(x) for x in varying], knots, low, high, m, sd, 0.0, np.zeros(0))
    size = p + len(curved) * (knots + 1) + 1 + len(varying)

    def spreads(_: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray]:
        x, k = _design(raw, v), v[:, -1]
        return float(k.sum()), np.concatenate([k @ x, k @ (x * x)])

    n, both = loss_sums(rows, spreads, [np.zeros(2 * size)])[0]
    mean = both[:size] / n
    scale = np.sqrt(np.maximum(both[size:] / n - mean * mean, 0))
    scale[scale <= 1e-9 * (1 + np.abs(mean))] = 1.0

    def loss(w: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray]:
        x, y, k = (_design(raw, v) - mean) / scale, v[:, -2], v[:, -1]
        eta = x @ w[1:] + w[0]
        miss = k * (0.5 * (1 + np.tanh(eta / 2)) - y)
        return float(k @ (np.logaddexp(0, eta) - y * eta)), np.concatenate([[miss.sum()], x.T @ miss])

    fit = minimise(rows, loss, np.zeros(size + 1), np.repeat([0.0, 0.5 / c], [1, size]), tolerance=1e-11)
    dropped_step(df.sparkSession, path)
    weights = fit.parameters[1:] / scale
    return Logit(columns, price, raw.curved, raw.varying, knots, low, high, m, sd, float(fit.parameters[0] - mean @ weights), weights)
