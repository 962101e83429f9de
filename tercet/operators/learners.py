"""Learners of conversion and of the buyer side on boosted trees, and the price-level classifier with falling demand curves.

Every model is a column: fitted trees or weights are applied in tasks to any frame that has its columns. Rows that teach are
whole tables; rounds, depth and rate are arguments.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.operators import boosting as bo
from tercet.operators.features import CONTROLS
from tercet.operators.fitting import fit_rows, minimise
from tercet.operators.ordering import quantiles
from tercet.operators.pricing import arc_elasticities, global_scalar_beta, isotonic_decreasing, sigmoid
from tercet.session import dropped_step, ship_library, written_step

ARMS = ("H", "C", "L")


def logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


# ---- conversion ---------------------------------------------------------------------------------


@dataclass
class Conversion:
    """Boosted conversion whose margin cannot rise in the price columns."""

    trees: bo.Trees
    prices: tuple[str, ...]

    def margin(self, step: float = 0.0) -> Column:
        """The log odds with all log prices moved by ``step``."""
        return self.trees.predict(columns=[F.col(c) + step if c in self.prices else F.col(c) for c in self.trees.columns])[0]

    def applied(self, df: DataFrame, delta: float = 0.1) -> DataFrame:
        """``df`` with ``conversion`` and ``elasticity``: minus the slope of the log odds in the log price, times the share that does not convert."""
        moved = df.withColumns({"__at": self.margin(), "__up": self.margin(delta), "__down": self.margin(-delta)})
        share = sigmoid(F.col("__at"))
        return moved.withColumns({"conversion": share, "elasticity": -(F.col("__up") - F.col("__down")) / (2 * delta) * (1 - share)}).drop("__at", "__up", "__down")


def conversion(df: DataFrame, columns: list[str], prices: tuple[str, ...], bought: str, key: Column, monotone: bool = True, **options) -> Conversion:
    """``columns`` and log ``prices`` explain ``bought`` (0 or 1)."""
    share = df.agg(F.avg(bought).alias("p")).first().p
    fit = bo.boost(df, [*columns, *prices], bo.logistic, [F.col(bought)], [logit(0.5 if share is None else share)], key=key, monotone=dict.fromkeys(prices, -1) if monotone else None, **options)
    return Conversion(fit, prices)


def conversion_by_arm(df: DataFrame, columns: list[str], bought: str, arm: str, arms: int, key: Column, folds: int = 1, fold: Column | None = None, **options) -> bo.Trees:
    """A conversion model for each arm, learnt from its own rows, and for each fold, learnt without it: all in the same passes.
    Output ``fold`` x ``arms`` + arm."""
    own = F.lit(0) if fold is None else fold
    s = {(r.a, r.f): (r.n, r.s) for r in df.groupBy(F.col(arm).alias("a"), own.alias("f")).agg(F.count(bought).alias("n"), F.sum(bought).alias("s")).collect()}  # arms x folds

    def start(f: int, k: int) -> float:
        rest = [v for (a, g), v in s.items() if a == k and (g != f or folds < 2)]
        return logit(sum(v[1] or 0 for v in rest) / max(sum(v[0] for v in rest), 1))

    return bo.boost(df, columns, bo.logistic_by_arm(arms, folds), [F.col(bought), F.col(arm), own], [start(f, k) for f in range(folds) for k in range(arms)], key=key, **options)


def augmented_arms(df: DataFrame, columns: list[str], bought: str, arm: str, pi: list[float], key: Column, folds: int = 4, **options) -> DataFrame:
    """``df`` with ``psi0``..: the doubly robust value of every arm, its outcome model learnt without the row's own fold. Folds are hashes of the key."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(folds)).cast("int")
    model = conversion_by_arm(df, columns, bought, arm, len(pi), key, folds, fold, **options)
    read, out = df.withColumn("__m", model.predict()), {}
    for k, p in enumerate(pi):
        m = sigmoid(F.col("__m")[fold * len(pi) + k])
        out[f"psi{k}"] = m + F.when(F.col(arm) == k, (F.col(bought) - m) / p).otherwise(0.0)
    return read.withColumns(out).drop("__m")


def arm_effects(psi: DataFrame, columns: list[str], multipliers: list[float], key: Column, **options) -> DataFrame:
    """``psi`` (of ``augmented_arms``) with ``s0``..: the arms' values smoothed over ``columns``, not rising in price, and ``elasticity``,
    minus the slope of their logs."""
    k = len(multipliers)
    means = psi.agg(*[F.coalesce(F.avg(f"psi{i}"), F.lit(0.5)).alias(f"m{i}") for i in range(k)]).first()
    second = bo.boost(psi, columns, bo.squared_each, [F.col(f"psi{i}") for i in range(k)], [means[f"m{i}"] for i in range(k)], key=key, **options)
    smooth = psi.withColumn("__m", second.predict()).withColumns({f"__s{i}": F.ln(F.least(F.greatest(F.col("__m")[i], F.lit(1e-4)), F.lit(1 - 1e-4))) for i in range(k)})
    falling = isotonic_decreasing([F.col(f"__s{i}") for i in range(k)])
    centre = sum(math.log(m) for m in multipliers) / k
    x = [math.log(m) - centre for m in multipliers]
    curve = smooth.withColumns({f"s{i}": F.exp(c) for i, c in enumerate(falling)})
    slope = sum((F.ln(f"s{i}") * d for i, d in enumerate(x)), F.lit(0.0))
    return curve.withColumn("elasticity", -slope / sum(d * d for d in x)).drop("__m", *[f"__s{i}" for i in range(k)])


# ---- buyer side ---------------------------------------------------------------------------------


def _buyers(df: DataFrame, arms: tuple[str, ...]) -> DataFrame:
    return df.filter((F.col("purchase") == 1) & F.col("arm").isin(*arms))


def weighted_log_rr(pair: DataFrame, arm: str, steps: int = 30) -> float:
    """The one log risk ratio of greatest likelihood when allocations differ by row: Newton steps over counts by offset."""
    held = pair.groupBy((F.col("arm") == arm).cast("double").alias("y"), F.ln(F.col(f"pi_{arm}") / F.col("pi_C")).alias("o")).agg(F.count("*").alias("n"))
    at = 0.0
    for _ in range(steps):
        p = sigmoid(F.col("o") + at)
        s = held.agg(F.sum(F.col("n") * (F.col("y") - p)).alias("g"), F.sum(F.col("n") * p * (1 - p)).alias("h")).first()
        if not s.h or s.h < 1e-12:
            break
        step = min(max(s.g / s.h, -2.0), 2.0)
        at = min(max(at + step, -20.0), 20.0)
        if abs(step) < 1e-10:
            break
    return at


def offset_pair(df: DataFrame, columns: list[str], arm: str, key: Column, **options) -> bo.Trees:
    """Log risk ratio of ``arm`` against C among buyers; the log ratio of the allocations is an offset that predictions leave out."""
    pair = _buyers(df, (arm, "C"))
    return bo.boost(pair, columns, bo.logistic, [F.col("arm") == arm], [weighted_log_rr(pair, arm)], offset=[F.ln(F.col(f"pi_{arm}") / F.col("pi_C"))], key=key, **options)


def inverse_weighted_pair(df: DataFrame, columns: list[str], arm: str, key: Column, **options) -> bo.Trees:
    """The same ratio with rows weighted by one over their own allocation, to mean one."""
    pair = _buyers(df, (arm, "C")).withColumn("__w", 1 / F.when(F.col("arm") == arm, F.col(f"pi_{arm}")).otherwise(F.col("pi_C")))
    s = pair.agg(F.avg("__w").alias("w"), (F.sum(F.when(F.col("arm") == arm, F.col("__w"))) / F.sum("__w")).alias("p")).first()
    return bo.boost(pair, columns, bo.logistic, [F.col("arm") == arm], [logit(s.p or 0.0)], weight=F.col("__w") / F.lit(s.w or 1.0), key=key, **options)


def inverse_weighted_arms(df: DataFrame, columns: list[str], key: Column, **options) -> bo.Trees:
    """All three arms at once, weighted by one over the row's own allocation: margins in the order H, C, L."""
    own = F.when(F.col("arm") == "H", F.col("pi_H")).when(F.col("arm") == "C", F.col("pi_C")).otherwise(F.col("pi_L"))
    held = _buyers(df, ARMS).withColumn("__w", 1 / own)
    s = {r.arm: r.w for r in held.groupBy("arm").agg(F.sum("__w").alias("w")).collect()}  # three rows
    mean = held.agg(F.avg("__w")).first()[0] or 1.0
    whole = sum(s.values()) or 1.0
    number = F.when(F.col("arm") == "H", 0).when(F.col("arm") == "C", 1).otherwise(2)
    return bo.boost(held, columns, bo.softmax, [number], [math.log(max(s.get(a, 0.0) / whole, 1e-9)) for a in ARMS], weight=F.col("__w") / F.lit(mean), key=key, **options)


def scalar_flip(df: DataFrame, columns: list[str], z: list[float], key: Column, **options) -> bo.Trees:
    """One elasticity a buyer, the softplus of the margin, by the likelihood of the arms at the doses ``z``. Starts at the best constant."""
    held, pi = _buyers(df, ARMS), [F.col(f"pi_{a}") for a in ARMS]
    beta = max(global_scalar_beta(held, pi, z).first().beta, 1e-6)
    number = F.when(F.col("arm") == "H", 0).when(F.col("arm") == "C", 1).otherwise(2)
    return bo.boost(held, columns, bo.scalar_flip, [number, *pi, *[F.lit(d) for d in z]], [beta + math.log(-math.expm1(-beta))], key=key, **options)


def dose_elasticity(mean: np.ndarray, z: list[float], most: float = 30.0) -> np.ndarray:
    """The elasticity in [0, ``most``] at which equally allocated buyers have this mean dose (against C), by bisection."""
    d = np.array(z) - z[1]
    low, high = np.zeros(len(mean)), np.full(len(mean), most)

    def at(beta: np.ndarray) -> np.ndarray:
        return (bo.class_shares(-beta[:, None] * d) * d).sum(1)

    wanted = np.clip(mean, at(high), at(low))
    for _ in range(60):
        middle = (low + high) / 2
        up = at(middle) > wanted
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return (low + high) / 2


def moment_forest(df: DataFrame, columns: list[str], z: list[float], key: Column, most: float = 30.0, **options) -> Column:
    """Elasticity from the buyers' mean dose: a forest for it, weighted by one over the allocation, inverted at every row."""
    held = _buyers(df, ARMS)
    dose = F.when(F.col("arm") == "H", F.lit(z[0] - z[1])).when(F.col("arm") == "C", F.lit(0.0)).otherwise(F.lit(z[2] - z[1]))
    own = F.when(F.col("arm") == "H", F.col("pi_H")).when(F.col("arm") == "C", F.col("pi_C")).otherwise(F.col("pi_L"))
    fit = bo.forest(held, columns, dose, weight=1 / own, key=key, **options)
    return fit.predict(lambda m: dose_elasticity(m[:, 0], z, most)[:, None])[0]


# ---- price levels -------------------------------------------------------------------------------


def softplus_loss(k: int, d: int) -> Callable:
    """Negative log likelihood of price levels whose log demand falls by softplus steps; values: d columns, k log propensities, level, weight."""

    def loss(p: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray]:
        w, a = p[: (k - 1) * d].reshape(k - 1, d), p[(k - 1) * d :]
        x, offset, level, q = v[:, :d], v[:, d : d + k], v[:, d + k].astype(int), v[:, -1]
        u = x @ w.T + a
        z = offset.copy()
        z[:, 1:] -= np.logaddexp(0, u).cumsum(1)
        top = z.max(1)
        whole = top + np.log(np.exp(z - top[:, None]).sum(1))
        miss = np.exp(z - whole[:, None])
        value = float((q * (whole - z[np.arange(len(z)), level])).sum())
        miss[np.arange(len(z)), level] -= 1
        above = (q[:, None] * miss)[:, :0:-1].cumsum(1)[:, ::-1]  # what the levels above each step sum to
        du = -above * (0.5 * (1 + np.tanh(u / 2)))
        return value, np.concatenate([(du.T @ x).ravel(), du.sum(0)])

    return loss


def unit_weight(df: DataFrame, scheme: str = "per_product", cap: float | None = 0.99) -> DataFrame:
    """``df`` with ``unit_weight``: units (``log_qty``) by scheme, cut at a quantile."""
    q = F.exp("log_qty")
    if scheme == "per_product":
        mean = df.groupBy("stock_code").agg(F.avg(q).alias("__mean"))
        raw = df.join(mean, "stock_code").withColumn("unit_weight", q / F.greatest("__mean", F.lit(1e-12))).drop("__mean")
    elif scheme in ("units", "log", "none"):
        raw = df.withColumn("unit_weight", {"units": q, "log": F.log1p(q), "none": F.lit(1.0)}[scheme])
    else:
        raise ValueError(f"unknown weights: {scheme}")
    if cap is None:
        return raw
    top = quantiles(raw, "unit_weight", [cap]).select(F.col("q")[0].alias("__top"))
    return raw.crossJoin(F.broadcast(top)).withColumn("unit_weight", F.greatest(F.least("unit_weight", "__top"), F.lit(1e-12))).drop("__top")


@dataclass
class PriceLevels:
    """A classifier of price levels, cheapest first, read as a demand curve.

    The propensity tells how often the seller puts such a row at each level, the posterior where a sold unit came from; their
    ratio is the demand at the level. ``constraint``: "none", "isotonic" (the curve projected) or "softplus" (falling by form).
    """

    k: int = 3
    constraint: str = "softplus"
    column: str = "rel_price"
    columns: list[str] = field(default_factory=lambda: list(CONTROLS))
    clip: float = 0.02
    scheme: str = "per_product"
    cap: float | None = 0.99
    ridge: float = 1e-3
    use_propensity: bool = True
    options: dict = field(default_factory=dict)

    def level(self) -> Column:
        return F.aggregate(F.array(*[F.lit(float(e)) for e in self.edges]), F.lit(0), lambda n, e: n + (F.col(self.column) >= e).cast("int"))

    def fit(self, df: DataFrame, key: Column) -> PriceLevels:
        """Rows with a null price level, quantity or column do not teach the constrained fit; trees take null columns."""
        ship_library(df.sparkSession)
        k, d = self.k, len(self.columns)
        self.edges = quantiles(df, self.column, [i / k for i in range(1, k)]).first().q
        placed = unit_weight(df.filter(F.col(self.column).isNotNull()), self.scheme, self.cap).withColumn("__level", self.level())
        held, path = written_step(placed.select(*self.columns, "__level", "unit_weight", self.column, key.alias("__key")), "levels")
        stats = held.groupBy("__level").agg(F.count("*").alias("n"), F.sum("unit_weight").alias("w"), F.avg(self.column).alias("r")).collect()  # k rows
        n, w, r = ({s["__level"]: s[name] for s in stats} for name in ("n", "w", "r"))
        if sorted(n) != list(range(k)):
            raise ValueError("a price level has no rows")
        self.prices = [r[i] for i in range(k)]

        def shares(by: dict) -> list[float]:
            return [math.log(by[i] / sum(by.values())) for i in range(k)]

        self.propensity = bo.boost(held, self.columns, bo.softmax, [F.col("__level")], shares(n), key=F.col("__key"), **self.options)
        if self.constraint == "softplus":
            scale = held.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(self.columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(self.columns)], F.avg("unit_weight").alias("w")).first()
            self.centre, self.spread = np.array([scale[f"m{i}"] for i in range(d)], float), np.array([scale[f"s{i}"] or 0.0 for i in range(d)])
            self.spread[self.spread <= 1e-12] = 1.0
            offered = held.withColumn("__pi", self.propensity.predict(self._clipped))
            x = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.centre, self.spread, strict=True)]
            rows, place = fit_rows(offered, [*x, *[F.ln(F.col("__pi")[i]) for i in range(k)], F.col("__level"), F.col("unit_weight") / F.lit(scale.w)])
            self.found = minimise(rows, softplus_loss(k, d), np.zeros((k - 1) * (d + 1)), np.repeat([self.ridge, 0.0], [(k - 1) * d, k - 1]))
            dropped_step(df.sparkSession, place)
        else:
            self.posterior_trees = bo.boost(held, self.columns, bo.softmax, [F.col("__level")], shares(w), weight=F.col("unit_weight"), key=F.col("__key"), **self.options)
        dropped_step(df.sparkSession, path)
        return self

    def _clipped(self, m: np.ndarray) -> np.ndarray:
        pi = np.maximum(bo.class_shares(m), self.clip)
        return pi / pi.sum(1, keepdims=True)

    def _falling(self) -> Column:
        k, d = self.k, len(self.columns)
        w, a = self.found.parameters[: (k - 1) * d].reshape(k - 1, d), self.found.parameters[(k - 1) * d :]
        centre, spread = self.centre, self.spread

        @F.pandas_udf("array<double>")
        def read(*given: pd.Series) -> pd.Series:
            x = (np.column_stack([g.to_numpy(float, na_value=np.nan) for g in given]) - centre) / spread
            steps = np.logaddexp(0, x @ w.T + a).cumsum(1)
            return pd.Series(list(np.column_stack([np.zeros(len(x)), -steps])))

        return read(*[F.col(c).cast("double") for c in self.columns])

    def applied(self, df: DataFrame) -> DataFrame:
        """``df`` with ``pi0``.. (propensity), ``b0``.. (posterior), ``d0``.. (log demand, up to a constant), ``arc0``.. between
        neighbouring levels and ``elasticity``, minus the slope of the log demand in the levels' mean log price. Without a column that the
        constrained curve needs, the row's curve is NaN."""
        k = self.k
        out = df.withColumn("__pi", self.propensity.predict(self._clipped)).withColumns({f"pi{i}": F.col("__pi")[i] for i in range(k)})
        if self.constraint == "softplus":
            out = out.withColumn("__d", self._falling()).withColumns({f"d{i}": F.col("__d")[i] for i in range(k)})
            raw = [F.col(f"pi{i}") * F.exp(f"d{i}") for i in range(k)]
            whole = sum(raw[1:], raw[0])
            out = out.withColumns({f"b{i}": r / whole for i, r in enumerate(raw)})
        else:
            out = out.withColumn("__d", self.posterior_trees.predict(bo.class_shares)).withColumns({f"b{i}": F.greatest(F.col("__d")[i], F.lit(1e-12)) for i in range(k)})
            logs = [F.ln(f"b{i}") - (F.ln(f"pi{i}") if self.use_propensity else F.lit(0.0)) for i in range(k)]
            out = out.withColumns({f"__l{i}": c for i, c in enumerate(logs)})
            logs = [F.col(f"__l{i}") for i in range(k)]
            if self.constraint == "isotonic":
                logs = isotonic_decreasing(logs, [F.col(f"pi{i}") for i in range(k)])
            middle = sum(logs[1:], logs[0]) / k
            out = out.withColumns({f"d{i}": c - middle for i, c in enumerate(logs)}).drop(*[f"__l{i}" for i in range(k)])
        centre = sum(self.prices) / k
        gaps = [p - centre for p in self.prices]
        slope = sum((F.col(f"d{i}") * g for i, g in enumerate(gaps)), F.lit(0.0)) / max(sum(g * g for g in gaps), 1e-12)
        arcs = arc_elasticities([F.col(f"d{i}") for i in range(k)], self.prices)
        return out.withColumns({**{f"arc{i}": c for i, c in enumerate(arcs)}, "elasticity": -slope, "level": self.level()}).drop("__pi", "__d")
