"""Search over settings of the demand models: folds in time, scores of many settings from sums, median pruning, nested validation.

A frame is cut at every bound of every fold into segments of weeks; sums by segment are taken once, and the training and validation side of
a fold is an addition of segments. Pooled models are scored on moment matrices alone (one pass for any number of settings and folds);
shrunk slopes on sums by product and fold, all settings of a pass together in tasks; every other model by one fit a fold.

Every score records all metrics, so that one history can be read under any objective. The nuisances of the orthogonal loss are linear
in the controls and fitted on the training side of the fold. The driver holds the calendar (a row a week), a matrix a segment and a row a
setting and fold. Settings are seeded random draws, each from its own number, so a longer search repeats a shorter one first.

Rows with a null in a control, log price or log quantity (or the truth, where one is given) do not count. A null product is a product of its own. A
fold with an empty side fails every setting; a table too short for a fold raises ValueError.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tercet.operators import demand as de
from tercet.operators import effects as ef
from tercet.operators import models as mo
from tercet.operators.demand import Y, T, Linear
from tercet.operators.features import CONTROLS
from tercet.session import dropped_step, ship_library, written_step

METRICS = ("rmse", "rloss", "rloss_skill", "rloss_vs_constant", "avg_eps", "eps_sd", "oracle", "oracle_bias")
#: Larger is better for these alone.
MAXIMISED = ("rloss_skill", "rloss_vs_constant")
HISTORY = "model string, trial int, settings string, state string, n_folds int, objective string, value double, " + ", ".join(f"{m} double" for m in METRICS)


# ---- settings ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Span:
    """Numbers from ``low`` to ``high``, even or even in logs, in multiples of ``step`` from ``low`` where one is given; ``maybe``: None half of the time."""

    low: float
    high: float
    log: bool = False
    step: int | None = None
    maybe: bool = False

    def draw(self, rng: np.random.Generator):
        u, absent = rng.random(), rng.random() < 0.5
        if self.maybe and absent:
            return None
        if self.step is None:
            return math.exp(math.log(self.low) + u * math.log(self.high / self.low)) if self.log else self.low + u * (self.high - self.low)
        if self.log:
            return min(int(self.high), int(math.exp(math.log(self.low) + u * math.log((self.high + 1) / self.low))))
        return int(self.low) + self.step * int(u * ((self.high - self.low) // self.step + 1))


#: The ranges searched for pooled, two-way, Poisson and shrunk models. The boosted and orthogonal ones have this library's own options.
SPACES: dict[str, dict[str, Span | tuple]] = {
    "pooled_loglog": {"use_controls": (True, False), "ridge": Span(1e-6, 10.0, log=True)},
    "twoway_fe": {"add_controls": (True, False), "collinear_tol": Span(1e-6, 0.2, log=True)},
    "poisson_glm": {"use_controls": (True, False), "alpha": Span(1e-8, 1.0, log=True), "max_iter": Span(100, 500, step=100)},
    "shrunk_per_product": {"min_obs": Span(6, 40, step=1), "min_price_sd": Span(1e-4, 0.2, log=True), "tau2": Span(1e-4, 5.0, log=True, maybe=True), "demean_week": (True, False)},
    "boosted_demand": {"trees": Span(10, 100, step=10), "depth": Span(2, 7, step=1), "rate": Span(0.01, 0.3, log=True), "delta": Span(0.01, 0.25, log=True)},
    "double_ml": {"k": Span(2, 5, step=1)},
    "r_learner": {"k": Span(2, 5, step=1), "share": Span(0.0, 0.5)},
}


def sampled(model: str, trials: int, seed: int = 0) -> list[dict]:
    """Settings number 0 to ``trials`` - 1 of a model's space."""
    out = []
    for trial in range(trials):
        rng = np.random.default_rng([seed, trial])
        out.append({name: of.draw(rng) if isinstance(of, Span) else of[int(rng.integers(len(of)))] for name, of in SPACES[model].items()})
    return out


def lowest(model: str) -> dict:
    """The low corner of a model's space: the first choice, the least number."""
    return {name: (of.low if of.step is None else int(of.low)) if isinstance(of, Span) else of[0] for name, of in SPACES[model].items()}


# ---- models by one interface -------------------------------------------------------------------

Predict = Callable[[DataFrame], DataFrame]


def _fixed(fit: Linear) -> Predict:
    return lambda other: other.withColumns({"predicted": fit.index(), "elasticity": F.lit(fit.elasticity)})


def _pooled(train: DataFrame, use_controls: bool = True, ridge: float = 0.0) -> Predict:
    return _fixed(de.pooled(train, CONTROLS if use_controls else [], ridge))


def _poisson(train: DataFrame, use_controls: bool = True, alpha: float = 1e-8, max_iter: int = 50) -> Predict:
    return _fixed(de.poisson(train.na.drop(subset=[Y, T, *CONTROLS]), CONTROLS if use_controls else [], alpha, max_iter))


def _twoway(train: DataFrame, add_controls: bool = True, collinear_tol: float = 0.02) -> Predict:
    fit = ef.two_way(train, CONTROLS if add_controls else [], collinear_tol)
    return lambda other: fit.predict(other).withColumn("elasticity", F.lit(fit.elasticity))


def _shrunk(train: DataFrame, min_obs: int = 12, min_price_sd: float = 0.02, tau2: float | None = None, demean_week: bool = True) -> Predict:
    """Log quantity: the product's level in training (that of all rows where it has none) and its slope times log price less the product's mean
    among the rows predicted."""
    levels = train.groupBy("stock_code").agg(F.avg(Y).alias("__level"))
    slopes = mo.shrunk_per_product(train, min_obs, min_price_sd, tau2, demean_week).select("stock_code", "elasticity", "raw", "se")
    level = train.agg(F.avg(Y)).first()[0]
    held = slopes.filter("raw is not null").agg(F.sum(F.col("raw") / (F.col("se") * F.col("se"))).alias("a"), F.sum(1 / (F.col("se") * F.col("se"))).alias("b")).first()
    middle = held.a / held.b if held.b else 0.0

    def predict(other: DataFrame) -> DataFrame:
        mean = other.groupBy("stock_code").agg(F.avg(T).alias("__mean"))
        known = mean.join(levels, "stock_code", "left").join(slopes.select("stock_code", "elasticity"), "stock_code", "left")
        out = other.join(known, "stock_code").withColumn("elasticity", F.coalesce("elasticity", F.lit(middle)))
        return out.withColumn("predicted", F.coalesce("__level", F.lit(level)) - F.col("elasticity") * (F.col(T) - F.col("__mean"))).drop("__level", "__mean")

    return predict


def _boosted(train: DataFrame, delta: float = 0.05, **options) -> Predict:
    clean = train.na.drop(subset=[Y, T, *CONTROLS, *de.PRICE_FEATURES])
    return lambda other: de.boosted_elasticity(other, delta, taught=clean, **options)


def _nuisances(m: np.ndarray, controls: list[str]) -> tuple[Linear, Linear]:
    """Linear predictions of log quantity and of log price by controls, from moments over (1, controls, T, Y, ...)."""
    p = len(controls)
    y, t = (de.solved(m, list(range(1, p + 1)), at) for at in (p + 2, p + 1))
    return tuple(Linear(float(b[0]), dict(zip(controls, b[1:].tolist(), strict=True))) for b in (y, t))


def _orthogonal(train: DataFrame, slope: Callable[[DataFrame, DataFrame], DataFrame], k: int) -> Predict:
    y, t = _nuisances(de.moments(train, [*CONTROLS, T, Y])[0], CONTROLS)
    residuals = de.crossfit_residuals(train, k)
    return lambda other: slope(residuals, other).withColumn("predicted", y.index() - F.col("elasticity") * (F.col(T) - t.index()))


def _double_ml(train: DataFrame, k: int = 5) -> Predict:
    found = de.theta(de.crossfit_residuals(train, k)).first().theta
    return _orthogonal(train, lambda _, other: other.withColumn("elasticity", F.lit(None if found is None else -found).cast("double")), k)


def _r_learner(train: DataFrame, k: int = 5, share: float = 0.05) -> Predict:
    return _orthogonal(train, lambda residuals, other: de.r_learner(residuals, share=share, onto=other), k)


#: A model: fitted on a frame with its settings, it adds ``predicted`` (log quantity) and ``elasticity`` to any other.
MODELS: dict[str, Callable[..., Predict]] = {
    "pooled_loglog": _pooled, "twoway_fe": _twoway, "poisson_glm": _poisson, "boosted_demand": _boosted, "double_ml": _double_ml, "r_learner": _r_learner, "shrunk_per_product": _shrunk,
}


def fitted(model: str, train: DataFrame, **settings) -> Predict:
    """A model of the registry by name."""
    if model not in MODELS:
        raise KeyError(f"unknown model {model!r}; there are {sorted(MODELS)}")
    return MODELS[model](train, **settings)


# ---- folds -------------------------------------------------------------------------------------


def spans(weeks: int, splits: int = 5, horizon: int = 8, min_train: int = 26, gap: int = 0) -> list[tuple[int, int, int]]:
    """``rolling_origin_folds`` as numbers: (train_end, valid_start, valid_end)."""
    low = min_train + gap
    starts = sorted({math.floor(low + (weeks - horizon - low) * k / max(splits - 1, 1)) for k in range(splits)})
    return [(s - gap, s, min(s + horizon, weeks - 1)) for s in starts if s - gap > 0 and min(s + horizon, weeks - 1) > s]


@dataclass(frozen=True)
class Folds:
    """Bounds as weeks, and each fold as three places among them."""

    cuts: list
    at: list[tuple[int, int, int]]

    @classmethod
    def of(cls, weeks: list, wanted: list[tuple[int, int, int]]) -> Folds:
        numbers = sorted({n for f in wanted for n in f})
        if not numbers:
            raise ValueError("too few weeks for a fold")
        return cls([weeks[n] for n in numbers], [tuple(numbers.index(n) for n in f) for f in wanted])

    def segment(self) -> Column:
        """How many bounds are at or before a row's week."""
        return reduce(lambda a, b: a + b, [(F.col("week") >= F.lit(c)).cast("int") for c in self.cuts])

    def train(self, k: int) -> range:
        return range(self.at[k][0] + 1)

    def valid(self, k: int) -> range:
        return range(self.at[k][1] + 1, self.at[k][2] + 1)

    def __len__(self) -> int:
        return len(self.at)


def calendar(df: DataFrame) -> list:
    """The weeks of a frame in order: a calendar, one row a week."""
    return sorted(r.week for r in df.select("week").filter("week is not null").distinct().collect())


# ---- scores ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scorer:
    """Moments of a frame by segment, and what every setting is graded against on each fold."""

    df: DataFrame
    folds: Folds
    controls: list[str]
    truth: str | None
    by_segment: dict[int, np.ndarray]

    @classmethod
    def of(cls, df: DataFrame, folds: Folds, controls: list[str] | None = None, truth: str | None = None) -> Scorer:
        ship_library(df.sparkSession)
        controls = CONTROLS if controls is None else controls
        return cls(df, folds, controls, truth, de.moments(df, [*controls, T, Y, *([truth] if truth else [])], folds.segment()))

    def sums(self, segments: range) -> np.ndarray:
        size = len(self.controls) + 3 + bool(self.truth)
        return sum((self.by_segment[s] for s in segments if s in self.by_segment), np.zeros((size, size)))

    def sides(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.sums(self.folds.train(k)), self.sums(self.folds.valid(k))

    def graded(self, k: int, sse: float, eps: float, eps2: float, loss: float, off: float | None) -> dict[str, float]:
        """Metrics of a fold: squared error, sums of the elasticity and its square, of the orthogonal loss and of the squared distance from the truth."""
        m, (ry, rt) = self.sides(k)[1], self.residuals(k)
        n, yy, tt, ty = m[0, 0], ry @ m @ ry, rt @ m @ rt, rt @ m @ ry
        constant, mean = (yy - ty * ty / max(tt, 1e-12 * n)) / n, eps / n
        out = {"rmse": math.sqrt(max(sse, 0.0) / n), "rloss": loss / n, "rloss_skill": 1 - loss / n / max(yy / n, 1e-12), "rloss_vs_constant": 1 - loss / n / max(constant, 1e-12),
               "avg_eps": mean, "eps_sd": math.sqrt(max(eps2 / n - mean * mean, 0.0))}
        if off is not None:
            out |= {"oracle": math.sqrt(max(off, 0.0) / n), "oracle_bias": mean - m[0, -1] / n}
        return out

    def residuals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients, over the moments' columns, of log quantity and log price less their prediction by the controls in training."""
        train, p = self.sides(k)[0], len(self.controls)
        out = []
        for at, fit in zip((p + 2, p + 1), _nuisances(train, self.controls), strict=True):
            v = np.zeros(len(train))
            v[at], v[0], v[1 : p + 1] = 1.0, -fit.constant, [-fit.coefficients[c] for c in self.controls]
            out.append(v)
        return tuple(out)

    def sound(self, k: int) -> bool:
        return all(m[0, 0] > 0 for m in self.sides(k))


Scores = list[list[dict[str, float] | None]]


def _finite(row: dict[str, float]) -> dict[str, float] | None:
    return {m: float(v) for m, v in row.items()} if all(math.isfinite(v) for v in row.values()) else None


def pooled_scores(scorer: Scorer, settings: list[dict]) -> Scores:
    """Metrics by setting and fold of ``pooled_loglog`` from the moments alone; None where it can't be fitted."""

    def one(k: int, use_controls: bool = True, ridge: float = 0.0) -> dict[str, float] | None:
        if not scorer.sound(k):
            return None
        (train, valid), p = scorer.sides(k), len(scorer.controls)
        x = [p + 1, *(range(1, p + 1) if use_controls else [])]
        try:
            beta = de.solved(train, x, p + 2, ridge)
        except np.linalg.LinAlgError:
            return None
        error = np.zeros(len(train))
        error[p + 2], error[[0, *x]] = 1.0, -beta
        n, eps, (ry, rt) = valid[0, 0], float(-beta[1]), scorer.residuals(k)
        left = ry + eps * rt
        off = float(n * eps * eps - 2 * eps * valid[0, -1] + valid[-1, -1]) if scorer.truth else None
        return _finite(scorer.graded(k, float(error @ valid @ error), n * eps, n * eps * eps, float(left @ valid @ left), off))

    return [[one(k, **s) for k in range(len(scorer.folds))] for s in settings]


#: Sums of a product on the training side (plain, then less the week's mean) and on the validation side of a fold.
_TRAIN = ["n", *[f"{d}{s}" for d in ("", "d") for s in ("y", "t", "yy", "tt", "ty")]]
_VALID = ["vn", "vy", "vt", "vyy", "vtt", "vty", "rr", "rs", "ss", "u", "uu"]


def product_sums(scorer: Scorer) -> tuple[DataFrame, str]:
    """A row a fold and product with the sums that shrunk slopes are fitted on and graded by, written, as it is read twice; and where it lies."""
    folds, controls = scorer.folds, scorer.controls
    spark, truth = scorer.df.sparkSession, F.col(scorer.truth) if scorer.truth else F.lit(0.0)
    rows = scorer.df.select("stock_code", "week", F.col(Y).cast("double").alias("y"), F.col(T).cast("double").alias("t"), truth.cast("double").alias("u"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(controls)]).na.drop(subset=["y", "t", "u", *[f"x{i}" for i in range(len(controls))]])
    placed, rows_at = written_step(rows.withColumn("segment", folds.segment()).select("stock_code", "week", "segment", "y", "t", "u", F.array(F.lit(1.0), *[F.col(f"x{i}") for i in range(len(controls))]).alias("x")), "placed")
    means = placed.groupBy("week").agg(F.avg("y").alias("my"), F.avg("t").alias("mt"))
    less = placed.join(means, placed.week.eqNullSafe(means.week)).withColumns({"dy": F.col("y") - F.col("my"), "dt": F.col("t") - F.col("mt")})
    first = less.groupBy("stock_code", "segment").agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(d + s) for d in ("", "d") for s, c in (("y", F.col(d + "y")), ("t", F.col(d + "t")), ("yy", F.col(d + "y") * F.col(d + "y")), ("tt", F.col(d + "t") * F.col(d + "t")), ("ty", F.col(d + "t") * F.col(d + "y")))])
    taught = spark.createDataFrame([(s, k) for k in range(len(folds)) for s in folds.train(k)], "segment int, fold int")
    train = first.join(taught, "segment").groupBy("fold", "stock_code").agg(*[F.sum(c).alias(c) for c in _TRAIN])
    p = len(controls)
    graded = [(s, k, *[[float(-c) for c in v[: p + 1]] for v in scorer.residuals(k)]) for k in range(len(folds)) if scorer.sound(k) for s in folds.valid(k)]
    coefficients = spark.createDataFrame(graded, "segment int, fold int, by array<double>, bt array<double>")

    def rest(column: str, beta: str) -> Column:
        return F.col(column) - F.aggregate(F.zip_with("x", beta, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    left = placed.join(coefficients, "segment").withColumns({"r": rest("y", "by"), "s": rest("t", "bt")})
    terms = [F.lit(1.0), F.col("y"), F.col("t"), *[F.col(a) * F.col(b) for a, b in ("yy", "tt", "ty", "rr", "rs", "ss")], F.col("u"), F.col("u") * F.col("u")]
    valid = left.groupBy("fold", "stock_code").agg(*[F.sum(e).alias(c) for c, e in zip(_VALID, terms, strict=True)])
    both = train.unionByName(valid, allowMissingColumns=True).groupBy("fold", "stock_code").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in [*_TRAIN, *_VALID]])
    out = written_step(both.drop("stock_code"), "products")
    dropped_step(spark, rows_at)
    return out


def _slopes(g: dict[str, np.ndarray], s: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a product has a slope of its own under a setting, the slope, and its squared error."""
    d, n = "d" if s.get("demean_week", True) else "", np.maximum(g["n"], 1)
    yy, tt, ty = (g[d + a] - g[d + b] * g[d + c] / n for a, b, c in (("yy", "y", "y"), ("tt", "t", "t"), ("ty", "t", "y")))
    sound = (g["n"] >= s.get("min_obs", 12)) & (np.sqrt(np.maximum(tt, 0) / n) >= s.get("min_price_sd", 0.02)) & (tt > 1e-10)
    safe = np.where(sound, tt, 1.0)
    b = ty / safe
    return sound, b, np.maximum((yy - b * ty) / np.maximum(n - 2, 1) / safe, 1e-12)


def _task_sums(stats: DataFrame, settings: list[dict], width: int, terms: Callable[[dict[str, np.ndarray], int, int, dict], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Sums by fold and setting of ``width`` terms a product: folds x settings x width numbers reach the driver."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            g = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
            for k in np.unique(g["fold"]).tolist():
                part = {c: v[g["fold"] == k] for c, v in g.items()}
                sums[k] = sums.get(k, 0) + np.array([terms(part, k, j, s) for j, s in enumerate(settings)])
        for k, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, k, np.int32)), pa.array(np.arange(m.size)), pa.array(m.ravel())], names=["fold", "slot", "value"])

    out: dict[tuple[int, int], np.ndarray] = {}
    for r in stats.mapInArrow(add, "fold int, slot long, value double").groupBy("fold", "slot").agg(F.sum("value").alias("value")).collect():
        out.setdefault((r.fold, r.slot // width), np.zeros(width))[r.slot % width] = r.value
    return out


def shrunk_scores(scorer: Scorer, settings: list[dict], stats: DataFrame | None = None) -> Scores:
    """Metrics by setting and fold of ``shrunk_per_product``: two passes over products for all settings and folds."""
    if stats is None:
        stats, place = product_sums(scorer)
        out = shrunk_scores(scorer, settings, stats)
        dropped_step(scorer.df.sparkSession, place)
        return out

    def spread(g: dict[str, np.ndarray], k: int, j: int, s: dict) -> np.ndarray:
        sound, b, v = (a for a in _slopes(g, s))
        b, v = b[sound], v[sound]
        return np.array([len(b), (b / v).sum(), (1 / v).sum(), b.sum(), (b * b).sum(), v.sum()])

    prior: dict[tuple[int, int], tuple[float, float]] = {}
    for at, (n, bv, iv, b1, b2, v1) in _task_sums(stats, settings, 6, spread).items():
        tau2 = settings[at[1]].get("tau2")
        if tau2 is None:  # null variance of one slope: no spread to speak of
            tau2 = max((b2 - b1 * b1 / n) / (n - 1) - v1 / n, 1e-6) if n > 1 else 1e-6
        prior[at] = (bv / iv if n else 0.0, tau2)
    level = {k: scorer.sides(k)[0][0, len(scorer.controls) + 2] / scorer.sides(k)[0][0, 0] for k in range(len(scorer.folds)) if scorer.sound(k)}

    def grade(g: dict[str, np.ndarray], k: int, j: int, s: dict) -> np.ndarray:
        if k not in level:
            return np.zeros(6)
        (mu, tau2), (sound, b, v) = prior[(k, j)], _slopes(g, s)
        w = tau2 / (tau2 + v)
        slope = np.where(sound, w * b + (1 - w) * mu, mu)
        n, m = g["vn"], np.maximum(g["vn"], 1)
        base = np.where(g["n"] > 0, g["y"] / np.maximum(g["n"], 1), level[k])
        yy, tt, ty = (g["v" + a] - g["v" + c] * g["v" + d] / m for a, c, d in (("yy", "y", "y"), ("tt", "t", "t"), ("ty", "t", "y")))
        sse = yy + n * (g["vy"] / m - base) ** 2 - 2 * slope * ty + slope * slope * tt
        return np.array([n.sum(), sse.sum(), -(n * slope).sum(), (n * slope * slope).sum(), (g["rr"] - 2 * slope * g["rs"] + slope * slope * g["ss"]).sum(), (n * slope * slope + 2 * slope * g["u"] + g["uu"]).sum()])

    found = _task_sums(stats, settings, 6, grade)

    def one(k: int, j: int) -> dict[str, float] | None:
        if not scorer.sound(k) or (k, j) not in found:
            return None
        _, sse, eps, eps2, loss, off = found[(k, j)].tolist()
        return _finite(scorer.graded(k, sse, eps, eps2, loss, off if scorer.truth else None))

    return [[one(k, j) for k in range(len(scorer.folds))] for j in range(len(settings))]


def fit_score(scorer: Scorer, model: str, settings: dict, k: int) -> dict[str, float] | None:
    """Metrics of one fold by fitting on its training side; None where the model can't be fitted or predicts no finite number for a row."""
    if not scorer.sound(k):
        return None
    p, wanted = len(scorer.controls), [*scorer.controls, T, Y, *([scorer.truth] if scorer.truth else [])]
    placed = scorer.df.na.drop(subset=wanted).withColumn("__segment", scorer.folds.segment())
    train = placed.filter(F.col("__segment") < scorer.folds.train(k).stop).drop("__segment")
    side = scorer.folds.valid(k)
    valid = placed.filter((F.col("__segment") >= side.start) & (F.col("__segment") < side.stop)).drop("__segment")
    ry, rt = (F.col(c) - Linear(float(-v[0]), dict(zip(scorer.controls, (-v[1 : p + 1]).tolist(), strict=True))).index() for c, v in zip((Y, T), scorer.residuals(k), strict=True))
    try:
        scored = fitted(model, train, **settings)(valid)
    except (ValueError, ArithmeticError, np.linalg.LinAlgError):
        return None
    e = F.col("elasticity")
    left, error, off = ry + e * rt, F.col("predicted") - F.col(Y), (e - F.col(scorer.truth)) if scorer.truth else F.lit(0.0)
    s = scored.agg(F.count(F.col("predicted") + e).alias("n"), F.sum(error * error).alias("sse"), F.sum(e).alias("e"), F.sum(e * e).alias("ee"), F.sum(left * left).alias("loss"), F.sum(off * off).alias("off")).first()
    if s.n != scorer.sides(k)[1][0, 0]:
        return None
    return _finite(scorer.graded(k, s.sse, s.e, s.ee, s.loss, s.off if scorer.truth else None))


# ---- the search --------------------------------------------------------------------------------


@dataclass
class MedianRule:
    """A trial ends when its best running value so far is above the median, at the same fold, of the trials that ran to their end."""

    startup: int = 8
    warmup: int = 1
    ended: list[list[float]] = field(default_factory=list)

    def stops(self, values: list[float]) -> bool:
        step = len(values) - 1
        if len(self.ended) < self.startup or step < self.warmup:
            return False
        return min(values) > float(np.median([v[step] for v in self.ended]))


def _mean(rows: list[dict[str, float]]) -> dict[str, float]:
    return {m: float(np.mean([r[m] for r in rows])) for m in rows[0]}


def searched(settings: list[dict], folds: int, score: Callable[[int, int], dict[str, float] | None], objective: str = "rloss", rule: MedianRule | None = None) -> list[dict]:
    """The trials in order, each fold by fold through ``score(trial, fold)`` until it ends, fails or is pruned: state, folds seen, mean metrics and the value to be least."""
    sign, out = -1.0 if objective in MAXIMISED else 1.0, []
    for j, s in enumerate(settings):
        seen, values, state = [], [], "complete"
        for k in range(folds):
            row = score(j, k)
            if row is None:
                state = "failed"
                break
            seen.append(row)
            values.append(sign * _mean(seen)[objective])
            if rule is not None and rule.stops(values):
                state = "pruned"
                break
        if state == "complete" and rule is not None:
            rule.ended.append(values)
        failed = state == "failed"
        out.append({"trial": j, "settings": s, "state": state, "n_folds": len(seen), "objective": objective, "value": math.inf if failed else values[-1], **({} if failed else _mean(seen))})
    return out


CLOSED = {"pooled_loglog": pooled_scores, "shrunk_per_product": shrunk_scores}


def tune(scorer: Scorer, model: str, trials: int = 40, objective: str = "rloss", seed: int = 0, pruning: bool = True, rule: MedianRule | None = None) -> list[dict]:
    """A seeded search of a model's space. Closed forms score all settings at once (the rule then only labels them); others fit a fold at a time."""
    settings = sampled(model, trials, seed)
    rule = (rule or MedianRule()) if pruning else None
    if model in CLOSED:
        rows = CLOSED[model](scorer, settings)
        return searched(settings, len(scorer.folds), lambda j, k: rows[j][k], objective, rule)
    return searched(settings, len(scorer.folds), lambda j, k: fit_score(scorer, model, settings[j], k), objective, rule)


def history(spark: SparkSession, model: str, found: list[dict]) -> DataFrame:
    """Trials as a table: model, trial, settings (json), state, n_folds, objective, value (to be least) and the metrics; null where there are none."""
    rows = [(model, f["trial"], json.dumps(f["settings"], sort_keys=True), f["state"], f["n_folds"], f["objective"], f["value"], *[f.get(m) for m in METRICS]) for f in found]
    return spark.createDataFrame(rows, HISTORY)


def best(found: list[dict]) -> dict:
    """The trial of least value that ran to its end; ties to the earlier one."""
    ended = [f for f in found if f["state"] == "complete"]
    if not ended:
        raise ValueError("no trial ran to its end")
    return min(ended, key=lambda f: (f["value"], f["trial"]))


_GRADES = "model string, tuned_on string, settings string, n_complete int, n_pruned int, " + ", ".join(f"{m} double" for m in METRICS)


def objective_comparison(scorer: Scorer, model: str, objectives: Iterable[str] = ("rmse", "rloss"), trials: int = 40, seed: int = 0) -> DataFrame:
    """The winner under each objective with all its metrics, and, where the truth is known, the trial nearest to it: the bound no observable objective can pass."""
    rows, seen = [], []
    for o in objectives:
        found = tune(scorer, model, trials, o, seed)
        top, states = best(found), [f["state"] for f in found]
        seen += [f for f in found if f["state"] == "complete"]
        rows.append((model, o, json.dumps(top["settings"], sort_keys=True), states.count("complete"), states.count("pruned"), *[top.get(m) for m in METRICS]))
    if scorer.truth:
        top = min(seen, key=lambda f: (f["oracle"], f["trial"]))
        rows.append((model, "oracle", json.dumps(top["settings"], sort_keys=True), len(seen), 0, *[top[m] for m in METRICS]))
    return scorer.df.sparkSession.createDataFrame(rows, _GRADES)


_NESTED = "outer_fold int, model string, tuned_on string, settings string, inner_best double, " + ", ".join(f"outer_{m} double" for m in METRICS)


def nested(df: DataFrame, model: str, objective: str = "rloss", trials: int = 25, outer: int = 3, seed: int = 0, truth: str | None = None, controls: list[str] | None = None) -> DataFrame:
    """Tuning inside each outer fold, the winner graded on the outer block that its search never saw: a row an outer fold.

    Outer and inner folds share one set of segments, so the moments of all are one pass. Inner folds end where the outer training side does.
    """
    weeks = calendar(df)
    outside = spans(len(weeks), outer + 1)[-outer:]
    inside = [spans(end, 3, 6, max(12, end - 24)) for end, _, _ in outside]
    if not outside or not all(inside):
        raise ValueError("too few weeks for nested folds")
    plan = Folds.of(weeks, [*outside, *[f for part in inside for f in part]])
    whole, rows, at = Scorer.of(df, plan, controls, truth), [], len(outside)
    stats, place = product_sums(whole) if model == "shrunk_per_product" else (None, None)
    for i, part in enumerate(inside):
        settings, first = sampled(model, trials, seed + i), at
        if model in CLOSED:
            table = shrunk_scores(whole, settings, stats) if stats is not None else pooled_scores(whole, settings)
            score = lambda j, k, table=table: table[j][k]
        else:
            score = lambda j, k, settings=settings: fit_score(whole, model, settings[j], k)
        top = best(searched(settings, len(part), lambda j, k, score=score, first=first: score(j, first + k), objective, MedianRule()))
        grades = score(top["trial"], i) or {}
        rows.append((i, model, objective, json.dumps(top["settings"], sort_keys=True), top[objective], *[grades.get(m) for m in METRICS]))
        at += len(part)
    if place:
        dropped_step(df.sparkSession, place)
    return df.sparkSession.createDataFrame(rows, _NESTED)
