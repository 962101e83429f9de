"""Demand models with controls: least squares from cross moments, Poisson and boosted trees by Spark ML, orthogonal scores (linear or boosted).

Linear fits need one pass that sums cross moments in every task; a moment matrix has as many rows as columns and reaches the
driver. Cross-fitting sums moments by fold in the same pass: leaving a fold out is a subtraction.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.operators.boosting import boost, squared_by_fold
from tercet.operators.features import CONTROLS, DISCOUNT, PRICE_FEATURES
from tercet.operators.ordering import quantiles
from tercet.operators.resampling import fold_of

Y, T = "log_qty", "log_price"


def perturbed(df: DataFrame, delta: float, discount: float = DISCOUNT) -> DataFrame:
    """Log price and all features made of it, moved together."""
    moved = df.withColumns({c: F.col(c) + delta for c in (T, "rel_price", "price_change")})
    return moved.withColumn("is_discounted", (F.col("rel_price") < discount).cast("double"))


def moments(df: DataFrame, columns: list[str], fold: Column | None = None) -> dict[int, np.ndarray]:
    """Sums of products of (1, columns) by fold: one pass, one matrix a task and fold. Rows with a null are left out."""
    held = df.select((F.lit(0) if fold is None else fold).cast("int").alias("__fold"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    size = len(columns) + 1

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]])
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(folds).tolist():
                part = x[folds == k]
                sums[k] = sums.get(k, 0) + part.T @ part
        for k, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, k, np.int32)), pa.array(np.arange(m.size)), pa.array(m.ravel())], names=["fold", "slot", "value"])

    out: dict[int, np.ndarray] = {}
    for r in held.mapInArrow(add, "fold int, slot long, value double").groupBy("fold", "slot").agg(F.sum("value").alias("value")).collect():  # folds x (columns + 1)^2
        out.setdefault(r.fold, np.zeros((size, size)))[r.slot // size, r.slot % size] = r.value
    return out


def solved(m: np.ndarray, x: list[int], y: int, ridge: float = 0.0) -> np.ndarray:
    """Coefficients (constant first) of column ``y`` on columns ``x`` of a moment matrix. The ridge penalises the constant too, on
    the scale of means. Columns are centred and scaled first; without a ridge, collinear ones share by least norm."""
    n = m[0, 0]
    if ridge:
        at = [0, *x]
        return np.linalg.solve(m[np.ix_(at, at)] / n + ridge * np.eye(len(at)), m[at, y] / n)
    mean = m[0] / n
    cov = m / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[x], 0))
    sd[sd <= 1e-12 * (1 + np.abs(mean[x]))] = np.inf
    slope = np.linalg.pinv(cov[np.ix_(x, x)] / np.outer(sd, sd), rcond=1e-10, hermitian=True) @ (cov[x, y] / sd) / sd
    return np.concatenate(([mean[y] - mean[x] @ slope], slope))


@dataclass(frozen=True)
class Linear:
    """A fitted linear index: constant and coefficients by column."""

    constant: float
    coefficients: dict[str, float]

    def index(self) -> Column:
        return reduce(lambda a, b: a + b, [F.col(c) * F.lit(v) for c, v in self.coefficients.items()], F.lit(self.constant))

    @property
    def elasticity(self) -> float:
        return -self.coefficients[T]


def pooled(df: DataFrame, controls: list[str] = CONTROLS, ridge: float = 0.0) -> Linear:
    """Least squares of log quantity on log price and controls."""
    x = [T, *controls]
    beta = solved(moments(df, [*x, Y])[0], list(range(1, len(x) + 1)), len(x) + 1, ridge)
    return Linear(float(beta[0]), dict(zip(x, beta[1:].tolist(), strict=True)))


def poisson(df: DataFrame, controls: list[str] = CONTROLS, alpha: float = 1e-8, max_iter: int = 50) -> Linear:
    """Log-link Poisson regression of the quantity on standardised columns, by Spark ML; coefficients on the original scale."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    x = [T, *controls]
    scale = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    mean, sd = [scale[f"m{i}"] for i in range(len(x))], [scale[f"s{i}"] or 0.0 for i in range(len(x))]
    used = [i for i in range(len(x)) if sd[i] > 1e-12]
    z = df.select(F.exp(Y).alias("__y"), *[((F.col(x[i]) - mean[i]) / sd[i]).alias(f"__z{i}") for i in used])
    packed = VectorAssembler(inputCols=[f"__z{i}" for i in used], outputCol="__x").transform(z).select("__y", "__x")
    fit = GeneralizedLinearRegression(family="poisson", link="log", labelCol="__y", featuresCol="__x", regParam=alpha, maxIter=max_iter, tol=1e-8).fit(packed)
    slope = dict.fromkeys(x, 0.0)
    for i, b in zip(used, fit.coefficients.toArray().tolist(), strict=True):
        slope[x[i]] = b / sd[i]
    return Linear(float(fit.intercept) - sum(slope[c] * m for c, m in zip(x, mean, strict=True)), slope)


def boosted(df: DataFrame, label: str, columns: list[str], weight: str | None = None, trees: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 0):
    """Gradient-boosted trees by Spark ML: a function that adds their prediction as a column."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    pack = VectorAssembler(inputCols=columns, outputCol="__x")
    learner = GBTRegressor(labelCol=label, featuresCol="__x", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    fit = (learner.setWeightCol(weight) if weight else learner).fit(pack.transform(df))

    def predict(other: DataFrame, name: str) -> DataFrame:
        return fit.setPredictionCol(name).transform(pack.transform(other)).drop("__x")

    return predict


def boosted_elasticity(df: DataFrame, delta: float = 0.05, taught: DataFrame | None = None, **options) -> DataFrame:
    """One boosted surface of log quantity on controls and price, fitted on ``taught`` (``df`` itself by default): ``df`` with ``predicted`` and
    ``elasticity`` by differencing."""
    predict = boosted(df if taught is None else taught, Y, [*CONTROLS, *PRICE_FEATURES], **options)
    kept = df.withColumns({f"__keep_{c}": F.col(c) for c in (T, *PRICE_FEATURES)})

    def back(moved: DataFrame) -> DataFrame:
        return moved.withColumns({c: F.col(f"__keep_{c}") for c in (T, *PRICE_FEATURES)})

    out = predict(kept, "predicted")
    for name, step in (("__up", delta), ("__down", -delta)):
        out = back(predict(perturbed(out, step), name))
    return out.withColumn("elasticity", -(F.col("__up") - F.col("__down")) / (2 * delta)).drop("__up", "__down", *[f"__keep_{c}" for c in (T, *PRICE_FEATURES)])


def crossfit_residuals(df: DataFrame, k: int = 5, seed: str = "0", controls: list[str] = CONTROLS, group: str = "stock_code") -> DataFrame:
    """``df`` with ``ry`` and ``rt``: log quantity and log price less their linear prediction by controls, fitted without the row's fold.

    Folds hold whole products, by a hash. One pass sums the moments of all folds.
    """
    fold = fold_of(F.col(group), k, seed)
    by_fold = moments(df, [*controls, Y, T], fold)
    total, p = sum(by_fold.values()), len(controls)
    held = df.withColumn("__fold", fold)

    def left(target: int) -> Column:
        out = F.lit(None).cast("double")
        for f, m in by_fold.items():
            beta = solved(total - m if len(by_fold) > 1 else total, list(range(1, p + 1)), target)
            out = F.when(F.col("__fold") == f, Linear(float(beta[0]), dict(zip(controls, beta[1:].tolist(), strict=True))).index()).otherwise(out)
        return out

    return held.withColumns({"ry": F.col(Y) - left(p + 1), "rt": F.col(T) - left(p + 2)}).drop("__fold")


def boosted_residuals(df: DataFrame, k: int = 5, seed: str = "0", controls: list[str] = CONTROLS, group: str = "stock_code", **options) -> DataFrame:
    """``crossfit_residuals`` with boosted trees for both predictions: all folds and both targets grow in the same passes.

    Rows without a quantity or price do not teach and have null residuals.
    """
    held = df.withColumn("__fold", fold_of(F.col(group), k, seed).cast("int"))
    s = {r["__fold"]: r for r in held.groupBy("__fold").agg(*[f(c).alias(n + c) for c in (Y, T) for n, f in (("n", F.count), ("s", F.sum))]).collect()}  # a row a fold

    def start(f: int, c: str) -> float:
        rest = [r for g, r in s.items() if g != f or len(s) < 2]
        return sum(r["s" + c] or 0.0 for r in rest) / max(sum(r["n" + c] for r in rest), 1)

    folds = k if len(s) > 1 else 1
    fit = boost(held, controls, squared_by_fold(2, folds), [F.col(Y), F.col(T), F.col("__fold")], [start(f, c) for f in range(folds) for c in (Y, T)], key=F.concat_ws("|", group, "week"), **options)
    at = F.col("__fold") * 2 if folds > 1 else F.lit(0)
    return held.withColumn("__m", fit.predict()).withColumns({"ry": F.col(Y) - F.col("__m")[at], "rt": F.col(T) - F.col("__m")[at + 1]}).drop("__m", "__fold")


def theta(residuals: DataFrame, by: list[str] | None = None, extra: list[Column] | None = None) -> DataFrame:
    """Orthogonal slope of ``ry`` on ``rt`` with its robust error, from sums up to the fourth order; null below five rows or without variation."""
    y, t = F.col("ry"), F.col("rt")
    sums = [F.count("*").alias("n"), F.sum(t * t).alias("tt"), F.sum(t * y).alias("ty"), F.sum(t * t * y * y).alias("ttyy"), F.sum(t * t * t * y).alias("ttty"), F.sum(t * t * t * t).alias("tttt"), *(extra or [])]
    s = residuals.groupBy(*by).agg(*sums) if by else residuals.agg(*sums)
    slope, sound = F.col("ty") / F.col("tt"), (F.col("n") >= 5) & (F.col("tt") > 1e-12)
    rest = F.greatest(F.col("ttyy") - 2 * slope * F.col("ttty") + slope * slope * F.col("tttt"), F.lit(0.0))
    return s.withColumns({"theta": F.when(sound, slope), "se": F.when(sound, F.sqrt(rest) / F.col("tt"))}).drop("tt", "ty", "ttyy", "ttty", "tttt")


def double_ml(df: DataFrame, k: int = 5, seed: str = "0") -> DataFrame:
    """Constant elasticity by partialling out: n, elasticity, se."""
    return theta(crossfit_residuals(df, k, seed)).select("n", (-F.col("theta")).alias("elasticity"), "se")


def r_learner(residuals: DataFrame, columns: list[str] = CONTROLS, share: float = 0.05, trees: bool = False, onto: DataFrame | None = None, **options) -> DataFrame:
    """``residuals`` (ry, rt), or ``onto``, with ``elasticity`` by ``columns``: the weighted regression of ry/rt with weights rt squared.

    Rows of the ``share`` of least weight do not teach. Linear by default, in moments of rt times the columns; boosted trees on request.
    """
    weighted = residuals.withColumn("__w", F.col("rt") * F.col("rt"))
    floor = quantiles(weighted, "__w", [share]).select(F.greatest(F.col("q")[0], F.lit(1e-12)).alias("__floor"))
    taught = weighted.crossJoin(F.broadcast(floor)).filter(F.col("__w") > F.col("__floor"))
    if trees:
        predict = boosted(taught.withColumn("__label", F.col("ry") / F.col("rt")), "__label", columns, weight="__w", **options)
        return predict(residuals if onto is None else onto, "__theta").withColumn("elasticity", -F.col("__theta")).drop("__theta")
    scaled = taught.select("ry", "rt", *[(F.col(c) * F.col("rt")).alias(f"__x{i}") for i, c in enumerate(columns)])
    m = moments(scaled, ["rt", *[f"__x{i}" for i in range(len(columns))], "ry"])[0][1:, 1:]
    sd = np.sqrt(np.maximum(np.diag(m)[:-1], 1e-300))
    beta = np.linalg.pinv(m[:-1, :-1] / np.outer(sd, sd), rcond=1e-10, hermitian=True) @ (m[:-1, -1] / sd) / sd
    fit = Linear(float(beta[0]), dict(zip(columns, beta[1:].tolist(), strict=True)))
    return (residuals if onto is None else onto).withColumn("elasticity", -fit.index())


def _binned(scored: DataFrame, eps: str, groups: int) -> DataFrame:
    """``group`` from 1 by interior quantiles of the predicted elasticity; one group where it is constant."""
    edges = quantiles(scored, eps, [k / groups for k in range(1, groups)])
    flat = scored.agg((F.coalesce(F.stddev_pop(eps), F.lit(0.0)) < 1e-12).alias("__flat"))
    above = F.aggregate("q", F.lit(0), lambda n, e: n + (F.col(eps) >= e).cast("int"))
    return scored.crossJoin(F.broadcast(edges)).crossJoin(F.broadcast(flat)).withColumn("group", F.when(F.col("__flat"), 1).otherwise(1 + above)).drop("q", "__flat")


def orthogonal_gates(scored: DataFrame, eps: str = "elasticity", groups: int = 5) -> DataFrame:
    """Elasticity of the data in bins of the predicted one: group, n, eps_predicted, eps_estimated, se, lo, hi."""
    s = theta(_binned(scored, eps, groups), ["group"], [F.avg(eps).alias("eps_predicted")])
    return s.select("group", "n", "eps_predicted", (-F.col("theta")).alias("eps_estimated"), "se", (-F.col("theta") - 1.96 * F.col("se")).alias("lo"), (-F.col("theta") + 1.96 * F.col("se")).alias("hi"))


def observational_value(scored: DataFrame, eps: str = "elasticity", delta: float = 0.05, groups: int = 5) -> DataFrame:
    """Log revenue of moving prices up where demand is predicted inelastic and down elsewhere, valued by each bin's own elasticity, against
    the best single move (none included)."""
    held = _binned(scored, eps, groups)
    bins = theta(held, ["group"], [F.sum((F.col(eps) < 1).cast("long")).alias("up")])
    mean = bins.agg(F.avg(-F.col("theta")).alias("__mean"), F.sum("n").alias("__n"))
    gain = 1 - F.coalesce(-F.col("theta"), F.col("__mean"))
    s = bins.crossJoin(F.broadcast(mean)).agg((delta * F.sum((2 * F.col("up") - F.col("n")) * gain) / F.first("__n")).alias("value_model"), (delta * F.sum(F.col("n") * gain) / F.first("__n")).alias("value_uniform_up"), (F.sum("up") / F.first("__n")).alias("share_priced_up"))
    best = F.greatest(F.abs("value_uniform_up"), F.lit(0.0))
    return s.select("value_model", "value_uniform_up", (-F.col("value_uniform_up")).alias("value_uniform_down"), best.alias("value_best_uniform"), (F.col("value_model") - best).alias("lift_over_uniform"), "share_priced_up")


def r_loss(scored: DataFrame, eps: str = "elasticity") -> DataFrame:
    """Orthogonal loss of a predicted elasticity, of the best constant one, and the share of the latter that it saves."""
    y, t, e = F.col("ry"), F.col("rt"), F.col(eps)
    s = scored.agg(F.avg((y + e * t) * (y + e * t)).alias("r_loss"), F.avg(y * y).alias("yy"), F.avg(t * t).alias("tt"), F.avg(t * y).alias("ty"))
    return s.select("r_loss", (F.col("yy") - F.col("ty") * F.col("ty") / F.greatest(F.col("tt"), F.lit(1e-12))).alias("constant_loss")).withColumn("skill", 1 - F.col("r_loss") / F.col("constant_loss"))


def compared(scored: DataFrame, models: list[str]) -> DataFrame:
    """A row for each column of predicted elasticities, in one pass: model, n, mean, sd, r_loss, constant_loss, skill. Rows with a null in
    a model's column, ``ry`` or ``rt`` do not count for it."""
    long = scored.select("ry", "rt", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("eps")) for m in models])).alias("m")).select("ry", "rt", "m.*").na.drop()
    y, t, e = F.col("ry"), F.col("rt"), F.col("eps")
    s = long.groupBy("model").agg(F.count("*").alias("n"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("sd"), F.avg((y + e * t) * (y + e * t)).alias("r_loss"), F.avg(y * y).alias("yy"), F.avg(t * t).alias("tt"), F.avg(t * y).alias("ty"))
    constant = F.col("yy") - F.col("ty") * F.col("ty") / F.greatest(F.col("tt"), F.lit(1e-12))
    return s.select("model", "n", "mean", "sd", "r_loss", constant.alias("constant_loss"), (1 - F.col("r_loss") / constant).alias("skill"))
