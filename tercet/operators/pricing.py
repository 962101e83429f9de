"""Price-test posteriors, gauges, link functions and price optima as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.operators.ranking import FLOOR, P, prepared


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


# ---- what a price test implies ----------------------------------------------------------------


def buyer_prevalences(df: DataFrame, arm: str = "arm", bought: str = "bought") -> DataFrame:
    """Arm shares among buyers from the purchase rates and the observed allocation: arm, rate, prevalence."""
    rates = df.groupBy(arm).agg(F.count("*").alias("n"), F.sum(bought).alias("b"))
    every = rates.agg(F.sum("b").alias("__all"))
    return rates.crossJoin(F.broadcast(every)).select(arm, (F.col("b") / F.col("n")).alias("rate"), (F.col("b") / F.col("__all")).alias("prevalence"))


def purchase_rates(base: Column, elasticity: Column, multipliers: tuple[float, ...]) -> list[Column]:
    """Constant-elasticity demand at every price multiplier."""
    return [base * F.pow(F.lit(float(m)), -elasticity) for m in multipliers]


def monotone_demand(sample: DataFrame, p: list[str] = P) -> DataFrame:
    """Share of rows whose scores fall with price, violations and the worst one in logs; columns cheapest first."""
    logs = prepared(sample, p)
    ok = (F.col("d01") >= 0) & (F.col("d12") >= 0)
    return logs.agg(F.avg(ok.cast("double")).alias("fraction_satisfied"), F.sum((~ok).cast("long")).alias("n_violations"), F.min(F.least("d01", "d12")).alias("worst_violation_log"))


# ---- gauges ------------------------------------------------------------------------------------


def rescaled(p: list[Column], c: list[Column]) -> list[Column]:
    """Classes rescaled by ``c`` and rows renormalised; ranks between rows of a class stay."""
    raw = [a * b for a, b in zip(p, c, strict=True)]
    total = _sum(raw)
    return [r / total for r in raw]


def balanced(b: list[Column], allocation: list[float]) -> list[Column]:
    """An arm posterior as it would be under equal allocation."""
    return rescaled(b, [F.lit(1.0 / q) for q in allocation])


def prior_normalised(sample: DataFrame, p: list[str] = P) -> DataFrame:
    """Columns divided by the classes' shares among the labels, rows renormalised: row_id, y, q0, q1, q2."""
    shares = sample.agg(*[F.avg((F.col("y") == i).cast("double")).alias(f"__g{i}") for i in range(len(p))])
    q = rescaled([F.col(c) for c in p], [1 / F.col(f"__g{i}") for i in range(len(p))])
    return sample.crossJoin(F.broadcast(shares)).select("row_id", "y", *[c.alias(f"q{i}") for i, c in enumerate(q)])


def ordered_gauge(sample: DataFrame, margin: float = 1.0, p: list[str] = P) -> DataFrame:
    """Log scores shifted by constants so that every row rises over the classes: row_id, g0, g1, g2 (g2 is 0 before normalising rows)."""
    logs = prepared(sample, p)
    shift = logs.agg((F.max("d01") + margin).alias("__a"), (F.max("d12") + margin).alias("__c"))
    both = logs.crossJoin(F.broadcast(shift))
    a, c = F.col("d01") - F.col("__a"), F.col("d12") - F.col("__c")
    return both.select("row_id", (a + c).alias("g0"), c.alias("g1"), F.lit(0.0).alias("g2"))


def posterior_constraint(df: DataFrame, b: list[Column], allocation: list[float]) -> DataFrame:
    """Shares of rows with b/allocation falling over the arms, and with b itself falling."""
    s = [x / q for x, q in zip(b, allocation, strict=True)]

    def falls(v: list[Column]) -> Column:
        return reduce(lambda x, y: x & y, [after - before <= 1e-12 for before, after in zip(v[:-1], v[1:], strict=True)])

    return df.agg(F.avg(falls(s).cast("double")).alias("share_demand_monotone"), F.avg(falls(b).cast("double")).alias("share_posterior_monotone"))


def triangle_vertices(allocation: list[float]) -> list[tuple[str, int, list[float]]]:
    """Vertices of the ordered chamber, and of the admissible region that the allocation maps it to: (region, number, weights)."""
    k = len(allocation)
    chamber = [[1.0] + [0.0] * (k - 1), [0.5, 0.5] + [0.0] * (k - 2), [1.0 / k] * k]
    out = [("standard", i, v) for i, v in enumerate(chamber)]
    for i, v in enumerate(chamber):
        w = [a * b for a, b in zip(v, allocation, strict=True)]
        out.append(("admissible", i, [x / sum(w) for x in w]))
    return out


# ---- price levels ------------------------------------------------------------------------------


def isotonic_decreasing(v: list[Column], w: list[Column] | None = None) -> list[Column]:
    """Weighted least-squares projection of K values onto non-increasing order, as a max-min of interval means."""
    k, w = len(v), w or [F.lit(1.0)] * len(v)

    def mean(i: int, j: int) -> Column:
        weight = _sum(w[i : j + 1])
        return F.when(weight > 0, _sum([a * b for a, b in zip(v[i : j + 1], w[i : j + 1], strict=True)]) / weight).otherwise(v[i])

    out = []
    for at in range(k):
        best = []
        for i in range(at + 1):
            over = [mean(i, j) for j in range(at, k)]
            best.append(F.greatest(*over) if len(over) > 1 else over[0])
        out.append(F.least(*best) if len(best) > 1 else best[0])
    return out


def running_levels(v: list[Column], downward: bool = False) -> list[Column]:
    """Sums of the levels up to each one within a row, or from each one on if ``downward``."""
    v = v[::-1] if downward else v
    out = [_sum(v[: k + 1]) for k in range(len(v))]
    return out[::-1] if downward else out


def arc_elasticities(log_demand: list[Column], log_price: list[float]) -> list[Column]:
    """Elasticity between every two neighbouring levels."""
    return [-(log_demand[i + 1] - log_demand[i]) / (log_price[i + 1] - log_price[i]) for i in range(len(log_price) - 1)]


def level_elasticity(log_demand: list[Column], log_price: list[float], w: list[Column]) -> Column:
    """Minus the weighted slope of log demand on log price over the levels."""
    total = _sum(w)
    mean_r = _sum([x * r for x, r in zip(w, log_price, strict=True)]) / total
    mean_s = _sum([x * s for x, s in zip(w, log_demand, strict=True)]) / total
    top = _sum([x * (r - mean_r) * (s - mean_s) for x, r, s in zip(w, log_price, log_demand, strict=True)])
    below = _sum([x * (r - mean_r) * (r - mean_r) for x, r in zip(w, log_price, strict=True)])
    return -top / F.greatest(below, F.lit(1e-12))


# ---- conversion --------------------------------------------------------------------------------


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def kinked(eta: Column, slope: float = 0.45) -> Column:
    """Logistic link whose index is flatter below zero."""
    return sigmoid(F.when(eta > 0, eta).otherwise(slope * eta))


def mixed(df: DataFrame, eta: Column, by: str) -> DataFrame:
    """Logistic link with a steepness by a standardised column (0.6 to 1.4): adds ``s``."""
    scale = df.agg(F.avg(by).alias("__m"), F.greatest(F.stddev_pop(by), F.lit(1e-9)).alias("__d"))
    steep = 0.6 + 0.8 * sigmoid((F.col(by) - F.col("__m")) / F.col("__d"))
    return df.crossJoin(F.broadcast(scale)).withColumn("s", sigmoid(eta * steep)).drop("__m", "__d")


#: A rational approximation of the normal tail (numerator and denominator, leading coefficient first).
_TAIL = (
    [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376],
    [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752],
)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, to about 1e-14, from arithmetic alone."""
    a = F.abs(x)
    top, below = (reduce(lambda v, c: v * a + c, rest, F.lit(first)) for first, *rest in _TAIL)
    far = reduce(lambda v, k: a + k / v, (4.0, 3.0, 2.0, 1.0), a + 0.65)
    tail = F.when(a > 37, 0.0).otherwise(F.exp(-a * a / 2) * F.when(a < 7.07106781186547, top / below).otherwise(1 / (far * math.sqrt(2 * math.pi))))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def probit(eta: Column, scale: float = 0.5875) -> Column:
    return normal_cdf((eta * scale).cast("double"))


def numeric_elasticity(link, index: Column, beta: Column, log_price: Column, h: float = 1e-4) -> Column:
    """Minus d log s / d log p by a central difference, for any link of index - beta log price."""
    up, down = link(index - beta * (log_price + h)), link(index - beta * (log_price - h))
    floor = F.lit(FLOOR)
    return -(F.ln(F.greatest(up, floor)) - F.ln(F.greatest(down, floor))) / (2 * h)


def profit(conversion: Column, price: Column, cost: Column) -> Column:
    return conversion * (price - cost)


def optimal_price(elasticity, price: Column, cost: Column, steps: int = 25, low: float = 0.5, high: float = 2.0) -> Column:
    """Price where (p - c)/p = 1/elasticity(p), by a damped fixed point inside [low, high] times ``price``.

    ``elasticity`` maps a price column to a column; where it is 1 or less the price goes to the upper end.
    """

    def step(p: Column, _: Column) -> Column:
        e = elasticity(p)
        target = F.when(e > 1 + 1e-6, cost / (1 - 1 / e)).otherwise(high * price)
        return 0.5 * p + 0.5 * F.least(F.greatest(target, low * price), high * price)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), price.cast("double"), step)


def rates_by_bin(held: DataFrame, score: str, multipliers: tuple[float, ...]) -> DataFrame:
    """Per-arm rates and counts of every ``bin``, with the arc elasticity of the extreme arms and its error."""
    last, cells = len(multipliers) - 1, []
    for k in range(last + 1):
        here = F.col("arm") == k
        cells += [F.avg(F.when(here, F.col("bought"))).alias(f"conv_arm{k}"), F.sum(here.cast("long")).alias(f"n_arm{k}")]
    s = held.groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("eps_predicted"), *cells)
    span = math.log(multipliers[last]) - math.log(multipliers[0])
    low, high = F.col("conv_arm0"), F.col(f"conv_arm{last}")
    var = _sum([(1 - c) / F.greatest(c * F.col(f"n_arm{k}"), F.lit(1e-9)) for k, c in ((0, low), (last, high))])
    return s.select("*", (-(F.ln(high) - F.ln(low)) / span).alias("eps_realised"), (F.sqrt(var) / span).alias("se"))


# ---- buyer side --------------------------------------------------------------------------------


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def inverse_softplus(y: Column) -> Column:
    """Null where ``y`` is not positive."""
    return F.when(y > 0, y + F.ln(-F.expm1(-y)))


def stable_logit(p: Column, eps: float = 1e-9) -> Column:
    inside = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(inside) - F.log1p(-inside)


def scalar_posterior(beta: Column, pi: list[Column], z: list[float]) -> list[Column]:
    """Buyer posterior of the arms for one elasticity ``beta`` at the log-price doses ``z``."""
    raw = [p * F.exp(-beta * d) for p, d in zip(pi, z, strict=True)]
    total = _sum(raw)
    return [r / total for r in raw]


def scalar_log_rr(beta: Column, z: list[float]) -> list[Column]:
    """Log risk ratios of the first and last arm against the middle one."""
    return [-beta * (z[0] - z[1]), -beta * (z[2] - z[1])]


def smooth_projection(h: Column, low: Column, temperature: float = 0.05) -> list[Column]:
    return [-temperature * softplus(-h / temperature), temperature * softplus(low / temperature)]


def pair_probability(log_rr: Column, pi_treatment: Column, pi_control: Column) -> Column:
    return sigmoid(F.ln(pi_treatment) - F.ln(pi_control) + log_rr)


def scalar_from_gaps(h: Column, low: Column, z: list[float], w: tuple[float, float] = (1.0, 1.0)) -> Column:
    """Weighted least-squares elasticity, not negative, from the two log risk ratios."""
    d = (z[0] - z[1], z[2] - z[1])
    top = -(w[0] * d[0] * h + w[1] * d[1] * low)
    return F.greatest(top / max(w[0] * d[0] ** 2 + w[1] * d[1] ** 2, 1e-12), F.lit(0.0))


def scalar_nll(beta: Column, arm: Column, pi: list[Column], z: list[float], arms: tuple[str, ...] = ("H", "C", "L")) -> Column:
    """Negative log likelihood of a buyer's arm under one elasticity."""
    r = scalar_posterior(beta, pi, z)
    return -F.ln(reduce(lambda rest, k: F.when(arm == arms[k], r[k]).otherwise(rest), range(len(arms)), F.lit(None).cast("double")))


def multiclass_nll(df: DataFrame, arm: Column, r: list[Column], arms: tuple[str, ...] = ("H", "C", "L")) -> DataFrame:
    """Mean negative log posterior of the buyers' own arms."""
    own = reduce(lambda rest, k: F.when(arm == arms[k], r[k]).otherwise(rest), range(len(arms)), F.lit(None).cast("double"))
    return df.agg(F.count("*").alias("n_buyers"), F.avg(-F.ln(F.least(F.greatest(own, F.lit(1e-15)), F.lit(1.0)))).alias("nll"))


def global_scalar_beta(buyers: DataFrame, pi: list[Column], z: list[float], arms: tuple[str, ...] = ("H", "C", "L"), upper: float = 30.0, steps: int = 12) -> DataFrame:
    """One elasticity in [0, upper] of greatest likelihood: Newton steps, each over sums of all buyers. One row (beta, nll)."""
    dose = reduce(lambda rest, k: F.when(F.col("arm") == arms[k], F.lit(z[k])).otherwise(rest), range(len(arms)), F.lit(None).cast("double"))
    held = buyers.select("arm", *[p.alias(f"__p{k}") for k, p in enumerate(pi)]).groupBy("arm", *[f"__p{k}" for k in range(len(pi))]).count()
    beta, n = 0.0, F.col("count")
    columns = [F.col(f"__p{k}") for k in range(len(pi))]
    for _ in range(steps):
        r = scalar_posterior(F.lit(beta), columns, z)
        mean = _sum([x * d for x, d in zip(r, z, strict=True)])
        square = _sum([x * d * d for x, d in zip(r, z, strict=True)])
        s = held.agg(F.sum(n * (dose - mean)).alias("g"), F.sum(n * (square - mean * mean)).alias("h")).first()
        if s.g is None or not s.h:
            break
        after = min(max(beta - s.g / s.h, 0.0), upper)
        if abs(after - beta) < 1e-10:
            break
        beta = after
    return held.agg(F.lit(beta).alias("beta"), (F.sum(n * scalar_nll(F.lit(beta), F.col("arm"), columns, z, arms)) / F.sum(n)).alias("nll"))


def calibration_slope(buyers: DataFrame, arm: str, log_rr: Column, steps: int = 25) -> DataFrame:
    """Logistic recalibration of a predicted log risk ratio with the allocation as offset: intercept, slope. Newton over sums."""
    held = buyers.filter(F.col("arm").isin(arm, "C")).select((F.col("arm") == arm).cast("double").alias("y"), F.ln(F.col(f"pi_{arm}") / F.col("pi_C")).alias("o"), log_rr.alias("x"))
    centre = held.agg(F.avg("x").alias("m")).first().m
    if centre is None:
        return held.agg(F.lit(None).cast("double").alias("intercept"), F.lit(None).cast("double").alias("slope"))
    a, b, x = 0.0, 1.0, F.col("x") - centre
    for _ in range(steps):
        p = sigmoid(F.col("o") + a + b * x)
        e, v = F.col("y") - p, p * (1 - p)
        s = held.agg(F.sum(e).alias("g0"), F.sum(e * x).alias("g1"), F.sum(v).alias("h0"), F.sum(v * x).alias("h1"), F.sum(v * x * x).alias("h2")).first()
        det = s.h0 * s.h2 - s.h1 * s.h1
        if not det > 1e-12:
            break
        da, db = (s.h2 * s.g0 - s.h1 * s.g1) / det, (s.h0 * s.g1 - s.h1 * s.g0) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return held.agg(F.lit(a - b * centre).alias("intercept"), F.lit(b).alias("slope"))
