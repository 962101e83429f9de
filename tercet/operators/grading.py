"""Grading elasticity models on a randomised price test, and the value of pricing policies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tercet.operators.ordering import quantiles

MULTIPLIERS = (0.9, 1.0, 1.1)
FLOOR = 1e-12


def binned(df: DataFrame, score: str, n_bins: int) -> DataFrame:
    """Add ``bin``: the number of interior quantile edges at or below the score."""
    edges = quantiles(df, score, [k / n_bins for k in range(1, n_bins)]).withColumnRenamed("q", "__e")
    steps = F.aggregate("__e", F.lit(0), lambda n, e: n + (F.col(score) >= e).cast("int"))
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", steps).drop("__e")


def arm_rates(df: DataFrame, by: list[str], arm: str = "arm", hit: str = "bought") -> DataFrame:
    return df.groupBy(*by, arm).agg(F.count("*").alias("n"), F.avg(hit).alias("rate"))


def gates_loglinear(df: DataFrame, score: str, n_bins: int = 5) -> DataFrame:
    """Realised elasticity of every bin: weighted least squares of log rate on log price over the arms."""
    held = binned(df, score, n_bins)
    rates = held.groupBy("bin", "arm", "m").agg(F.count("*").alias("n"), F.avg("bought").alias("d"), F.avg(score).alias("predicted"))
    usable = rates.filter((F.col("d") > 0) & (F.col("d") < 1)).withColumns({"w": F.col("n") * F.col("d") / (1 - F.col("d")), "x": F.ln("m"), "y": F.ln("d")})
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    s = usable.groupBy("bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("predicted")).alias("sp"), F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * y).alias("swy"), F.sum(w * x * x).alias("swxx"), F.sum(w * x * y).alias("swxy"))
    det = F.col("sw") * F.col("swxx") - F.col("swx") * F.col("swx")
    return s.select("bin", "n", (F.col("sp") / F.col("n")).alias("mean_score"), (-(F.col("sw") * F.col("swxy") - F.col("swx") * F.col("swy")) / det).alias("elasticity"), F.sqrt(F.col("sw") / det).alias("se"))


def gates_arc(df: DataFrame, score: str, n_bins: int = 5) -> DataFrame:
    """Arc elasticity of every bin between the cheapest and the dearest arm, with a delta-method error."""
    held = binned(df, score, n_bins)
    side = [(0, "lo"), (2, "hi")]
    s = held.groupBy("bin").agg(F.count("*").alias("n"), *[F.avg(F.when(F.col("arm") == a, F.col("bought"))).alias(f"d_{n}") for a, n in side], *[F.sum((F.col("arm") == a).cast("long")).alias(f"n_{n}") for a, n in side])
    span = math.log(MULTIPLIERS[2]) - math.log(MULTIPLIERS[0])
    var = (1 - F.col("d_lo")) / (F.col("d_lo") * F.col("n_lo")) + (1 - F.col("d_hi")) / (F.col("d_hi") * F.col("n_hi"))
    return s.select("bin", "n", (-(F.ln("d_hi") - F.ln("d_lo")) / span).alias("elasticity"), (F.sqrt(var) / span).alias("se"))


def blp_slope(gates: DataFrame) -> DataFrame:
    """Inverse-variance regression of realised on predicted: slope 1 and intercept 0 for calibrated scores."""
    g = gates.withColumn("w", 1 / (F.col("se") * F.col("se")))
    w, x, y = F.col("w"), F.col("mean_score"), F.col("elasticity")
    s = g.agg(F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.count("*").alias("n_bins"))
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    return s.select("n_bins", ((F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).alias("slope"), F.sqrt(F.col("sw") / det).alias("slope_se"), ((F.col("sy") * F.col("sxx") - F.col("sx") * F.col("sxy")) / det).alias("intercept"))


def posterior_elasticity(p_low: Column, p_high: Column) -> Column:
    """Elasticity implied by a buyer's arm posterior, equal allocation."""
    span = math.log(MULTIPLIERS[2]) - math.log(MULTIPLIERS[0])
    return -(F.ln(F.greatest(p_high, F.lit(FLOOR))) - F.ln(F.greatest(p_low, F.lit(FLOOR)))) / span


def demand_curve(df: DataFrame, p_buy: Column, q: float = 1 / 3) -> DataFrame:
    return df.select("row_id", *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"p{k}") * p_buy / q)).alias(f"d{k}") for k in range(3)])


def revenue_arm(margins: tuple[float, float, float] = MULTIPLIERS) -> Column:
    """The arm of largest posterior times margin; ties to the cheapest."""
    v = [F.col(f"p{k}") * m for k, m in enumerate(margins)]
    return F.when((v[0] >= v[1]) & (v[0] >= v[2]), 0).when(v[1] >= v[2], 1).otherwise(2)


def ipw_value(df: DataFrame, policy: Column, reward: Column, q: float = 1 / 3) -> DataFrame:
    c = F.when(F.col("arm") == policy, reward / q).otherwise(0.0)
    return df.select(c.alias("c")).agg(F.avg("c").alias("value"), (F.stddev_samp("c") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))


def aipw_value(df: DataFrame, policy: Column, reward: Column, strata: str, q: float = 1 / 3) -> DataFrame:
    """Doubly robust value; the outcome model is the mean reward by stratum and arm."""
    base = df.withColumn("__r", reward).withColumn("__t", policy)
    fit = base.groupBy(strata, F.col("arm").alias("__t")).agg(F.avg("__r").alias("mu"))
    joined = base.join(fit, [strata, "__t"])
    c = F.col("mu") + F.when(F.col("arm") == F.col("__t"), (F.col("__r") - F.col("mu")) / q).otherwise(0.0)
    return joined.select(c.alias("c")).agg(F.avg("c").alias("value"), (F.stddev_samp("c") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))


def pseudo_outcomes(df: DataFrame, strata: str, reward: Column, pair: tuple[int, int] = (0, 2), q: float = 1 / 3) -> DataFrame:
    """``df`` with ``psi``: the doubly robust pseudo-outcome of arm pair[0] over pair[1], from arm means by stratum."""
    base = df.withColumn("__r", reward)
    fit = base.groupBy(strata).agg(*[F.avg(F.when(F.col("arm") == a, F.col("__r"))).alias(f"mu{i}") for i, a in enumerate(pair)])
    j = base.join(fit, strata)
    psi = F.col("mu0") - F.col("mu1") + F.when(F.col("arm") == pair[0], (F.col("__r") - F.col("mu0")) / q).otherwise(0.0) - F.when(F.col("arm") == pair[1], (F.col("__r") - F.col("mu1")) / q).otherwise(0.0)
    return j.withColumn("psi", psi).drop("__r", "mu0", "mu1")


def dr_uplift(df: DataFrame, strata: str, reward: Column, pair: tuple[int, int] = (0, 2), q: float = 1 / 3) -> DataFrame:
    """Mean pseudo-outcome of arm pair[0] over pair[1] by stratum."""
    return pseudo_outcomes(df, strata, reward, pair, q).groupBy(strata).agg(F.count("*").alias("n"), F.avg("psi").alias("uplift"))


def targeting_curve(df: DataFrame, gain: str, policy: Column, reward: Column, points: int = 21, q: float = 1 / 3) -> DataFrame:
    """IPW value when the share of rows with the largest gains follows the policy and the others the middle arm.

    At ``points`` even shares from 0 to 1: (share, value). Rows of one gain count alike: where a share ends among
    them, they enter with the part of them that it takes. Sums by distinct gain come first; the shares are ``points`` rows.
    """
    base = df.select(gain, F.when(F.col("arm") == policy, reward / q).otherwise(0.0).alias("treated"), F.when(F.col("arm") == 1, reward / q).otherwise(0.0).alias("flat"))
    by_gain = base.groupBy(gain).agg(F.sum("treated").alias("treated"), F.sum("flat").alias("flat"), F.count("*").alias("n"))
    before = Window.orderBy(F.col(gain).desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("treated", "flat", "n")]
    every = by_gain.agg(F.sum("flat").alias("all_flat"), F.sum("n").alias("all_n"))
    shares = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("k", F.bround(F.col("i") * F.col("all_n") / (points - 1)))
    inside = ((F.col("k") > F.col("n_before")) & (F.col("k") <= F.col("n_before") + F.col("n"))) | ((F.col("k") == 0) & (F.col("n_before") == 0))
    met = by_gain.select("treated", "flat", "n", *sums).join(F.broadcast(shares), inside).withColumn("part", (F.col("k") - F.col("n_before")) / F.col("n"))
    return met.select((F.col("i") / (points - 1)).alias("share"), ((F.col("treated_before") - F.col("flat_before") + F.col("all_flat") + F.col("part") * (F.col("treated") - F.col("flat"))) / F.col("all_n")).alias("value"))


def predictive_metrics(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """Errors of a prediction of logs: rmse, mae, bias, r2, and the mean relative error of its levels."""
    e = df.select(y.alias("y"), p.alias("p")).withColumn("e", F.col("p") - F.col("y"))
    mean = F.avg("y")
    return e.agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"), (1 - F.sum(F.col("e") * F.col("e")) / (F.sum(F.col("y") * F.col("y")) - F.count("*") * mean * mean)).alias("r2"), F.avg(F.abs(F.exp("p") - F.exp("y")) / F.greatest(F.exp("y"), F.lit(1e-9))).alias("level_mape"))


def recovery_metrics(df: DataFrame, truth: Column, estimate: Column) -> DataFrame:
    e = df.select(truth.alias("t"), estimate.alias("s")).withColumn("e", F.col("s") - F.col("t"))
    mse = F.avg(F.col("e") * F.col("e"))
    return e.agg(F.sqrt(mse).alias("rmse"), F.avg("e").alias("bias"), F.avg(F.abs("e")).alias("mae"), F.corr("t", "s").alias("corr"), (F.avg("e") * F.avg("e") / mse).alias("bias_share"))


def summary(df: DataFrame, eps: Column) -> DataFrame:
    e = df.select(eps.alias("e"))
    s = e.agg(F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd"), F.avg((F.col("e") < 0).cast("double")).alias("share_negative"), F.avg((F.col("e") < 1).cast("double")).alias("share_inelastic"))
    return s.crossJoin(F.broadcast(quantiles(e, "e", [0.05, 0.5, 0.95]))).select("mean", "sd", F.col("q")[0].alias("p5"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"), "share_negative", "share_inelastic")


def blp_orthogonal(residuals: DataFrame) -> DataFrame:
    """No-intercept regression of ry on rt and rt x centred eps, HC1 errors, from cross moments only."""
    mean = residuals.agg(F.avg("eps").alias("__m"))
    d = residuals.crossJoin(F.broadcast(mean)).withColumns({"a": -F.col("rt"), "b": -F.col("rt") * (F.col("eps") - F.col("__m"))})
    a, b, y = F.col("a"), F.col("b"), F.col("ry")
    s = d.agg(F.count("*").alias("n"), F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"), F.sum(a * y).alias("ay"), F.sum(b * y).alias("by"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    beta = s.withColumns({"b0": (F.col("bb") * F.col("ay") - F.col("ab") * F.col("by")) / det, "b1": (F.col("aa") * F.col("by") - F.col("ab") * F.col("ay")) / det, "det": det})
    e = d.crossJoin(F.broadcast(beta)).withColumn("u", F.pow(F.col("ry") - F.col("b0") * a - F.col("b1") * b, 2))
    m = e.groupBy("n", "aa", "ab", "bb", "det", "b0", "b1").agg(F.sum(F.col("u") * a * a).alias("maa"), F.sum(F.col("u") * a * b).alias("mab"), F.sum(F.col("u") * b * b).alias("mbb"))
    var = (F.col("ab") * F.col("ab") * F.col("maa") - 2 * F.col("aa") * F.col("ab") * F.col("mab") + F.col("aa") * F.col("aa") * F.col("mbb")) / (F.col("det") * F.col("det")) * F.col("n") / (F.col("n") - 2)
    return m.select("n", F.col("b0").alias("average_effect"), F.col("b1").alias("calibration"), F.sqrt(var).alias("calibration_se"))


def lerner_price(cost: Column, eps: Column, price0: Column | None = None, lo: float = 0.5, hi: float = 2.0) -> Column:
    """Profit-maximising price c eps / (eps - 1) between lo and hi times ``price0`` (the cost, by default).

    The upper bound holds where demand is inelastic or its elasticity unknown.
    """
    at = cost if price0 is None else price0
    price = F.when((eps > 1 + 1e-9) & ~F.isnan(eps), cost * eps / (eps - 1)).otherwise(hi * at)
    return F.least(F.greatest(price, lo * at), hi * at)


def profit_weight(eps: Column) -> Column:
    return 1 / F.pow(F.greatest(F.abs(eps - 1), F.lit(1e-3)), 4)


def policy_profit(df: DataFrame, policy: Column, profit: Column, q: Column) -> DataFrame:
    """Self-normalised IPW profit, its error, conversion, matched rows, effective size."""
    base = df.withColumn("__w", F.when(F.col("arm") == policy, 1 / q).otherwise(0.0)).withColumn("__p", profit)
    s = base.agg(F.sum("__w").alias("sw"), F.sum(F.col("__w") * F.col("__w")).alias("sww"), F.sum(F.col("__w") * F.col("__p")).alias("swp"), F.sum(F.pow("__w", 2) * F.pow("__p", 2)).alias("swp2"), F.sum(F.pow("__w", 2) * F.col("__p")).alias("swwp"), F.sum(F.col("__w") * F.col("bought")).alias("swb"), F.sum((F.col("__w") > 0).cast("long")).alias("matched"), F.count("*").alias("n"))
    v = F.col("swp") / F.col("sw")
    return s.select(v.alias("value"), (F.sqrt(F.col("swp2") - 2 * v * F.col("swwp") + v * v * F.col("sww")) / F.col("sw")).alias("se"), (F.col("swb") / F.col("sw")).alias("conversion"), "matched", (F.col("sw") * F.col("sw") / F.col("sww")).alias("ess"))


def experiment_cost(df: DataFrame, profit: Column) -> DataFrame:
    """Mean profit by arm, and what each arm costs against the middle and against the best arm."""
    s = df.groupBy("arm").agg(F.count("*").alias("n"), F.avg(profit).alias("profit"))
    every = s.agg(F.max("profit").alias("__best"), F.max(F.when(F.col("arm") == 1, F.col("profit"))).alias("__mid"))
    return s.crossJoin(F.broadcast(every)).select("arm", "n", "profit", (F.col("__mid") - F.col("profit")).alias("cost_vs_control"), (F.col("__best") - F.col("profit")).alias("cost_vs_best"))


def nearest_arm(price: Column) -> Column:
    """The tested arm nearest to a price multiplier in log price; ties to the cheapest."""
    d = [F.abs(F.ln(price) - math.log(m)) for m in MULTIPLIERS]
    return F.when((d[0] <= d[1]) & (d[0] <= d[2]), 0).when(d[1] <= d[2], 1).otherwise(2)


def regret(df: DataFrame, chosen: Column, profits: list[Column]) -> DataFrame:
    """How much profit a choice leaves behind, against the best arm of each row."""
    got = F.when(chosen == 0, profits[0]).when(chosen == 1, profits[1]).otherwise(profits[2])
    r = df.select((F.greatest(*profits) - got).alias("r"), F.greatest(*profits).alias("b"), got.alias("g"))
    s = r.agg(F.avg("r").alias("mean_regret"), (F.sum("g") / F.sum("b")).alias("share_of_best"))
    return s.crossJoin(F.broadcast(quantiles(r, "r", [0.5, 0.9]))).select("mean_regret", F.col("q")[0].alias("median_regret"), F.col("q")[1].alias("p90_regret"), "share_of_best")
