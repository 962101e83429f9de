"""Closed-form demand models from grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tercet.operators.ordering import quantiles


def pooled_loglog(frame: DataFrame, y: str = "log_qty", t: str = "log_price") -> DataFrame:
    """One slope for all rows: minus it is the elasticity."""
    s = frame.agg(F.count("*").alias("n"), F.regr_slope(y, t).alias("b"), F.regr_intercept(y, t).alias("a"), F.regr_r2(y, t).alias("r2"))
    return s.select("n", (-F.col("b")).alias("elasticity"), F.col("a").alias("intercept"), "r2")


def shrunk_per_product(frame: DataFrame, min_obs: int = 12, min_sd: float = 0.02, tau2: float | None = None, demean_week: bool = True) -> DataFrame:
    """Per-product slopes within weeks, shrunk to their precision-weighted mean.

    The spread of the true slopes, ``tau2``, is by default the variance of the raw ones less their mean squared error, 1e-6 at
    least. A product with fewer rows, or whose price moved less (population standard deviation), gets the mean itself (0 where no
    product has a slope); its raw slope and error are null.
    """
    week = Window.partitionBy("week")
    y, t = [(F.col(c) - F.avg(c).over(week) if demean_week else F.col(c)) for c in ("log_qty", "log_price")]
    d = frame.select("stock_code", y.alias("y"), t.alias("t"))
    g = d.groupBy("stock_code").agg(F.count("*").alias("n"), F.covar_pop("t", "y").alias("ty"), F.var_pop("t").alias("tt"), F.var_pop("y").alias("yy"))
    sound = (F.col("n") >= min_obs) & (F.sqrt("tt") >= min_sd) & (F.col("n") * F.col("tt") > 1e-10)
    rest = (F.col("yy") - F.col("ty") * F.col("ty") / F.col("tt")) / F.greatest(F.col("n") - 2, F.lit(1)) / F.col("tt")
    with_v = g.withColumns({"b": F.when(sound, -F.col("ty") / F.col("tt")), "v": F.when(sound, F.greatest(rest, F.lit(1e-12)))})
    mean = with_v.agg(F.coalesce(F.sum(F.col("b") / F.col("v")) / F.sum(1 / F.col("v")), F.lit(0.0)).alias("mu"), F.var_samp("b").alias("vb"), F.avg("v").alias("mv"))
    tau = F.greatest(F.col("vb") - F.col("mv"), F.lit(1e-6)) if tau2 is None else F.lit(float(tau2))
    k = tau / (tau + F.col("v"))
    return with_v.crossJoin(F.broadcast(mean)).select("stock_code", "n", F.col("b").alias("raw"), F.sqrt("v").alias("se"), F.coalesce(k * F.col("b") + (1 - k) * F.col("mu"), F.col("mu")).alias("elasticity"))


def twoway_demeaned(frame: DataFrame, rounds: int = 2, columns: tuple[str, ...] = ("log_qty", "log_price")) -> DataFrame:
    """Alternate removal of product and week means, a fixed number of rounds."""
    out = frame
    for _ in range(rounds):
        for key in ("stock_code", "week"):
            w = Window.partitionBy(key)
            out = out.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})
    return out


def twoway_elasticity(frame: DataFrame, rounds: int = 2) -> DataFrame:
    d = twoway_demeaned(frame.select("stock_code", "week", "log_qty", "log_price"), rounds)
    s = d.agg(F.count("*").alias("n"), F.sum(F.col("log_price") * F.col("log_qty")).alias("ty"), F.sum(F.col("log_price") * F.col("log_price")).alias("tt"))
    return s.select("n", (-F.col("ty") / F.col("tt")).alias("elasticity"))


def price_levels(frame: DataFrame, column: str, k: int) -> DataFrame:
    """K levels cut at quantiles (an edge belongs above), with their mean price and multiplier."""
    edges = quantiles(frame, column, [i / k for i in range(1, k)]).withColumnRenamed("q", "__e").crossJoin(frame.agg(F.avg(column).alias("__m")))
    level = F.aggregate("__e", F.lit(0), lambda n, e: n + (F.col(column) >= e).cast("int"))
    return frame.crossJoin(F.broadcast(edges)).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.avg(column).alias("mean_price"), F.exp(F.avg(column) - F.first("__m")).alias("multiplier"))


def unit_weights(frame: DataFrame, units: Column, cap: float = 0.99) -> DataFrame:
    """Units over their product's mean, winsorised at a quantile, normalised to mean one."""
    raw = frame.withColumn("w", units / F.avg(units).over(Window.partitionBy("stock_code")))
    top = quantiles(raw, "w", [cap]).select(F.col("q")[0].alias("__c"))
    cut = raw.crossJoin(F.broadcast(top)).withColumn("w", F.least("w", "__c"))
    mean = cut.agg(F.avg("w").alias("__m"))
    return cut.crossJoin(F.broadcast(mean)).groupBy("stock_code").agg(F.sum(F.col("w") / F.col("__m")).alias("weight"), F.count("*").alias("n"))


def effective_size(frame: DataFrame, w: Column) -> DataFrame:
    return frame.select(w.alias("w")).agg((F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.count("*").alias("n"))
