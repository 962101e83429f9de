"""Leak-safe window features, calendar splits and bias diagnostics of the product-week panel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The names of the controls and price features, in order.
CONTROLS = ["week_idx", "woy_sin", "woy_cos", "is_q4", "weeks_since_launch", "prod_log_price_mean", "prod_log_price_sd", "prod_log_qty_mean", "prod_n_weeks", "lag_log_qty", "lag2_log_qty", "roll4_log_qty", "roll12_log_qty", "lag_log_price", "roll4_log_price", "lag_n_customers", "lag_n_lines", "market_log_qty", "market_log_price"]
PRICE_FEATURES = ["rel_price", "price_change", "is_discounted"]
#: Fixed value: a price this far below its trailing mean, in logs, is a discount.
DISCOUNT = -0.02


def add_features(panel: DataFrame, price: str = "price_modal", train_before=None, rel_window: int = 12) -> DataFrame:
    """Controls and price features; the first week of every product is dropped.

    Lags and trailing means follow rows of a product (active weeks), never calendar weeks.
    ``train_before`` restricts the product summaries to weeks before a date.
    """
    base = panel.withColumn("log_qty", F.ln(F.greatest("qty", F.lit(1)).cast("double"))).withColumn("log_price", F.ln(price))
    by = Window.partitionBy("stock_code").orderBy("week")

    def trail(column: str, n: int):
        return F.avg(column).over(by.rowsBetween(-n, -1))

    lagged = base.withColumns({
        "lag_log_qty": F.lag("log_qty").over(by),
        "lag2_log_qty": F.coalesce(F.lag("log_qty", 2).over(by), F.lag("log_qty").over(by)),
        "roll4_log_qty": trail("log_qty", 4),
        "roll12_log_qty": trail("log_qty", 12),
        "lag_log_price": F.lag("log_price").over(by),
        "roll4_log_price": trail("log_price", 4),
        "__rel": trail("log_price", rel_window),
        "lag_n_customers": F.lag("n_customers").over(by).cast("double"),
        "lag_n_lines": F.lag("n_lines").over(by).cast("double"),
        "__launch": F.min("week").over(Window.partitionBy("stock_code")),
    }).withColumns({"rel_price": F.col("log_price") - F.col("__rel"), "price_change": F.col("log_price") - F.col("lag_log_price")})
    first = panel.agg(F.min("week").alias("__first"))
    year = 2 * math.pi * F.weekofyear("week") / 52.0
    dated = lagged.crossJoin(F.broadcast(first)).withColumns({
        "week_idx": F.floor(F.datediff("week", "__first") / 7).cast("double"),
        "woy_sin": F.sin(year),
        "woy_cos": F.cos(year),
        "is_q4": F.month("week").isin(10, 11, 12).cast("double"),
        "weeks_since_launch": F.floor(F.datediff("week", "__launch") / 7).cast("double"),
        "is_discounted": (F.col("rel_price") < DISCOUNT).cast("double"),
    })
    market = base.groupBy("week").agg(F.sum("qty").alias("__q"), F.sum("log_price").alias("__lp"), F.count("*").alias("__n"))
    with_market = dated.join(market, "week").withColumns({
        "market_log_qty": F.ln(F.greatest(F.col("__q") - F.col("qty"), F.lit(1)).cast("double")),
        "market_log_price": (F.col("__lp") - F.col("log_price")) / F.greatest(F.col("__n") - 1, F.lit(1)),
    })
    seen = base if train_before is None else base.filter(F.col("week") < F.lit(train_before))
    summary = seen.groupBy("stock_code").agg(F.avg("log_price").alias("prod_log_price_mean"), F.stddev_samp("log_price").alias("prod_log_price_sd"), F.avg("log_qty").alias("prod_log_qty_mean"), F.count("*").cast("double").alias("prod_n_weeks"))
    middle = seen.agg(F.avg("log_price").alias("__mp"), F.avg("log_qty").alias("__mq"))
    filled = with_market.join(summary, "stock_code", "left").crossJoin(F.broadcast(middle)).withColumns({
        "prod_log_price_mean": F.coalesce("prod_log_price_mean", "__mp"),
        "prod_log_price_sd": F.coalesce("prod_log_price_sd", F.lit(0.0)),
        "prod_log_qty_mean": F.coalesce("prod_log_qty_mean", "__mq"),
        "prod_n_weeks": F.coalesce("prod_n_weeks", F.lit(0.0)),
    })
    return filled.na.drop(subset=["lag_log_qty", "lag_log_price"]).select("stock_code", "week", "log_qty", "log_price", *CONTROLS, *PRICE_FEATURES)


def week_numbers(panel: DataFrame) -> DataFrame:
    """Distinct weeks with their ordinal from 0: one row per week."""
    return panel.select("week").distinct().withColumn("week_no", F.row_number().over(Window.orderBy("week")) - 1)


def rolling_origin_folds(weeks: DataFrame, n_splits: int = 5, horizon: int = 8, min_train: int = 26, gap: int = 0) -> DataFrame:
    """Folds as week numbers: train before ``train_end``, validate from ``valid_start`` up to ``valid_end``.

    Starts are spread evenly from ``min_train`` (+ gap) to the last start that leaves a horizon; the last
    week is never inside a validation window.
    """
    n = weeks.agg(F.count("*").alias("n"))
    steps = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("k"))
    low = F.lit(min_train + gap)
    start = F.floor(low + (F.col("n") - horizon - low) * F.col("k") / F.lit(max(n_splits - 1, 1)))
    spans = steps.select(start.alias("valid_start"), F.least(start + horizon, F.col("n") - 1).alias("valid_end")).distinct().filter("valid_end > valid_start")
    numbered = spans.withColumn("fold", F.row_number().over(Window.orderBy("valid_start")) - 1)
    return numbered.select("fold", (F.col("valid_start") - gap).alias("train_end"), "valid_start", "valid_end")


def fold_sizes(panel: DataFrame, weeks: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows and products on both sides of every fold; folds are few, so they are broadcast."""
    placed = panel.join(weeks, "week").crossJoin(F.broadcast(folds))
    side = F.when(F.col("week_no") < F.col("train_end"), "train").when((F.col("week_no") >= F.col("valid_start")) & (F.col("week_no") < F.col("valid_end")), "valid")
    return placed.withColumn("side", side).filter("side is not null").groupBy("fold", "side").agg(F.count("*").alias("n_rows"), F.countDistinct("stock_code").alias("n_products"), F.min("week_no").alias("first_week"), F.max("week_no").alias("last_week"))


def division_bias(clean: DataFrame) -> DataFrame:
    """Slope of log price on log quantity within product and week, with its t value."""
    keys = Window.partitionBy("stock_code", "week")
    logs = clean.withColumn("lq", F.ln(F.col("quantity").cast("double"))).withColumn("lp", F.ln("price"))
    within = logs.select((F.col("lq") - F.avg("lq").over(keys)).alias("x"), (F.col("lp") - F.avg("lp").over(keys)).alias("y"))
    s = within.agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    slope = F.col("sxy") / F.col("sxx")
    return s.select("n", slope.alias("slope"), (slope / F.sqrt((F.col("syy") - slope * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))).alias("t_value"))


def naive_bias(frame: DataFrame, y: str, t: str, truth: str, u: str) -> DataFrame:
    """OLS slope against the average truth, split exactly into its covariance parts."""
    s = frame.agg(F.covar_samp(y, t).alias("yt"), F.var_samp(t).alias("tt"), F.avg(truth).alias("truth"), F.covar_samp(u, t).alias("ut"))
    ols = -F.col("yt") / F.col("tt")
    return s.select(ols.alias("ols_elasticity"), "truth", (ols - F.col("truth")).alias("bias"), (-F.col("ut") / F.col("tt")).alias("confounding"), (ols - F.col("truth") + F.col("ut") / F.col("tt")).alias("remainder"))
