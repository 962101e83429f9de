"""Cleaning, panels, keys and reports: the relational primitives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tercet.operators.ordering import placed_by_key, placed_in_order, running

#: Stock codes that are no products.
NON_PRODUCT_CODES = ["POST", "D", "M", "DOT", "CRUK", "BANK CHARGES", "S", "AMAZONFEE", "ADJUST", "ADJUST2", "TEST001", "TEST002", "PADS", "GIFT", "B", "C2"]


def clean_transactions(txn: DataFrame) -> DataFrame:
    """Sales lines only, of product codes of 4 to 12 characters, with the Monday of their week."""
    code = F.upper(F.trim("stock_code"))
    return (
        txn.filter((F.col("quantity") > 0) & (F.col("price") > 0) & ~F.col("invoice").startswith("C"))
        .filter(~code.isin(NON_PRODUCT_CODES) & F.length(code).between(4, 12))
        .withColumn("stock_code", code)
        .withColumn("week", F.date_trunc("week", "ts"))
    )


def build_panel(clean: DataFrame, min_weeks: int = 20, min_weekly_units: int = 1) -> DataFrame:
    """Product-weeks with units, revenue, line and customer counts, and three price measures.

    A line gives its price and its customer apart; equal ones of a product-week are one row each, with the number of lines. Mode and
    median are read from counted prices: kept as sets beside a distinct count, they would be handed on once a product, week and customer.
    """
    keys = ("stock_code", "week")
    sold = clean.filter(F.col("stock_code").isNotNull() & F.col("week").isNotNull())
    nothing = F.lit(None)
    price = F.struct(F.col("price").alias("price"), nothing.cast(clean.schema["customer"].dataType).alias("customer"), F.col("quantity").alias("quantity"))
    customer = F.struct(nothing.cast(clean.schema["price"].dataType).alias("price"), F.col("customer").alias("customer"), nothing.cast(clean.schema["quantity"].dataType).alias("quantity"))
    apart = sold.select(*keys, F.inline(F.array(price, customer)))
    value = F.sum(F.col("quantity") * F.col("price")).alias("revenue")
    distinct = apart.groupBy(*keys, "price", "customer").agg(F.sum("quantity").alias("qty"), value, F.count("price").alias("n"))
    prices = distinct.groupBy(*keys, "price").agg(F.sum("qty").alias("qty"), F.sum("revenue").alias("revenue"), F.sum("n").alias("n"), F.count("customer").alias("n_customers"))
    common = F.min(F.when(F.col("price").isNotNull(), F.struct((-F.col("n")).alias("n"), "price")))
    weekly = (
        prices.groupBy(*keys)
        .agg(
            F.sum("qty").alias("qty"),
            F.sum("revenue").alias("revenue"),
            F.sum("n").alias("n_lines"),
            F.sum("n_customers").alias("n_customers"),
            common["price"].alias("price_modal"),
            F.percentile("price", F.lit(0.5), F.col("n")).alias("price_median"),
        )
        .withColumn("price_unitvalue", F.col("revenue") / F.col("qty"))
        .filter(F.col("qty") >= min_weekly_units)
    )
    weeks = F.count("*").over(Window.partitionBy("stock_code"))
    return weekly.withColumn("__n", weeks).filter(F.col("__n") >= min_weeks).drop("__n")


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """Rows, distinct keys and surplus rows; null keys equal each other."""
    groups = df.groupBy(*keys).count()
    return groups.agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_keys"), (F.sum("count") - F.count("*")).alias("n_duplicates"))


def validated_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that reports whether the right key is unique and how many rows stay unmatched."""
    repeats = right.groupBy(key).count().filter("count > 1").agg(F.count("*").alias("repeated_keys"))
    joined = left.join(right.withColumn("__hit", F.lit(1)), key, "left")
    return joined.agg(F.count("*").alias("n_rows"), F.count("__hit").alias("n_matched"), F.count(F.when(F.col("__hit").isNull(), 1)).alias("n_unmatched")).crossJoin(F.broadcast(repeats))


def group_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both sides, and of each alone."""
    both = a.select(key).distinct().withColumn("in_a", F.lit(1)).join(b.select(key).distinct().withColumn("in_b", F.lit(1)), key, "full")
    return both.agg(F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("n_both"), F.count(F.when(F.col("in_b").isNull(), 1)).alias("n_only_a"), F.count(F.when(F.col("in_a").isNull(), 1)).alias("n_only_b"))


def forward_time_holdout(df: DataFrame, group: str, ts: str, share: float = 0.2) -> DataFrame:
    """Whole groups by their last time: the latest ``share`` of groups is held out."""
    last = df.groupBy(group).agg(F.max(ts).alias("last_ts"), F.count("*").alias("n_rows"))
    n = last.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("__n"))
    counted = placed_in_order(last, "last_ts", group).crossJoin(F.broadcast(n)).withColumn("place", F.col("place") / F.col("__n")).drop("__n")
    return counted.withColumn("holdout", (F.col("place") >= 1 - share).cast("int"))


def top_fraction(df: DataFrame, score: str, key: str, fraction: float) -> DataFrame:
    """The floor(n f) rows of the highest score; ties to the smaller key, which may be of any ordered type.

    Rows without a score count for n but come last, and are never chosen: with fewer scored rows than wanted, all of those are.
    One row holds the cut: the score at which the wanted number is reached, and how many of its rows are still wanted. Ties at the
    cut are placed by their keys, in buckets.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("__n"))
    wanted = df.agg(F.least(F.floor(F.count("*") * F.lit(fraction)), F.count(score)).alias("__wanted"))
    placed = running(counts, score, ["__n"], descending=True).crossJoin(F.broadcast(wanted))
    reached = (F.col("__n_before") < F.col("__wanted")) & (F.col("__n_before") + F.col("__n") >= F.col("__wanted"))
    cut = placed.filter(reached).select(F.col(score).alias("__cut"), (F.col("__wanted") - F.col("__n_before")).alias("__left"))
    held = df.crossJoin(F.broadcast(cut))
    above, tied = held.filter(F.col(score) > F.col("__cut")), held.filter(F.col(score) == F.col("__cut"))
    kept = placed_by_key(tied, key).filter(F.col("place") < F.col("__left"))
    return above.select(*df.columns).unionByName(kept.select(*df.columns))


def seeded_subset(df: DataFrame, group: str, n: int, seed: str) -> DataFrame:
    """All rows of n groups chosen by a seeded hash of the group's name."""
    chosen = df.select(group).distinct().withColumn("h", F.md5(F.concat(F.lit(seed), F.col(group)))).orderBy("h").limit(n).select(group)
    return df.join(F.broadcast(chosen), group, "left_semi")


def pivoted(df: DataFrame, rows: str, columns: str, values: list[str], measure: Column) -> DataFrame:
    return df.groupBy(rows).pivot(columns, values).agg(measure)


def running_best(history: DataFrame, model: str, trial: str, value: str) -> DataFrame:
    w = Window.partitionBy(model).orderBy(trial).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return history.withColumn("best_so_far", F.min(value).over(w)).withColumn("is_best", F.col(value) == F.col("best_so_far"))


def arg_best(history: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """The row of least value by group; ties to the smaller key."""
    return history.groupBy(group).agg(F.min(F.struct(value, key)).alias("b")).select(group, F.col(f"b.{key}").alias(key), F.col(f"b.{value}").alias(value))
