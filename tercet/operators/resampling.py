"""Seeded folds by hash, replicate weights and interval estimates from grouped sums.

Folds are functions of a row's key alone, so that they need no shuffle. Bootstraps weigh clusters by Poisson(1) numbers from
a hash of (cluster, replicate, seed), the limit of drawing clusters with replacement: a replicate is one sum over clusters.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tercet.operators.ordering import placed_in_order, running
from tercet.operators.pricing import normal_cdf

CHANCE = 1.0 / 6.0
#: Poisson(1) weights above this are cut; their chance is below 1e-9.
MOST = 12


def fold_of(key: Column, k: int, seed: str = "") -> Column:
    """A fold from 0 to k - 1 by a seeded hash of the key: equal keys stay together."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long") % k


def stratified_group_folds(df: DataFrame, group: str, stratum: str, k: int, seed: str = "") -> DataFrame:
    """Whole groups in folds that share out each stratum evenly: group, stratum, n, fold.

    A group's stratum is its commonest (ties to the smallest). Inside a stratum the groups are put in order of a seeded hash, in
    buckets, and dealt to the folds in turn, so that folds differ by one group of a stratum at most.
    """
    sizes = df.groupBy(group, stratum).agg(F.count("*").alias("__c"))
    tied = sizes.groupBy(group).agg(F.sum("__c").alias("n"), F.min(F.struct(-F.col("__c"), F.col(stratum).alias("s"))).alias("__top")).select(group, F.col("__top.s").alias(stratum), "n")
    dice = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(group).cast("string"))), 1, 12), 16, 10).cast("long")
    dealt = tied.withColumn("__h", dice)
    met = dealt.groupBy(stratum, "__h").agg(F.count("*").alias("__m"))
    before = running(met, "__h", ["__m"], (stratum,)).select(stratum, "__h", "__m_before")
    same = F.row_number().over(Window.partitionBy(stratum, "__h").orderBy(group)) - 1
    return dealt.join(before, [stratum, "__h"]).select(group, stratum, "n", ((F.col("__m_before") + same) % k).alias("fold"))


def poisson_weight(*parts: Column) -> Column:
    """A Poisson(1) number by a hash of ``parts``."""
    u = F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)
    chances = np.cumsum([math.exp(-1) / math.factorial(j) for j in range(MOST)])
    out = F.lit(MOST)
    for j in range(MOST - 1, -1, -1):
        out = F.when(u < float(chances[j]), j).otherwise(out)
    return out


def cluster_bootstrap(df: DataFrame, cluster: str, value: Column, n_boot: int = 1000, alpha: float = 0.05, seed: int = 2026) -> DataFrame:
    """Mean of ``value`` with a percentile interval over resampled clusters: estimate, lower, upper, n_clusters."""
    sums = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("k"))
    each = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn("w", poisson_weight(F.col(cluster), F.col("rep"), F.lit(seed)))
    draws = each.groupBy("rep").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("k")), F.lit(0))).alias("d"))
    ends = draws.agg(F.percentile("d", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    point = sums.agg((F.sum("s") / F.sum("k")).alias("estimate"), F.count("*").alias("n_clusters"))
    return point.crossJoin(F.broadcast(ends)).select("estimate", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "n_clusters")


def sensitivity_intervals(cm: DataFrame, n_boot: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Intervals of the sensitivities of a fixed rule, from its confusion counts (y, pred, n): resampling the rows of a class
    is a binomial draw of its hits. Rows: class, sensitivity, lower, upper."""
    counts = cm.groupBy("y").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits")).orderBy("y").collect()  # one row a class
    rng, rows = np.random.default_rng(seed), []
    for c in counts:
        draws = rng.binomial(c.n, c.hits / c.n, n_boot) / c.n
        low, high = np.quantile(draws, [alpha / 2, 1 - alpha / 2])
        rows.append((int(c.y), c.hits / c.n, float(low), float(high)))
    return cm.sparkSession.createDataFrame(rows, "class long, sensitivity double, lower double, upper double")


def tested_against_chance(found: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A row (vus, se) with its Wald interval inside [0, 1], and z and two-sided p against chance."""
    q = NormalDist().inv_cdf(1 - alpha / 2)
    z = F.when(F.col("se") > 0, (F.col("vus") - CHANCE) / F.col("se"))
    return found.select("*", ((F.col("vus") - CHANCE) / (1 - CHANCE)).alias("vus_adjusted"), F.greatest(F.col("vus") - q * F.col("se"), F.lit(0.0)).alias("lower"), F.least(F.col("vus") + q * F.col("se"), F.lit(1.0)).alias("upper"), z.alias("z"), F.when(F.col("se") > 0, 2 * normal_cdf(-F.abs(z))).otherwise(0.0).alias("p_value"))


def slope_tests(found: DataFrame) -> DataFrame:
    """Two-sided p values of slope 0 and slope 1 for a row (slope, slope_se)."""
    t = F.col("slope_se")
    return found.select("*", (2 * normal_cdf(-F.abs(F.col("slope") / t))).alias("p_slope_zero"), (2 * normal_cdf(-F.abs((F.col("slope") - 1) / t))).alias("p_slope_one"))


def rolling_group_splits(df: DataFrame, group: str, ts: str, n_splits: int = 3, min_train: float = 0.5, validation: float = 0.15) -> DataFrame:
    """Whole groups by their last time: split, end, and how many groups and rows train and validate. Splits are few."""
    last = df.groupBy(group).agg(F.max(ts).alias("last"), F.count("*").alias("rows"))
    placed = placed_in_order(last, "last", group)
    n = last.count()
    first, size = max(1, math.floor(n * min_train)), max(1, math.floor(n * validation))
    ends = sorted({int(x) for x in np.linspace(first, n - size, n_splits)})
    splits = F.explode(F.array(*[F.struct(F.lit(i).alias("split"), F.lit(e).alias("end")) for i, e in enumerate(ends)]))
    each = placed.select("place", "rows", splits.alias("e")).select("place", "rows", "e.*")
    train, valid = F.col("place") < F.col("end"), (F.col("place") >= F.col("end")) & (F.col("place") < F.col("end") + size)
    return each.groupBy("split", "end").agg(F.sum(train.cast("long")).alias("train_groups"), F.sum(valid.cast("long")).alias("valid_groups"), F.sum(F.when(train, F.col("rows")).otherwise(0)).alias("train_rows"), F.sum(F.when(valid, F.col("rows")).otherwise(0)).alias("valid_rows"))


def last_weeks(df: DataFrame, weeks: int) -> DataFrame:
    """``df`` with ``holdout``: 1 in the last ``weeks`` distinct weeks."""
    first = df.select("week").distinct().orderBy(F.col("week").desc()).limit(weeks).agg(F.min("week").alias("__from"))
    return df.crossJoin(F.broadcast(first)).withColumn("holdout", (F.col("week") >= F.col("__from")).cast("int")).drop("__from")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Content of a table whatever its order: rows, and twelve hex digits of a hash of sums of row hashes."""
    h = F.xxhash64(*columns)
    s = df.agg(F.count("*").alias("n_rows"), F.sum((F.pmod(h, F.lit(1 << 31))).cast("decimal(38,0)")).alias("a"), F.sum(F.shiftrightunsigned(h, 33).cast("decimal(38,0)")).alias("b"))
    return s.select("n_rows", F.substring(F.sha2(F.concat_ws("/", "n_rows", "a", "b"), 256), 1, 12).alias("fingerprint"))
