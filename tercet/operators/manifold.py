"""Volume under the manifold for any number of classes, from seeded tuples of one row a class."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.operators.ranking import FLOOR
from tercet.session import ship_library

#: Up to this many classes every assignment is summed; beyond, the right one is tested against cycles of exchanges.
ENUMERATED = 7


def credit(scores: np.ndarray) -> np.ndarray:
    """How far the right assignment wins in each tuple; ``scores``: tuples x rows x classes, row k being of class k.

    Up to ENUMERATED classes best assignments share the credit. Beyond, the right one is among the best exactly if no cycle of
    exchanges gains (shortest paths over all classes at once), and gets the whole credit.
    """
    n, c = scores.shape[:2]
    rows = np.arange(c)
    if c <= ENUMERATED:
        own, best, ties = scores[:, rows, rows].sum(1), np.full(n, -np.inf), np.zeros(n)
        for p in itertools.permutations(range(c)):
            total = scores[:, rows, p].sum(1)
            ties = np.where(total > best + 1e-9, 1, ties + (np.abs(total - best) <= 1e-9))
            best = np.maximum(best, total)
        return np.where(own >= best - 1e-9, 1 / ties, 0.0)
    loss = scores[:, rows, rows][:, :, None] - scores  # what row i loses by taking class j
    for k in range(c):
        loss = np.minimum(loss, loss[:, :, k, None] + loss[:, None, k, :])
    return (loss[:, rows, rows] >= -1e-9).all(1).astype(float)


def sampled_tuples(sample: DataFrame, p: list[str], key: str, y: str = "y", repeats: int = 4, seed: int = 23) -> DataFrame:
    """One row of every class, by parts of a seeded hash: each repeat deals all rows to as many parts as the rarest class has rows, and
    a part's row of a class is the one of least hash. Parts without some class give none. Columns k0.. hold log scores."""
    total = sum((F.col(c) for c in p[1:]), F.col(p[0]))
    logs = sample.filter(F.col(y).isin(*range(len(p))) & total.isNotNull()).select(F.col(y).alias("y"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.array(*[F.ln(F.greatest(F.col(c) / total, F.lit(FLOOR))) for c in p]).alias("s"))
    counts = {r.y: r["count"] for r in logs.groupBy("y").count().collect()}  # a row a class
    parts = max(1, min(counts.values(), default=1))
    dealt = logs.select("y", "s", "h", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")).withColumn("part", F.pmod(F.xxhash64("h", "repeat"), F.lit(parts)))
    first = dealt.groupBy("repeat", "part").agg(*[F.min_by("s", F.when(F.col("y") == k, F.xxhash64("h", "repeat", F.lit("place")))).alias(f"k{k}") for k in range(len(p))])
    return first.na.drop()


def _factorial_share(classes: int) -> float:
    return 1.0 / math.factorial(classes)


def hum(sample: DataFrame, p: list[str], key: str, **options) -> DataFrame:
    """The share of tuples (one row a class) whose right assignment has the largest sum of log scores: hum, chance, hum_adjusted, stderr,
    n_classes, n_samples. At two classes it is the AUC, at three the three-way volume. Null where some class has no rows. The error is
    that of independent tuples; repeats share rows."""
    ship_library(sample.sparkSession)
    c = len(p)

    @F.pandas_udf("double")
    def won(*rows: pd.Series) -> pd.Series:
        return pd.Series(credit(np.stack([np.stack(r.to_numpy()) for r in rows], axis=1)) if len(rows[0]) else np.zeros(0))

    found = sampled_tuples(sample, p, key, **options).select(won(*[f"k{k}" for k in range(c)]).alias("credit"))
    chance: Column = F.lit(_factorial_share(c))
    s = found.agg(F.avg("credit").alias("hum"), F.stddev_samp("credit").alias("sd"), F.count("*").alias("n_samples"))
    return s.select("hum", chance.alias("chance"), ((F.col("hum") - chance) / (1 - chance)).alias("hum_adjusted"), (F.col("sd") / F.sqrt("n_samples")).alias("stderr"), F.lit(c).alias("n_classes"), "n_samples")
