"""Least squares with product and week effects, solved to a tolerance, with the effects themselves and predictions.

Products are eliminated exactly, and the weeks' equations are solved by conjugate gradients for all columns together. A product
is one row of its weeks' counts and its sums, so that a step is one pass whose tasks hand on a matrix of weeks x columns. The
driver holds such matrices: weeks are bounded by the calendar, columns by the model. Product effects stay a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.operators.features import CONTROLS
from tercet.session import ship_library, written_step

Y, T = "log_qty", "log_price"


def _product_sums(products: DataFrame, part, size: int) -> np.ndarray:
    """Sums over products of ``part`` (week numbers, counts, product sums, rows) to an array of ``size``."""

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for weeks, n, s, rows in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                part(total, np.array(weeks), np.array(n, float), np.array(s, float), float(rows))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["slot", "value"])

    out = np.zeros(size)
    held = products.select("weeks", "n", "s", "rows").mapInArrow(add, "slot long, value double")
    for r in held.groupBy("slot").agg(F.sum("value").alias("value")).collect():  # weeks x columns, or columns squared
        out[r.slot] = r.value
    return out


@dataclass(frozen=True)
class TwoWay:
    """``effects``: a row a product (``stock_code``, ``product_effect``); ``weeks``: a row a week (``week``, ``week_effect``), of mean zero over rows."""

    kept: list[str]
    dropped: list[str]
    beta: dict[str, float]
    means: dict[str, float]
    grand: float
    recent: float
    effects: DataFrame
    weeks: DataFrame
    passes: int

    @property
    def elasticity(self) -> float:
        return -self.beta[T]

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """An unseen product has effect 0, an unseen week the mean of the last four weeks."""
        index = sum(((F.col(c) - self.means[c]) * b for c, b in self.beta.items()), F.lit(self.grand))
        held = df.join(self.effects, "stock_code", "left").join(self.weeks, "week", "left")
        return held.withColumn(name, index + F.coalesce("product_effect", F.lit(0.0)) + F.coalesce("week_effect", F.lit(self.recent))).drop("product_effect", "week_effect")


def two_way(df: DataFrame, controls: list[str] | None = None, collinear: float = 0.02, tolerance: float = 1e-10, most: float = 1000) -> TwoWay:
    """Log quantity on log price and ``controls`` (the features' own by default) beside both effects. A control whose spread within
    product and week is at most ``collinear`` of its whole spread is dropped. Rows with a null are left out; an empty table raises."""
    spark = df.sparkSession
    ship_library(spark)
    columns = [Y, T, *(CONTROLS if controls is None else controls)]
    k = len(columns)
    asked = df.select("stock_code", "week", *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    cells, _ = written_step(asked.groupBy("stock_code", "week").agg(F.count("*").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]), "cells")
    by_week = sorted(cells.groupBy("week").agg(F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).collect(), key=lambda r: r.week)  # a row a week
    if not by_week:
        raise ValueError("no rows without a null")
    size, n = len(by_week), np.array([r.n for r in by_week], float)
    sums = np.array([[r[f"c{i}"] for i in range(k)] for r in by_week])
    mean = sums.sum(0) / n.sum()
    sums = sums - n[:, None] * mean
    numbered = spark.createDataFrame([(r.week, i) for i, r in enumerate(by_week)], "week " + dict(df.dtypes)["week"] + ", number int")
    grouped = cells.join(numbered, "week").groupBy("stock_code").agg(F.collect_list(F.struct("number", F.col("n").cast("double").alias("n"))).alias("w"), F.sum("n").cast("double").alias("rows"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)])
    products, _ = written_step(grouped.select("stock_code", F.col("w.number").alias("weeks"), F.col("w.n").alias("n"), F.array(*[F.col(f"c{i}") - F.col("rows") * float(mean[i]) for i in range(k)]).alias("s"), "rows"), "products")

    def spread(total, weeks, counts, s, rows):
        total.reshape(size, k)[weeks] += counts[:, None] * (s / rows)

    passes = 1
    right = sums - _product_sums(products, spread, size * k).reshape(size, k)
    g, rest = np.zeros((size, k)), right.copy()
    z = rest / n[:, None]
    way, rz = z.copy(), (rest * z).sum(0)
    first = np.maximum((sums * sums / n[:, None]).sum(0), 1e-300)
    while (rz > tolerance**2 * first).any() and passes < most:
        now = way

        def step(total, weeks, counts, s, rows, now=now):
            total.reshape(size, k)[weeks] += counts[:, None] * (counts @ now[weeks] / rows)

        at = n[:, None] * way - _product_sums(products, step, size * k).reshape(size, k)
        passes += 1
        bent = (way * at).sum(0)
        move = np.where((bent > 0) & (rz > tolerance**2 * first), rz / np.where(bent > 0, bent, 1), 0.0)
        g, rest = g + move * way, rest - move * at
        z = rest / n[:, None]
        fresh = (rest * z).sum(0)
        way = z + np.where(rz > 0, fresh / np.where(rz > 0, rz, 1), 0.0) * way
        rz = np.where(move > 0, fresh, 0.0)
    g -= (n @ g) / n.sum()

    def explained(total, weeks, counts, s, rows):
        total += np.outer((s - counts @ g[weeks]) / rows, s).ravel()

    by_product = _product_sums(products, explained, k * k).reshape(k, k)
    whole = asked.agg(*[F.sum((F.col(f"c{i}") - float(mean[i])) * (F.col(f"c{j}") - float(mean[j]))).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    gram = np.array([[whole[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    within = gram - by_product - g.T @ sums
    within = (within + within.T) / 2
    kept = [i for i in range(1, k) if i == 1 or within[i, i] > collinear**2 * max(gram[i, i], 1e-24 * n.sum())]
    scale = np.sqrt(np.maximum(np.diag(within)[kept], 1e-300))
    beta = np.linalg.pinv(within[np.ix_(kept, kept)] / np.outer(scale, scale), rcond=1e-10, hermitian=True) @ (within[kept, 0] / scale) / scale
    mix = np.zeros(k)
    mix[0], mix[kept] = 1.0, -beta
    week_effect = g @ mix

    def product_effects(batches):
        for batch in batches:
            names, weeks, counts, s, rows = (c.to_pylist() for c in batch.columns)
            found = [(np.array(b) @ mix - np.array(c, float) @ week_effect[np.array(w)]) / r for w, c, b, r in zip(weeks, counts, s, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["stock_code", "product_effect"])

    effects = products.select("stock_code", "weeks", "n", "s", "rows").mapInArrow(product_effects, f"stock_code {dict(df.dtypes)['stock_code']}, product_effect double")
    weeks = spark.createDataFrame([(r.week, float(e)) for r, e in zip(by_week, week_effect, strict=True)], "week " + dict(df.dtypes)["week"] + ", week_effect double")
    names = [columns[i] for i in kept]
    return TwoWay(names, [c for c in columns[1:] if c not in names], dict(zip(names, beta.tolist(), strict=True)), {columns[i]: float(mean[i]) for i in kept}, float(mean[0]), float(week_effect[-4:].mean()), effects, weeks, passes)
