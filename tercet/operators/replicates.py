"""Bootstrap intervals, paired differences and permutation tests of an ordinal volume, all replicates in one pass.

Rows are counted by class and distinct value (for a pair of markers, by both values). The weights of such a cell in all replicates come
from a generator keyed by its values and a seed, inside the task that reads it: Poisson numbers of its counts for a bootstrap of rows
within classes, numbers of random labels in the classes' shares for a test. So a cell weighs the same wherever it is read again, by
another marker or after a lost task. Cells are put in buckets of a marker's values; a task runs through one bucket in order and
hands on six sums a replicate, from which the volume of every replicate follows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tercet.operators.ordering import bucketed
from tercet.session import ship_library

#: Values that a task weighs at once.
CHUNK = 512


def cell_weights(key: int, counts: np.ndarray, replicates: int, seed: int, shares: np.ndarray | None) -> np.ndarray:
    """Weights (classes, 1 + replicates) of a cell; the first column has its own counts."""
    dice = np.random.Generator(np.random.Philox(key=[key & (2**64 - 1), seed]))
    if shares is None:
        drawn = dice.poisson(counts, (replicates, len(counts)))
    else:
        drawn = dice.multinomial(int(counts.sum()), shares, replicates)
    return np.concatenate((counts[None], drawn)).T.astype(float)


def replicate_volumes(sample: DataFrame, markers: list[str], classes: tuple[int, int, int] = (0, 1, 2), replicates: int = 200, seed: int = 0, permute: bool = False) -> dict[str, np.ndarray]:
    """P(marker rises over the three classes), half credit for ties, of the sample itself and of every replicate. Rows without one of the
    markers take no part."""
    ship_library(sample.sparkSession)
    held = sample.filter(F.col("y").isin(*classes)).select("y", *[F.col(m).cast("double").alias(m) for m in markers]).na.drop()
    own = [F.sum((F.col("y") == c).cast("long")).alias(f"n{k}") for k, c in enumerate(classes)]
    cells = held.groupBy(*markers).agg(*own).withColumn("key", F.xxhash64(*markers))
    shares = None
    if permute:
        sizes = np.array(list(held.agg(*own).first()), float)
        shares = sizes / sizes.sum()

    def sums_by(m: str):
        def sums(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values([m, "key"], kind="stable")
            value, key, n = part[m].to_numpy(), part["key"].to_numpy(), part[["n0", "n1", "n2"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            ends = np.r_[starts[1:], len(value)]
            total = np.zeros((6, replicates + 1))  # a, b, c, b la, b pc, b la pc
            for low in range(0, len(starts), CHUNK):
                s, e = starts[low : low + CHUNK], ends[low : low + CHUNK]
                w = np.stack([sum(cell_weights(int(key[i]), n[i], replicates, seed, shares) for i in range(a, b)) for a, b in zip(s.tolist(), e.tolist(), strict=True)])
                a, b, c = w[:, 0], w[:, 1], w[:, 2]
                la = total[0] + a.cumsum(axis=0) - a / 2
                pc = total[2] + c.cumsum(axis=0) - c / 2
                total += np.stack([a.sum(axis=0), b.sum(axis=0), c.sum(axis=0), (b * la).sum(axis=0), (b * pc).sum(axis=0), (b * la * pc).sum(axis=0)])
            return pd.DataFrame({"bucket": [int(part["__b"].iloc[0])], "sums": [total.tobytes()]})

        return sums

    out = {}
    for m in markers:
        rows = bucketed(cells, m).select("__b", m, "key", "n0", "n1", "n2").groupBy("__b").applyInPandas(sums_by(m), "bucket int, sums binary").collect()  # a row a bucket
        parts = [np.frombuffer(r.sums).reshape(6, -1) for r in sorted(rows, key=lambda r: r.bucket)]
        every = sum(p[:3] for p in parts) if parts else np.zeros((3, replicates + 1))
        before, volume = np.zeros((2, replicates + 1)), np.zeros(replicates + 1)
        for p in parts:
            after = every[2] - before[1]
            volume += before[0] * after * p[1] + after * p[3] - before[0] * p[4] - p[5]
            before += p[[0, 2]]
        with np.errstate(invalid="ignore", divide="ignore"):
            out[m] = volume / (every[0] * every[1] * every[2])
    return out


def _interval(x: np.ndarray, alpha: float) -> list[float]:
    drawn = x[1:][np.isfinite(x[1:])]
    low, high = np.quantile(drawn, [alpha / 2, 1 - alpha / 2])
    return [float(x[0]), float(drawn.mean()), float(drawn.std(ddof=1)), float(low), float(high)]


def bootstrap_volume(sample: DataFrame, markers: list[str], classes: tuple[int, int, int] = (0, 1, 2), replicates: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Each marker's volume, and the difference of the first two on the same resampled rows: name, estimate, mean, se, lower, upper."""
    found = replicate_volumes(sample, markers, classes, replicates, seed)
    rows = [(m, *_interval(found[m], alpha)) for m in markers]
    if len(markers) > 1:
        rows.append((f"{markers[0]} - {markers[1]}", *_interval(found[markers[0]] - found[markers[1]], alpha)))
    return sample.sparkSession.createDataFrame(rows, "name string, estimate double, mean double, se double, lower double, upper double")


def permutation_test(sample: DataFrame, marker: str, classes: tuple[int, int, int] = (0, 1, 2), replicates: int = 500, seed: int = 0) -> DataFrame:
    """Whether a marker's volume exceeds that of random labels: observed, null_mean, null_sd, p_value (one-sided, 1 / (1 + replicates) at least)."""
    x = replicate_volumes(sample, [marker], classes, replicates, seed, permute=True)[marker]
    null = x[1:][np.isfinite(x[1:])]
    row = (float(x[0]), float(null.mean()), float(null.std(ddof=1)), (1 + int((null >= x[0]).sum())) / (1 + len(null)))
    return sample.sparkSession.createDataFrame([row], "observed double, null_mean double, null_sd double, p_value double")
