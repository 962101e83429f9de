"""Replicates in one pass against a loop over the same weights."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tercet.operators import replicates as rp


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(6)
    return [(i, i % 3, round(dice.gauss(0.8 * (i % 3), 1), 1), round(dice.gauss(0.2 * (i % 3), 1), 0)) for i in range(240)]


@pytest.fixture(scope="module")
def sample(spark, rows):
    return spark.createDataFrame([*rows, (900, 1, None, 0.0)], "row_id long, y int, m double, k double").repartition(3)


def direct(cells, weights, column):
    """Volume by a loop over distinct values, from weighted cells."""
    by = {}
    for cell, w in zip(cells, weights, strict=True):
        by[cell[column]] = by.get(cell[column], 0) + w
    values = sorted(by)
    a, b, c = (np.array([by[v][k] for v in values]) for k in range(3))
    right = sum(b[j] * (a[:j].sum() + a[j] / 2) * (c[j + 1 :].sum() + c[j] / 2) for j in range(len(values)))
    return right / (a.sum() * b.sum() * c.sum())


@pytest.mark.parametrize("permute", [False, True])
def test_replicates_equal_a_loop(sample, permute):
    found = rp.replicate_volumes(sample, ["m", "k"], replicates=12, seed=4, permute=permute)
    held = sample.na.drop().groupBy("m", "k").agg(*[F.sum((F.col("y") == c).cast("long")).alias(f"n{c}") for c in range(3)]).withColumn("h", F.xxhash64("m", "k")).collect()
    counts = [np.array([r.n0, r.n1, r.n2]) for r in held]
    shares = sum(counts) / sum(counts).sum() if permute else None
    weights = [rp.cell_weights(r.h, n, 12, 4, shares) for r, n in zip(held, counts, strict=True)]
    for m in ("m", "k"):
        for rep in range(13):
            assert found[m][rep] == pytest.approx(direct([{"m": r.m, "k": r.k} for r in held], [w[:, rep] for w in weights], m), rel=1e-9)


def test_interval_and_difference(sample, rows):
    got = {r.name: r for r in rp.bootstrap_volume(sample, ["m", "k"], replicates=300, seed=1).collect()}
    # resampling rows within classes, one by one
    dice = np.random.default_rng(3)
    own = {c: np.array([r[2:] for r in rows if r[1] == c]) for c in range(3)}
    draws = []
    for _ in range(300):
        x, y, z = (own[c][dice.integers(0, len(own[c]), len(own[c]))] for c in range(3))
        each = []
        for k in (0, 1):
            left = (x[:, k][:, None] < y[:, k]).mean(0) + (x[:, k][:, None] == y[:, k]).mean(0) / 2
            right = (z[:, k][:, None] > y[:, k]).mean(0) + (z[:, k][:, None] == y[:, k]).mean(0) / 2
            each.append((left * right).mean())
        draws.append((*each, each[0] - each[1]))
    draws = np.array(draws)
    for name, d in zip(("m", "k", "m - k"), draws.T, strict=True):
        assert got[name].se == pytest.approx(d.std(ddof=1), rel=0.25)
        assert got[name].lower < got[name].estimate < got[name].upper
        assert abs(got[name].mean - d.mean()) < 4 * d.std() / 10
    assert got["m - k"].estimate == pytest.approx(got["m"].estimate - got["k"].estimate)


def test_permutation(sample):
    strong, weak = (rp.permutation_test(sample, m, replicates=200).first() for m in ("m", "k"))
    assert strong.p_value == pytest.approx(1 / 201) and strong.null_mean == pytest.approx(1 / 6, abs=0.02)
    assert weak.p_value < 0.05 and weak.null_mean < weak.observed < strong.observed
    noise = sample.withColumn("r", (F.pmod(F.xxhash64("row_id"), F.lit(97))).cast("double"))
    assert rp.permutation_test(noise, "r", replicates=200).first().p_value > 0.01
