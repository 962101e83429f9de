"""Volumes of many classes and logistic conversion, against direct computations."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tercet.operators import logits as lo
from tercet.operators import manifold as ma
from tercet.operators import ranking as ra
from tercet.operators import trios as tr


def test_credit_of_many_classes_is_that_of_all_assignments(monkeypatch):
    rng = np.random.default_rng(12)
    s = rng.normal(size=(200, 5, 5)) + 2 * np.eye(5)
    wanted = [float(max(itertools.permutations(range(5)), key=lambda p: sum(t[i, j] for i, j in enumerate(p))) == tuple(range(5))) for t in s]
    assert ma.credit(s).tolist() == wanted
    monkeypatch.setattr(ma, "ENUMERATED", 4)
    assert ma.credit(s).tolist() == wanted
    monkeypatch.undo()
    assert np.allclose(ma.credit(np.zeros((3, 4, 4))), 1 / 24)


def sample_of(rng, n, classes):
    y = rng.integers(0, classes, n)
    s = np.exp(rng.normal(size=(n, classes)) + 1.5 * np.eye(classes)[y])
    return pd.DataFrame({"row_id": np.arange(n), "y": y, **{f"p{k}": s[:, k] for k in range(classes)}})


def test_hum_is_the_auc_and_the_three_way_volume(spark):
    d = sample_of(np.random.default_rng(13), 3000, 3)
    df = spark.createDataFrame(d)
    got, wanted = ma.hum(df, ra.P, "row_id").first(), tr.exact_volume(df).first().vus
    assert abs(got.hum - wanted) < 5 * got.stderr and got.n_classes == 3 and got.stderr < 0.02
    two = sample_of(np.random.default_rng(14), 2000, 2)
    score = np.log(two.p1 / two.p0).to_numpy()
    auc = (score[two.y == 1][:, None] > score[two.y == 0][None, :]).mean()
    got = ma.hum(spark.createDataFrame(two), ["p0", "p1"], "row_id").first()
    assert abs(got.hum - auc) < 5 * got.stderr


def test_hum_odd_rows(spark):
    d = sample_of(np.random.default_rng(15), 90, 3)
    df = spark.createDataFrame(d).withColumns({"p1": F.when(F.col("row_id") % 5 > 0, F.col("p1")), "y": F.when(F.col("row_id") % 7 > 0, F.col("y"))})
    assert ma.hum(df, ra.P, "row_id").first().n_samples > 0
    none = ma.hum(df.filter("y <> 2"), ra.P, "row_id").first()
    assert none.hum is None and none.n_samples == 0


def test_splines_sum_to_one_with_the_last():
    x = np.linspace(-1, 3, 50)
    b = lo.spline_basis(x, 0.0, 2.0, 5)
    assert b.shape == (50, 6) and (b >= -1e-12).all() and (b.sum(1) <= 1 + 1e-12).all() and np.allclose(b[(x < 1)].sum(1), 1)
    assert np.allclose(b[x <= 0], b[x <= 0][0])


@pytest.fixture(scope="module")
def quotes():
    rng = np.random.default_rng(16)
    n = 4000
    x, z, lp = rng.normal(size=n), rng.normal(size=n), np.log(rng.choice([0.9, 1.0, 1.1], n)) + rng.normal(0, 0.3, n)
    eta = 0.3 + 0.5 * x - (3 + 1.0 * z) * lp
    return pd.DataFrame({"x": x, "z": z, "lp": lp, "y": (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)})


def newton(x, y, ridge):
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return w


def test_logit_is_newtons(spark, quotes):
    fit = lo.logit(spark.createDataFrame(quotes), ["x", "z"], "lp", "y")
    raw = quotes[["x", "z", "lp"]].to_numpy()
    sd = raw.std(0)
    w = newton(np.column_stack([np.ones(len(raw)), (raw - raw.mean(0)) / sd]), quotes.y.to_numpy(), np.array([0.0, 1, 1, 1]))
    assert np.allclose(fit.weights, w[1:] / sd, atol=2e-3)
    out = fit.applied(spark.createDataFrame(quotes)).toPandas()
    assert np.allclose(out.elasticity, -fit.weights[-1] * (1 - out.conversion))


def test_slopes_vary_and_nulls_stay(spark, quotes):
    df = spark.createDataFrame(quotes)
    fit = lo.logit(df, ["x", "z"], "lp", "y", curved=("x",), varying=("z",))
    assert abs(fit.weights[-1] + quotes.z.std(ddof=0)) < 0.3 and len(fit.weights) == 2 + 6 + 1 + 1
    odd = fit.applied(df.limit(1).withColumn("x", F.lit(None).cast("double"))).first()
    assert odd.conversion is None and odd.elasticity is None
