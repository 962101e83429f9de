"""Two-way effects against dummy regression; stacked ratios against a grid."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tercet.operators import effects as ef
from tercet.operators import stacking as st


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(8)
    cells = [(f"p{p}", w) for p in range(7) for w in range(12) if rng.random() < 0.6]
    d = pd.DataFrame(cells, columns=["stock_code", "week"])
    d["log_price"], d["x"] = rng.normal(size=len(d)), rng.normal(size=len(d))
    d["season"] = np.sin(d.week)
    d["log_qty"] = -1.7 * d.log_price + 0.4 * d.x + d.week * 0.1 + d.stock_code.str[1:].astype(int) * 0.3 + rng.normal(0, 0.2, len(d))
    return d


def test_two_way_is_dummy_regression(spark, panel):
    fit = ef.two_way(spark.createDataFrame(panel), ["x", "season"])
    assert fit.dropped == ["season"] and fit.kept == ["log_price", "x"]
    dummies = pd.get_dummies(panel[["stock_code", "week"]].astype(str)).to_numpy(float)
    x = np.column_stack([panel[["log_price", "x"]].to_numpy(), dummies])
    beta, *_ = np.linalg.lstsq(x, panel.log_qty.to_numpy(), rcond=None)
    assert np.allclose([fit.beta["log_price"], fit.beta["x"]], beta[:2], atol=1e-8)
    got = fit.predict(spark.createDataFrame(panel)).toPandas().sort_values(["stock_code", "week"])
    assert np.allclose(got.predicted, (x @ beta)[got.merge(panel.reset_index(), on=["stock_code", "week"])["index"]], atol=1e-7)


def test_two_way_odd_rows(spark, panel):
    df = spark.createDataFrame(panel)
    odd = df.unionByName(df.limit(1).withColumn("x", F.lit(None).cast("double")))
    fit = ef.two_way(odd, ["x"])
    assert math.isclose(fit.elasticity, ef.two_way(df, ["x"]).elasticity, abs_tol=1e-9)
    new = df.limit(1).withColumns({"stock_code": F.lit("other"), "week": F.lit(99).cast("long")})
    row = fit.predict(new).first()
    assert math.isclose(row.predicted, fit.grand + fit.recent + sum(b * (row[c] - fit.means[c]) for c, b in fit.beta.items()))
    with pytest.raises(ValueError):
        ef.two_way(df.filter("week < 0"), ["x"])


def test_stack_gradient():
    rng = np.random.default_rng(9)
    v = np.column_stack([rng.normal(size=(30, 2)), rng.integers(0, 2, 30), rng.normal(size=30), rng.random(30)])
    for direction in ("none", "high", "low"):
        loss, p = st.stack_loss(2, direction, 0.01), np.array([0.3, -0.2, 0.05, -1.0])
        wanted = [(loss(p + s, v)[0] - loss(p - s, v)[0]) / 2e-6 for s in np.eye(4) * 1e-6]
        assert np.allclose(loss(p, v)[1], wanted, atol=1e-6)


def test_stack_weighs_the_true_model(spark):
    """The true ratio beside noise: its weight and the slope, against a search over a grid."""
    rng = np.random.default_rng(10)
    n = 3000
    true, noise, offset = rng.normal(size=n), rng.normal(size=n), np.log(np.where(rng.random(n) < 0.5, 0.5, 1.0))
    y = rng.random(n) < 1 / (1 + np.exp(-(offset + true)))
    df = spark.createDataFrame(pd.DataFrame({"a": true, "b": noise, "y": y.astype(int), "o": offset}))
    found = st.stack(df, [F.col("a"), F.col("b")], F.col("y"), F.col("o"))
    best = math.inf
    for w in np.linspace(0, 1, 41):
        mixed = w * (true - true.mean()) + (1 - w) * (noise - noise.mean())
        for a in np.linspace(found.intercept - 0.2, found.intercept + 0.2, 9):
            for s in np.linspace(0.2, 2, 37):
                eta = offset + a + s * mixed
                best = min(best, (np.logaddexp(0, eta) - y * eta).mean() + 1e-4 * ((w - 0.5) ** 2 + (0.5 - w) ** 2))
    assert found.nll <= best + 1e-6 and found.weights[0] > 0.9 and abs(found.slope - 1) < 0.2
    read = df.select(found.log_rr([F.col("a"), F.col("b")])).toPandas().to_numpy()[:, 0]
    assert abs(np.corrcoef(read, true)[0, 1]) > 0.98


def test_crossfit_leaves_the_group_out(spark):
    """Turning one group's outcomes moves no raw ratio of that group."""
    rng = np.random.default_rng(11)
    n = 400
    d = pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 20, n), "x": rng.normal(size=n), "arm": np.where(rng.random(n) < 0.4, "H", "C"), "purchase": 1, "pi_H": 0.4, "pi_C": 0.4, "pi_L": 0.2})
    turned = d.assign(arm=np.where(d.g == 3, np.where(d.arm == "H", "C", "H"), d.arm))
    options = {"folds": 3, "rounds": 2, "depth": 2}
    before, after = (st.crossfit_pair(spark.createDataFrame(t), ["x"], "H", "g", F.col("id"), **options)[0].orderBy("id").toPandas() for t in (d, turned))
    own = before.fold == before.fold[before.g == 3].iloc[0]
    assert np.allclose(before.raw[own], after.raw[own]) and not np.allclose(before.raw[~own], after.raw[~own])
    assert (before.calibrated <= 0).all() and len(before) == n


def test_boosted_residuals_leave_the_fold_out(spark):
    """Quantities moved in one fold move no prediction there; the elasticity is the planted one where price follows a control."""
    from tercet.operators import demand as de

    rng = np.random.default_rng(12)
    n = 3000
    d = pd.DataFrame({"stock_code": rng.integers(0, 30, n).astype(str), "week": np.arange(n), "x": rng.integers(0, 5, n).astype(float)})
    d["log_price"] = np.where(d.x > 2, 1.0, 0.0) + rng.normal(0, 0.3, n)
    d["log_qty"] = -1.5 * d.log_price + 2.0 * (d.x > 2) + rng.normal(0, 0.1, n)
    df = spark.createDataFrame(d)
    options = {"k": 3, "controls": ["x"], "rounds": 5, "depth": 2, "rate": 0.7}
    held = de.boosted_residuals(df, **options)
    assert abs(-de.theta(held).first().theta - 1.5) < 0.05
    before = held.withColumn("m", F.col("log_qty") - F.col("ry")).withColumn("f", de.fold_of(F.col("stock_code"), 3, "0")).orderBy("week").toPandas()
    moved = df.withColumn("log_qty", F.col("log_qty") + F.when(de.fold_of(F.col("stock_code"), 3, "0") == 1, 5.0).otherwise(0.0))
    after = de.boosted_residuals(moved, **options).withColumn("m", F.col("log_qty") - F.col("ry")).orderBy("week").toPandas()
    own = (before.f == 1).to_numpy()
    assert np.allclose(before.m[own], after.m[own]) and not np.allclose(before.m[~own], after.m[~own])


def test_compared_is_each_models_loss(spark):
    from tercet.operators import demand as de

    rng = np.random.default_rng(13)
    d = pd.DataFrame(rng.normal(size=(50, 4)), columns=["ry", "rt", "a", "b"])
    df = spark.createDataFrame(d).unionByName(spark.createDataFrame([(1.0, None, 2.0, 3.0)], "ry double, rt double, a double, b double"))
    got = {r.model: r for r in de.compared(df, ["a", "b"]).collect()}
    for m in "ab":
        loss = ((d.ry + d[m] * d.rt) ** 2).mean()
        constant = ((d.ry - d.rt * (d.ry @ d.rt) / (d.rt @ d.rt)) ** 2).mean()
        assert got[m].n == 50 and np.allclose([got[m].r_loss, got[m].constant_loss, got[m].skill], [loss, constant, 1 - loss / constant])
