"""Histogram trees, own-loss fits and the learners on them, against direct computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tercet.operators import boosting as bo
from tercet.operators import fitting as fi
from tercet.operators import learners as le

Z = [math.log(1.1), 0.0, math.log(0.9)]


@pytest.fixture(scope="module")
def steps(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 6, 600).astype(float), rng.integers(0, 4, 600).astype(float)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(600), "a": a, "b": b, "y": 2.0 * (a > 2) - 1.0 * (b > 0) + rng.normal(0, 0.1, 600)}))


def best_cut(x, y, reg, least):
    """Every cut of every column tried: (gain, column, edge)."""
    found = []
    for f in range(x.shape[1]):
        for e in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= e
            if min(left.sum(), (~left).sum()) >= least:
                found.append((sum(0.5 * y[s].sum() ** 2 / (s.sum() + reg) for s in (left, ~left)), -f, -e))
    return max(found)


def test_first_cuts_are_the_best(steps):
    model = bo.boost(steps, ["a", "b"], bo.squared, [F.col("y")], [0.0], rounds=1, depth=2, rate=1.0, reg=1.0, min_rows=5)
    d, tree = steps.toPandas(), model.rounds[0][0]
    x, y = d[["a", "b"]].to_numpy(), d.y.to_numpy()
    nodes = {0: np.ones(len(y), bool)}
    for node in (0, 1, 2):
        at = nodes[node]
        _, f, e = best_cut(x[at], y[at], 1.0, 5)
        assert tree.column[node] == -f and model.edges[-f][tree.cut[node] - 1] == -e
        nodes[2 * node + 1], nodes[2 * node + 2] = at & (x[:, -f] <= -e), at & (x[:, -f] > -e)
    got = steps.select(model.predict()[0]).toPandas().to_numpy()[:, 0]
    for leaf in (3, 4, 5, 6):
        assert np.allclose(got[nodes[leaf]], y[nodes[leaf]].sum() / (nodes[leaf].sum() + 1))


def test_long_fits_write_margins_anew(steps):
    model = bo.boost(steps, ["a", "b"], bo.squared, [F.col("y")], [0.0], rounds=12, depth=2, rate=0.5, subsample=0.8, key=F.col("id"))
    d = steps.withColumn("p", model.predict()[0]).toPandas()
    assert ((d.y - d.p) ** 2).mean() < 0.02
    again = bo.boost(steps.repartition(3), ["a", "b"], bo.squared, [F.col("y")], [0.0], rounds=12, depth=2, rate=0.5, subsample=0.8, key=F.col("id"))
    assert np.allclose(steps.withColumn("p", again.predict()[0]).toPandas().p, d.p)


def test_odd_rows(spark):
    rows = [(1, None, 1.0), (2, 2.0, None), (3, float("nan"), 1.0), (4, 4.0, 0.0), (5, 5.0, 0.0), (6, 6.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    model = bo.boost(df, ["x"], bo.squared, [F.col("y")], [0.0], rounds=1, depth=1, rate=1.0, reg=0.0, min_rows=1, min_weight=0.5)
    assert [r[0] for r in df.orderBy("id").select(model.predict()[0]).collect()] == [1, 0, 1, 0, 0, 0]
    empty = bo.boost(df.filter("id < 0"), ["x"], bo.squared, [F.col("y")], [3.0], rounds=2)
    assert {r[0] for r in df.select(empty.predict()[0]).collect()} == {3.0}


def test_forest_finds_a_step(steps):
    model = bo.forest(steps, ["a", "b"], F.col("y"), key=F.col("id"), trees=10, depth=4)
    d = steps.withColumn("p", model.predict()[0]).toPandas()
    assert np.corrcoef(d.y, d.p)[0, 1] > 0.95


@pytest.fixture(scope="module")
def buyers(spark):
    """Buyers drawn at elasticity 1 (x = 0) and 6 (x = 1), with two allocations."""
    rng = np.random.default_rng(2)
    n = 12000
    x = rng.integers(0, 2, n)
    pi = np.where(rng.random(n)[:, None] < 0.5, [0.2, 0.6, 0.2], [0.3, 0.4, 0.3])
    share = bo.class_shares(np.log(pi) - np.where(x, 6.0, 1.0)[:, None] * np.array(Z))
    arm = (rng.random(n)[:, None] > share.cumsum(1)).sum(1)
    frame = pd.DataFrame({"id": np.arange(n), "x": x.astype(float), "arm": np.array(le.ARMS)[arm], "purchase": 1, "pi_H": pi[:, 0], "pi_C": pi[:, 1], "pi_L": pi[:, 2]})
    return spark.createDataFrame(frame)


def by_x(df, column):
    return dict(df.groupBy("x").agg(F.avg(column)).collect())


def test_offset_without_columns_of_use(buyers):
    """A constant column leaves the best constant beside the offset."""
    d = buyers.withColumn("one", F.lit(1.0))
    model = le.offset_pair(d, ["one"], "H", F.col("id"), rounds=3, depth=2)
    p = d.filter("arm <> 'L'").toPandas()
    y, o = (p.arm == "H").to_numpy(), np.log(p.pi_H / p.pi_C).to_numpy()
    got = d.select(model.predict()[0]).first()[0]
    assert abs((y - 1 / (1 + np.exp(-(o + got)))).sum()) < 1e-3 * len(y)


def test_pairs_arms_and_scalar(buyers):
    options = {"rounds": 8, "depth": 1, "rate": 0.5}
    for model in (le.offset_pair, le.inverse_weighted_pair):
        found = by_x(buyers, model(buyers, ["x"], "H", F.col("id"), **options).predict()[0])
        assert abs(found[0.0] + Z[0]) < 0.15 and abs(found[1.0] + 6 * Z[0]) < 0.15
    m = le.inverse_weighted_arms(buyers, ["x"], F.col("id"), **options).predict()
    found = by_x(buyers, m[2] - m[1])
    assert abs(found[0.0] + Z[2]) < 0.15 and abs(found[1.0] + 6 * Z[2]) < 0.15
    found = by_x(buyers, le.scalar_flip(buyers, ["x"], Z, F.col("id"), rounds=12, depth=1, rate=0.5, min_weight=0.02).predict(lambda m: np.logaddexp(0, m))[0])
    assert abs(found[0.0] - 1) < 0.6 and abs(found[1.0] - 6) < 0.6


def test_moment_forest_finds_the_step(buyers):
    found = by_x(buyers, le.moment_forest(buyers, ["x"], Z, F.col("id"), trees=10, depth=2, max_features=1.0))
    assert abs(found[0.0] - 1) < 0.6 and abs(found[1.0] - 6) < 0.6


def test_dose_elasticity_inverts():
    d = np.array(Z)
    beta = np.array([0.0, 1.0, 7.5, 30.0])
    mean = (bo.class_shares(-beta[:, None] * d) * d).sum(1)
    assert np.allclose(le.dose_elasticity(mean, Z), beta, atol=1e-6)


def test_scalar_gradient():
    rng = np.random.default_rng(3)
    t = np.column_stack([rng.integers(0, 3, 20), rng.dirichlet([2, 2, 2], 20), np.tile(Z, (20, 1))])
    m = rng.normal(0, 2, (20, 1))

    def loss(m):
        s = np.log(t[:, 1:4]) - np.logaddexp(0, m) * t[:, 4:]
        return np.log(np.exp(s).sum(1)) - s[np.arange(20), t[:, 0].astype(int)]

    assert np.allclose(bo.scalar_flip(m, t)[0][:, 0], (loss(m + 1e-5) - loss(m - 1e-5)) / 2e-5, atol=1e-6)


@pytest.fixture(scope="module")
def offers(spark):
    rng = np.random.default_rng(4)
    n = 4000
    arm, x = rng.integers(0, 3, n), rng.integers(0, 3, n).astype(float)
    m = np.array([0.9, 1.0, 1.1])[arm]
    p = 1 / (1 + np.exp(-(0.3 * x - 5 * np.log(m))))
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": x, "arm": arm, "log_m": np.log(m), "bought": (rng.random(n) < p).astype(int), "noise": rng.normal(size=n)}))


def test_conversion_never_rises_in_price(offers):
    model = le.conversion(offers, ["x", "noise"], ("log_m",), "bought", F.col("id"), rounds=10, depth=3, rate=0.3)
    moved = offers.select(*[model.margin(s).alias(f"s{i}") for i, s in enumerate((-0.2, -0.1, 0.0, 0.1, 0.2))]).toPandas().to_numpy()
    assert (np.diff(moved, axis=1) <= 1e-12).all() and (np.diff(moved, axis=1) < -1e-6).any()
    out = model.applied(offers).toPandas()
    assert (out.elasticity >= -1e-9).all() and 0.5 < out.elasticity.mean() < 5


def test_augmented_arms_leave_the_fold_out(offers):
    """A row's own outcome changes its value by one over its allocation alone."""
    options = {"rounds": 2, "depth": 2, "rate": 0.5}
    third = [1 / 3] * 3
    d = offers.filter("id < 600")
    before = le.augmented_arms(d, ["x"], "bought", "arm", third, F.col("id"), folds=2, **options).orderBy("id").toPandas()
    flipped = d.withColumn("bought", F.when(F.col("id") == 7, 1 - F.col("bought")).otherwise(F.col("bought")))
    after = le.augmented_arms(flipped, ["x"], "bought", "arm", third, F.col("id"), folds=2, **options).orderBy("id").toPandas()
    k, sign = int(before.arm[7]), 1 if after.bought[7] > before.bought[7] else -1
    assert math.isclose(after[f"psi{k}"][7] - before[f"psi{k}"][7], 3 * sign, abs_tol=1e-9)
    curve = le.arm_effects(before.pipe(d.sparkSession.createDataFrame), ["x"], [0.9, 1.0, 1.1], F.col("id"), **options).toPandas()
    assert (curve.s0 >= curve.s1 - 1e-12).all() and (curve.s1 >= curve.s2 - 1e-12).all() and (curve.elasticity >= -1e-12).all()


def test_quasi_newton_finds_a_known_minimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=300)
    rows, _ = fi.fit_rows(spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=list("abcy"))), [F.col(c) for c in "abcy"])

    def loss(p, v):
        e = v[:, :3] @ p - v[:, 3]
        return float(e @ e), 2 * v[:, :3].T @ e

    fit = fi.minimise(rows, loss, np.zeros(3), np.full(3, 0.5), tolerance=1e-12)
    assert fit.converged and np.allclose(fit.parameters, np.linalg.solve(x.T @ x + 0.5 * np.eye(3), x.T @ y), atol=1e-4)


def test_softplus_gradient():
    rng = np.random.default_rng(6)
    k, d = 4, 2
    v = np.column_stack([rng.normal(size=(15, d)), np.log(rng.dirichlet([1] * k, 15)), rng.integers(0, k, 15), rng.random(15)])
    loss, p = le.softplus_loss(k, d), rng.normal(size=(k - 1) * (d + 1))
    wanted = [(loss(p + s, v)[0] - loss(p - s, v)[0]) / 2e-6 for s in np.eye(len(p)) * 1e-6]
    assert np.allclose(loss(p, v)[1], wanted, atol=1e-6)


@pytest.mark.parametrize("constraint", ["none", "isotonic", "softplus"])
def test_price_levels(spark, constraint):
    """Random prices and a planted elasticity of two: the curve falls, in every row where it is constrained."""
    rng = np.random.default_rng(7)
    n = 3000
    price, x = rng.normal(0, 0.3, n), rng.normal(size=n)
    frame = pd.DataFrame({"id": np.arange(n), "stock_code": rng.integers(0, 5, n).astype(str), "rel_price": price, "x": x, "log_qty": 2 - 2.0 * price + rng.normal(0, 0.1, n)})
    df = spark.createDataFrame(frame)
    model = le.PriceLevels(constraint=constraint, columns=["x"], options={"rounds": 3, "depth": 2}).fit(df, F.col("id"))
    out = model.applied(df).toPandas()
    assert abs(out.elasticity.mean() - 2) < 0.5
    assert np.allclose(out[["b0", "b1", "b2"]].sum(axis=1), 1) and len(out) == n
    assert out.groupby("level").size().between(990, 1010).all()
    if constraint != "none":
        assert (out.d0 >= out.d1 - 1e-9).all() and (out.d1 >= out.d2 - 1e-9).all()


def test_equal_rows_teach_as_cells(spark, monkeypatch):
    """Many rows of few values: passes read cells, and the trees are those of single rows."""
    rows = spark.range(6000).select("id", *[(F.hash("id", F.lit(k)) % m).cast("double").alias(c) for k, m, c in ((1, 3, "a"), (2, 2, "b"), (3, 2, "y"))])
    shape = bo._Shape(2, 1, 1, 64)
    asked = bo._training_rows(rows, ["a", "b"], bo.column_edges(rows, ["a", "b"], 64), [F.col("y")], [0.0], None, None, F.col("id"))
    held, _ = bo._gathered(*asked, shape, list(range(5)), 0.8, False)
    assert held.filter("key is not null").count() == 0 and held.count() <= 5 * 3 * 3 * 4
    options = {"rounds": 12, "depth": 2, "rate": 0.5, "subsample": 0.8, "key": F.col("id")}
    few = bo.boost(rows, ["a", "b"], bo.squared, [F.col("y")], [0.0], **options)
    monkeypatch.setattr(bo, "_gathered", lambda rows, pack, *rest: bo.written_step(rows.mapInArrow(pack, "b binary, v binary, key long").withColumn("n", F.lit(None).cast("binary")), "single"))
    single = bo.boost(rows, ["a", "b"], bo.squared, [F.col("y")], [0.0], **options)
    got = rows.select(few.predict()[0].alias("f"), single.predict()[0].alias("s")).toPandas()
    assert np.allclose(got.f, got.s, atol=1e-9)
