"""Surfaces, fronts and volumes against direct computations on all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tercet.operators import ceilings as ce
from tercet.operators import surface as su
from tercet.operators.ranking import prepared

COLUMNS = "row_id long, y int, p0 double, p1 double, p2 double"


@pytest.fixture(scope="module")
def sample(spark):
    dice = random.Random(8)
    rows = [(i, i % 3, *(round(dice.random() + 0.4 * (i % 3 == c), 2) + 0.01 for c in range(3))) for i in range(400)]
    return spark.createDataFrame([*rows, (999, 1, None, 0.1, 0.2)], COLUMNS)


def direct(sample, a, b):
    d = su.differences(sample).na.drop().toPandas()
    out = []
    for u, v in zip(a, b, strict=True):
        zero = (d.d01 >= u) & (d.d02 >= v)
        one = ~zero & (d.d01 < u) & (d.d12 >= v - u)
        pred = np.where(zero, 0, np.where(one, 1, 2))
        out.append([int(((d.y == y) & (pred == k)).sum()) for y in range(3) for k in range(3)])
    return np.array(out)


def test_counts_of_every_rule(sample):
    for made in (su.roc_surface(sample, 9), su.lattice_surface(sample, 7), su.roc_surface(sample, 5000)):
        got = made.toPandas()
        some = got.sample(60, random_state=1) if len(got) > 60 else got
        assert (some[su._COUNTS].to_numpy() == direct(sample, some.a, some.b)).all()
        assert (got.s0 == got.c00 / (got.c00 + got.c01 + got.c02)).all()
    assert len(su.roc_surface(sample, 9).toPandas()) == 100


def test_argmax_rule_on_the_surface(sample):
    mid = su.lattice_surface(sample, 6).filter("w0 = w1 and w1 = w2").first()
    logs = prepared(sample).na.drop().toPandas()
    pred = logs[["l0", "l1", "l2"]].to_numpy().round(12).argmax(axis=1)
    assert [mid.c00, mid.c11, mid.c22] == [int(((logs.y == k) & (pred == k)).sum()) for k in range(3)]


def test_axis_and_weights(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 1, 2)] + [(None,)], "v double")
    assert su.sweep_axis(df, "v", 10, 5.0).tolist() == [-4.0, 1.5, 2.5, 8.0]
    many = spark.createDataFrame([(float(v * v),) for v in range(50)], "v double")
    u = np.quantile(np.arange(50.0) ** 2, np.linspace(0, 1, 7))
    assert su.sweep_axis(many, "v", 7, 1.0).tolist() == pytest.approx([u[0] - 1, *((u[:-1] + u[1:]) / 2), u[-1] + 1])
    w = su.weights_of(np.array([0.0, np.log(2)]), np.array([0.0, np.log(3)]))
    assert w[0].tolist() == pytest.approx([1 / 3] * 3) and w[1].tolist() == pytest.approx([1 / 6, 2 / 6, 3 / 6])


def test_a_class_without_rows(sample):
    got = su.roc_surface(sample.filter("y <> 1"), 4).toPandas()
    assert got.s1.isna().all() and got.s0.notna().all() and (got[["c10", "c11", "c12"]] == 0).all().all()


def cloud(n, seed):
    dice = np.random.default_rng(seed)
    p = np.abs(dice.normal(size=(n, 3)))
    return np.round(p / np.linalg.norm(p, axis=1)[:, None] * dice.uniform(0.9, 1, (n, 1)), 2)


def test_fronts_and_volumes_equal_loops():
    for seed in range(4):
        s = cloud(60, seed)
        keep = [p for p in np.unique(s, axis=0) if not any((q >= p).all() and (q > p).any() for q in s)]
        assert sorted(map(tuple, su.swept_front(s).tolist())) == sorted(map(tuple, np.array(keep).tolist()))
        for floors in ((0.0, 0.0, 0.0), (0.1, 0.3, 0.2)):
            edges = [np.unique(np.append(s[:, k][s[:, k] > f], f)) for k, f in enumerate(floors)]
            grid = np.stack(np.meshgrid(*[e[1:] for e in edges], indexing="ij"), axis=-1).reshape(-1, 3)
            size = np.stack(np.meshgrid(*[np.diff(e) for e in edges], indexing="ij"), axis=-1).reshape(-1, 3).prod(axis=1)
            wanted = size[(grid[:, None, :] <= s[None]).all(axis=2).any(axis=1)].sum()
            assert su.swept_volume(s, floors) == pytest.approx(wanted)


def test_large_front(spark):
    s = cloud(10_000, 3)
    front = spark.createDataFrame(s.tolist(), "s0 double, s1 double, s2 double").repartition(4)
    exact = su.hypervolume(front).first().volume
    drawn = su.hypervolume_mc(front, 100_000).first()
    assert drawn.n_samples == 100_000 and abs(drawn.volume - exact) < 4 * drawn.se
    hull = su.hull_volume(front).first().volume
    assert exact < hull < np.pi / 6 + 0.01
    planes, volume = ce.facets(ce.hull_points(s))
    u = np.random.default_rng(0).random((200_000, 3))
    assert volume == pytest.approx(hull, abs=1e-9) and (u @ planes[:, :3].T <= planes[:, 3]).all(axis=1).mean() == pytest.approx(hull, abs=5e-3)


def test_envelope_is_the_best_point_beyond(spark):
    s = np.vstack((cloud(40, 9), [[0.5, 0.5, 0.5], [1.0, 1.0, 0.01]]))
    got = su.envelope(spark.createDataFrame(s.tolist(), "s0 double, s1 double, s2 double"), 20).collect()
    assert len(got) == 400
    for r in got:
        u, v = (r.i + 0.5) / 20, (r.j + 0.5) / 20
        assert r.z == max([p[2] for p in s if p[0] >= u and p[1] >= v], default=0.0)


def test_expected_cost_and_infeasible_floors(sample):
    costs = [[0, 1, 2], [3, 0, 1], [9, 4, 0]]
    made = su.roc_surface(sample, 6)
    got = {r.criterion: r for r in su.select_points(made, costs=costs, priors=[1, 1, 2]).collect()}
    rows = made.toPandas()
    best = -np.inf
    for r in rows.itertuples():
        cm = np.array([[getattr(r, f"c{y}{k}") for k in range(3)] for y in range(3)], float)
        best = max(best, -sum(p * (cm[y] / cm[y].sum() @ np.array(costs[y])) for y, p in enumerate((0.25, 0.25, 0.5))))
    assert got["expected_cost"].value == pytest.approx(best)
    assert su.select_points(made, {"s0": 0.99, "s1": 0.99}).count() == 0
    with pytest.raises(ValueError):
        su.select_points(made, {"s0": 0.99, "s1": 0.99}, strict=True)
    curve = [r.floor for r in su.guarantee_curve(made).orderBy("floor").collect()]
    assert curve == [f for f in su.FLOORS if f <= rows.s2.max()]


@pytest.mark.parametrize("direction", ["increasing", "decreasing"])
def test_ordinal_rules(spark, direction):
    dice = random.Random(2)
    rows = [(i % 3, round(dice.gauss(i % 3, 1), 1)) for i in range(150)]
    df = spark.createDataFrame([*rows, (0, None)], "y int, m double")
    got = su.ordinal_surface(df, "m", 8, direction=direction).toPandas()
    assert len(got) == 45
    for r in got.itertuples():
        for y in range(3):
            own = [m for c, m in rows if c == y]
            first = [m < r.t1 for m in own] if direction == "increasing" else [m > r.t2 for m in own]
            last = [m >= r.t2 for m in own] if direction == "increasing" else [m <= r.t1 for m in own]
            assert [getattr(r, f"c{y}{k}") for k in range(3)] == [sum(first), len(own) - sum(first) - sum(last), sum(last)]
    assert (got.t1 <= got.t2).all()


def test_rules_read_counted_cells(spark):
    """No surface keeps the score expressions in its plan, where pushed filters would repeat them inside each other."""
    from tercet.operators import surface as su
    from tercet.sources import tables as T

    sample = T.scored_sample(spark, "/root/testdata/sf0.001")
    for found in (su.lattice_surface(sample, 8), su.roc_surface(sample, 8)):
        assert "exp(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
        assert found.count() > 10
