"""The exact three-way volume against all trios."""

import random

import numpy as np
import pytest

from tercet.operators import ranking as ra
from tercet.operators import resampling as rs
from tercet.operators import trios

COLUMNS = "row_id long, y int, p0 double, p1 double, p2 double"


def made(n, seed, digits=9):
    dice = random.Random(seed)
    return [(i, i % 3, *(round(dice.random() + 0.5 * (i % 3 == c) + 0.05, digits) for c in range(3))) for i in range(n)]


def direct(rows):
    """Volume and the three sets of conditional means by a loop over all trios."""
    logs = [[], [], []]
    for _, y, *p in rows:
        total = sum(p)
        logs[y].append([round(np.log(v / total) * 1e9) for v in p])
    x, y, z = (np.array(v, dtype=np.int64) for v in logs)
    x, y, z = x[:, None, None], y[None, :, None], z[None, None, :]
    right = x[..., 0] + y[..., 1] + z[..., 2]
    ok = np.ones(np.broadcast_shapes(x.shape[:3], y.shape[:3], z.shape[:3]), bool)
    for a, b, c in ra.PERMS[1:]:
        ok &= right > x[..., a] + y[..., b] + z[..., c]
    means = [ok.mean(axis=(1, 2)), ok.mean(axis=(0, 2)), ok.mean(axis=(0, 1))]
    return ok.mean(), np.sqrt(sum(m.var(ddof=1) / len(m) for m in means)), means


@pytest.mark.parametrize("digits", [9, 1])
@pytest.mark.parametrize("points", [1024, 4])
def test_volume_equals_all_trios(spark, monkeypatch, digits, points):
    monkeypatch.setattr(trios, "BOX_POINTS", points)
    monkeypatch.setattr(trios, "LEAF_PAIRS", 64)
    monkeypatch.setattr(trios, "LEAF_POINTS", 8)
    rows = [*made(150, 3, digits), *made(30, 3, digits)]
    found = trios.exact_volume(spark.createDataFrame(rows, COLUMNS).repartition(3)).first()
    vus, se, means = direct(rows)
    assert found.vus == pytest.approx(vus, abs=1e-12) and found.se == pytest.approx(se, rel=1e-9)
    assert found.n_trios == np.prod([len(m) for m in means])
    assert [found.zeta0, found.zeta1, found.zeta2] == pytest.approx([m.var(ddof=1) for m in means], rel=1e-9)


def test_known_fixture(spark):
    from test_golden import NINE, NINE_COLUMNS

    nine = spark.createDataFrame(NINE, NINE_COLUMNS)
    assert trios.exact_volume(nine).first().vus == pytest.approx(20 / 27)
    profile = {r.perm: r.prob for r in trios.exact_profile(nine).collect()}
    shared = {r.perm: r.prob for r in ra.trio_profile(ra.every_trio(nine)).collect()}
    assert profile["012"] == pytest.approx(20 / 27) and all(profile[k] <= shared[k] + 1e-12 for k in shared)
    tested = rs.tested_against_chance(trios.exact_volume(nine)).first()
    assert tested.z == pytest.approx((20 / 27 - 1 / 6) / tested.se) and tested.upper <= 1


def test_perfect_adverse_and_missing(spark):
    perfect = [(i, i % 3, *(0.9 if c == i % 3 else 0.01 + 0.001 * i for c in range(3))) for i in range(30)]
    assert trios.exact_volume(spark.createDataFrame(perfect, COLUMNS)).first().vus == 1.0
    adverse = [(i, y, *p[1:], p[0]) for i, y, *p in perfect]
    assert trios.exact_volume(spark.createDataFrame(adverse, COLUMNS)).first().vus == 0.0
    none = trios.exact_volume(spark.createDataFrame(perfect, COLUMNS).filter("y <> 1")).first()
    assert none.vus is None
    odd = spark.createDataFrame([*perfect, (99, 1, None, 0.2, 0.3)], COLUMNS)
    assert trios.exact_volume(odd).first().n_trios == 1000


def test_points_are_written_once(spark):
    """Boxes and trios read the counted points, not the score expressions."""
    from tercet.operators.trios import score_points
    from tercet.sources import tables as T

    assert "exp(" not in score_points(T.scored_sample(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString().lower()
