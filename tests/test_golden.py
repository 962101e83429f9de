"""Hand-checkable fixtures of the statistical operators."""

import math

import pytest
from pyspark.sql import functions as F

from tercet.operators import experiment as ex
from tercet.operators import grading as gr
from tercet.operators import ranking as ra
from tercet.operators import surface as su

NINE = [(1, 0, 0.70, 0.20, 0.10), (2, 0, 0.55, 0.30, 0.15), (3, 0, 0.30, 0.45, 0.25), (4, 1, 0.20, 0.60, 0.20), (5, 1, 0.35, 0.40, 0.25), (6, 1, 0.15, 0.35, 0.50), (7, 2, 0.10, 0.20, 0.70), (8, 2, 0.25, 0.25, 0.50), (9, 2, 0.30, 0.40, 0.30)]
NINE_COLUMNS = "row_id long, y int, p0 double, p1 double, p2 double"


@pytest.fixture(scope="module")
def nine(spark):
    return spark.createDataFrame(NINE, NINE_COLUMNS)


def test_trio_profile(nine):
    got = {r.perm: r.prob for r in ra.trio_profile(ra.every_trio(nine)).collect()}
    assert got["012"] == pytest.approx(20 / 27)
    assert sum(got.values()) == pytest.approx(1)


def test_sampled_trios_agree_with_all(spark):
    import random

    dice = random.Random(3)
    rows = [(i, i % 3, *(dice.random() + 0.6 * (i % 3 == c) for c in range(3))) for i in range(240)]
    sample = spark.createDataFrame(rows, NINE_COLUMNS)
    every, drawn = ra.every_trio(sample), ra.sampled_trios(sample, repeats=40)
    exact = {r.perm: r.prob for r in ra.trio_profile(every).collect()}
    for r in ra.trio_profile(drawn).collect():
        assert r.n_trios > 5000 and 0 < r.se < 0.03 and abs(r.prob - exact[r.perm]) < 4 * r.se
    vus, found = ra.vus_with_error(every).first(), ra.vus_with_error(drawn).first()
    assert vus.vus == pytest.approx(exact["012"]) and abs(found.vus - vus.vus) < 4 * found.se


def test_targeting_curve(spark):
    import random

    dice = random.Random(5)
    rows = [(i, dice.randrange(3), dice.random(), dice.randrange(3), dice.randrange(2)) for i in range(83)]
    df = spark.createDataFrame(rows, "row_id long, arm int, gain double, pol int, bought int")
    got = {round(r.share, 6): r.value for r in gr.targeting_curve(df, "gain", F.col("pol"), F.col("bought") * 1.5).collect()}
    order = sorted(rows, key=lambda r: -r[2])
    for i in range(21):
        take = round(i / 20 * 83)
        plan = [r[3] if k < take else 1 for k, r in enumerate(order)]
        assert got[round(i / 20, 6)] == pytest.approx(sum(3 * 1.5 * r[4] for r, arm in zip(order, plan, strict=True) if r[1] == arm) / 83)
    assert len(got) == 21


def test_argmax_confusion(nine):
    hits = {r.y: r.n for r in ra.confusion(nine).collect() if r.y == r.pred}
    assert hits == {0: 2, 1: 2, 2: 2}
    weighted = {r.y: r.n for r in ra.confusion(nine, (2.0, 1.0, 1.0)).collect() if r.y == r.pred}
    assert weighted == {0: 3, 1: 1, 2: 1}


def front(spark, points):
    return spark.createDataFrame([tuple(map(float, p)) for p in points], "s0 double, s1 double, s2 double")


@pytest.mark.parametrize("points,volume", [([(1, 1, 1)], 1), ([(1, 0.5, 0.8), (0.5, 1, 0.6)], 0.55), ([(1, 0, 0), (0, 1, 0), (0, 0, 1)], 0), ([(1, 1, 0.5)], 0.5), ([(1, 2 / 3, 1 / 3), (1, 1 / 3, 1), (2 / 3, 1, 2 / 3), (2 / 3, 2 / 3, 1)], 20 / 27)])
def test_hypervolume(spark, points, volume):
    assert su.hypervolume(front(spark, points)).first().volume == pytest.approx(volume)


def test_pareto_front_drops_the_dominated(spark):
    got = su.pareto_front(front(spark, [(1, 0.5, 0.8), (0.5, 0.5, 0.8), (0.5, 1, 0.6)]))
    assert {(r.s0, r.s1, r.s2) for r in got.collect()} == {(1.0, 0.5, 0.8), (0.5, 1.0, 0.6)}


@pytest.mark.parametrize("v,wanted", [((3, 1, 2), (3, 1.5, 1.5)), ((1, 2, 3), (2, 2, 2)), ((3, 2, 1), (3, 2, 1))])
def test_isotonic(spark, v, wanted):
    got = spark.range(1).select(*ra.isotonic_decreasing3([F.lit(float(x)) for x in v])).first()
    assert tuple(got) == pytest.approx(wanted)


@pytest.fixture(scope="module")
def price_test(spark):
    rates = {"L": (0.90, 0.85, 0.80), "M": (0.60, 0.45, 0.30), "S": (0.40, 0.20, 0.10)}
    rows = [(t, a, gr.MULTIPLIERS[a], int(i < round(100 * rates[t][a])), float(k)) for k, t in enumerate("LMS") for a in range(3) for i in range(100)]
    return spark.createDataFrame(rows, "type string, arm int, m double, bought int, score double")


def test_gates_golden(price_test):
    log = [r.elasticity for r in gr.gates_loglinear(price_test, "score", 3).orderBy("bin").collect()]
    assert log == pytest.approx([0.580175, 3.282914, 6.806503], abs=1e-5)
    arc = [r.elasticity for r in gr.gates_arc(price_test, "score", 3).orderBy("bin").collect()]
    assert arc == pytest.approx([0.586947, 3.454152, 6.908305], abs=1e-5)


def test_policy_values(price_test):
    for arm, value in ((0, 0.57), (1, 0.50), (2, 0.44)):
        assert gr.ipw_value(price_test, F.lit(arm), F.col("bought") * F.col("m")).first().value == pytest.approx(value)
    own = F.when(F.col("type") == "L", 2).otherwise(0)
    assert gr.ipw_value(price_test, own, F.col("bought") * F.col("m")).first().value == pytest.approx(0.59333, abs=1e-4)


def test_bayes_flip_round_trip(spark):
    df = spark.createDataFrame([(-0.3, 0.4), (-0.1, 0.2)], "h double, l double").withColumns({"pi_H": F.lit(0.1), "pi_C": F.lit(0.8), "pi_L": F.lit(0.1)})
    for r in df.select("h", "l", *[c.alias(f"r{i}") for i, c in enumerate(ex.risk_ratios(ex.flipped(F.col("h"), F.col("l"))))]).collect():
        assert (r.r0, r.r1, r.r2) == pytest.approx((math.exp(r.h), 1.0, math.exp(r.l)))


def test_global_log_rr(spark):
    rows = [("H", 1)] * 8 + [("C", 1)] * 80 + [("L", 1)] * 12
    df = spark.createDataFrame(rows, "arm string, purchase int").withColumns({"pi_H": F.lit(0.1), "pi_C": F.lit(0.8), "pi_L": F.lit(0.1)})
    assert {r.pair: r.log_rr for r in ex.global_log_rr(df).collect()}["H"] == pytest.approx(math.log(0.1) - math.log(0.125))


def test_ordinal_volume_counts_ties_half(spark):
    rows = [(0, 3.0), (0, 2.0), (1, 2.0), (1, 1.0), (2, 0.5), (2, 1.0)]
    got = ra.vus_ordinal(spark.createDataFrame(rows, "y int, s double"), "s", 2, 1, 0).first().vus
    brute = 0.0
    for a in (0.5, 1.0):
        for b in (2.0, 1.0):
            for c in (3.0, 2.0):
                brute += (1 if a < b else 0.5 if a == b else 0) * (1 if b < c else 0.5 if b == c else 0)
    assert got == pytest.approx(brute / 8)
