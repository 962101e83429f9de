"""Posteriors, ceilings, resampling, orderings and demand models against direct computations."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tercet.operators import ceilings as ce
from tercet.operators import demand as de
from tercet.operators import ordering as od
from tercet.operators import pricing as pr
from tercet.operators import ranking as ra
from tercet.operators import relational as re_
from tercet.operators import resampling as rs
from tercet.sources import tables as T


def test_ceilings_known(spark):
    assert ce.vus_ceiling((1 / 6, 1 / 3, 1 / 2)) == pytest.approx(0.444, abs=5e-4)
    rates = np.array([0.9, 1.0, 1.1]) ** -1.0
    assert ce.vus_ceiling(tuple(rates / rates.sum())) == pytest.approx(0.219, abs=5e-4)
    assert ce.vus_ceiling((1 / 3, 1 / 3, 1 / 3)) == pytest.approx(1 / 6, abs=1e-6)


def test_ceiling_surface_has_the_volume(spark):
    priors = (0.14, 0.27, 0.59)
    mean = ce.ceiling_surface(spark, priors, 60).agg(F.avg("z")).first()[0]
    assert mean == pytest.approx(ce.vus_ceiling(priors), abs=2e-3)
    found = ce.scalar_ceilings(priors)
    assert found["accuracy"] == pytest.approx(0.59)
    for s in ce.achievable(priors):
        assert s.sum() - 1 <= found["youden"] + 1e-9 and s.min() <= found["min_sensitivity"] + 1e-9
    grid = {(r.i, r.j): r.z for r in ce.ceiling_surface(spark, priors, 40).collect()}
    best = max(min((i + 0.5) / 40, (j + 0.5) / 40, z) for (i, j), z in grid.items())
    assert best == pytest.approx(found["min_sensitivity"], abs=0.02)
    assert ce.ceiling_report(spark, priors).first().auc_ceiling_01 == pytest.approx(1 - 0.14 / 0.54)


def test_hull_of_a_box_and_a_simplex():
    assert ce.facets(np.array([[0.5, 0.4, 0.3]]))[1] == pytest.approx(0.06)
    assert ce.facets(np.eye(3))[1] == pytest.approx(1 / 6)


def test_verdicts(spark):
    rows = [(0.5,), (0.405,), (0.3,), (0.1,)]
    got = spark.createDataFrame(rows, "v double").select(ce.verdict(F.col("v"), F.lit(0.4))).collect()
    assert [r[0] for r in got] == ["impossible", "suspicious", "plausible", "at or below chance"]


@pytest.fixture(scope="module")
def numbers(spark):
    dice = random.Random(1)
    rows = [(i, dice.choice([dice.gauss(0, 1), float(dice.randrange(4)), 7.0]), dice.random() + i / 900) for i in range(900)]
    return rows, spark.createDataFrame([*rows, (1000, None, 0.5)], "id long, v double, u double").repartition(5)


def test_quantiles_and_ranks(numbers):
    rows, df = numbers
    v = np.array([r[1] for r in rows])
    assert od.quantiles(df, "v", [0.0, 0.013, 0.5, 0.9, 1.0]).first().q == pytest.approx(np.quantile(v, [0, 0.013, 0.5, 0.9, 1]).tolist())
    got = {r.v: r.rank for r in od.average_ranks(df, "v").collect()}
    for x in set(v.tolist()):
        assert got[x] == (v < x).sum() + ((v == x).sum() + 1) / 2


def test_spearman(numbers):
    rows, df = numbers
    v, u = (np.array([r[k] for r in rows]) for k in (1, 2))

    def rank(x):
        return np.array([(x < a).sum() + ((x == a).sum() + 1) / 2 for a in x])

    found = od.spearman(df, "v", "u").first()
    assert found.n == 900 and found.spearman == pytest.approx(np.corrcoef(rank(v), rank(u))[0, 1])


def test_orderings_of_an_empty_and_a_constant_table(spark):
    empty = spark.createDataFrame([], "v double, k long")
    assert od.quantiles(empty, "v", [0.5]).first().q == [None]
    assert re_.top_fraction(empty, "v", "k", 0.5).count() == 0
    flat = spark.createDataFrame([(1.0, k) for k in range(10)], "v double, k long")
    assert od.quantiles(flat, "v", [0.25]).first().q == [1.0]
    assert sorted(r.k for r in re_.top_fraction(flat, "v", "k", 0.35).collect()) == [0, 1, 2]
    twice = flat.withColumn("k", F.floor(F.col("k") / 4))
    assert sorted(r.k for r in re_.top_fraction(twice, "v", "k", 0.6).collect()) == [0, 0, 0, 0, 1, 1]


def test_top_fraction_and_places(numbers):
    rows, df = numbers
    got = {r.id for r in re_.top_fraction(df, "v", "id", 0.4).collect()}
    assert got == {r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))[: int(901 * 0.4)]}
    placed = {r.id: r.place for r in od.placed_in_order(df.filter("v is not null"), "v", "id").collect()}
    assert placed == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def test_auc_and_roc(spark, numbers):
    rows, df = numbers
    labelled = df.filter("v is not null").withColumn("pos", F.col("id") % 3 == 0)
    pos, neg = ([r[1] for r in rows if (r[0] % 3 == 0) == side] for side in (True, False))
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert ra.auc(labelled, "v", F.col("pos"), []).first().auc == pytest.approx(wins / len(pos) / len(neg))
    for r in ra.roc_points(labelled, "v", F.col("pos")).collect():
        assert r.tpr == pytest.approx(sum(a >= r.threshold for a in pos) / len(pos)) and r.fpr == pytest.approx(sum(b >= r.threshold for b in neg) / len(neg))


def test_links_and_tails(spark):
    for x in (-3.0, -0.4, 0.0, 2.2):
        row = spark.range(1).select(pr.probit(F.lit(x)).alias("p"), pr.normal_cdf(F.lit(x)).alias("c")).first()
        assert row.c == pytest.approx(statistics.NormalDist().cdf(x), abs=1e-12) and row.p == pytest.approx(statistics.NormalDist().cdf(0.5875 * x), abs=1e-12)
    found = rs.tested_against_chance(spark.createDataFrame([(0.3, 0.05)], "vus double, se double")).first()
    assert found.z == pytest.approx((0.3 - 1 / 6) / 0.05) and found.p_value == pytest.approx(2 * (1 - statistics.NormalDist().cdf(found.z)), abs=1e-9)
    assert found.lower == pytest.approx(0.3 - 1.959964 * 0.05, abs=1e-6)
    p = rs.slope_tests(spark.createDataFrame([(1.0, 0.5)], "slope double, slope_se double")).first()
    assert p.p_slope_one == pytest.approx(1.0) and p.p_slope_zero == pytest.approx(0.0455, abs=1e-4)


def test_optimal_price_meets_the_lerner_condition(spark):
    p = spark.range(1).select(pr.optimal_price(lambda x: F.lit(3.0) + 0 * x, F.lit(1.0), F.lit(0.6), 60).alias("p"), pr.optimal_price(lambda x: F.lit(0.5) + 0 * x, F.lit(1.0), F.lit(0.6), 60).alias("q")).first()
    assert p.p == pytest.approx(0.9) and p.q == pytest.approx(2.0)


def test_softplus_round_trip(spark):
    rows = [(x,) for x in (-4.0, 0.0, 3.0, 40.0)]
    for r in spark.createDataFrame(rows, "x double").select("x", pr.inverse_softplus(pr.softplus(F.col("x"))).alias("y")).collect():
        assert r.y == pytest.approx(r.x, abs=1e-9)
    assert spark.range(1).select(pr.inverse_softplus(F.lit(-1.0))).first()[0] is None


def test_ordered_gauge_rises(spark):
    dice = random.Random(4)
    s = spark.createDataFrame([(i, i % 3, dice.random(), dice.random(), dice.random()) for i in range(50)], "row_id long, y int, p0 double, p1 double, p2 double")
    assert all(r.g0 < r.g1 < r.g2 for r in pr.ordered_gauge(s).collect())


@pytest.fixture(scope="module")
def buyers(spark):
    dice, rows = random.Random(7), []
    for i in range(3000):
        h, low = -0.2 - 0.3 * dice.random(), 0.1 + 0.4 * dice.random()
        weights = [0.1 * math.exp(h), 0.8, 0.1 * math.exp(low)]
        rows.append((i, i % 97, dice.choices("HCL", weights)[0], h, low))
    return rows, spark.createDataFrame(rows, "id long, c long, arm string, h double, l double").withColumns({"pi_H": F.lit(0.1), "pi_C": F.lit(0.8), "pi_L": F.lit(0.1)})


def test_global_beta_is_the_best(spark, buyers):
    rows, df = buyers
    z = [math.log(1.1), 0.0, math.log(0.9)]
    found = pr.global_scalar_beta(df, [F.col(f"pi_{a}") for a in "HCL"], z).first()

    def nll(beta):
        raw = [p * math.exp(-beta * d) for p, d in zip((0.1, 0.8, 0.1), z)]
        return -sum(math.log(raw["HCL".index(r[2])] / sum(raw)) for r in rows) / len(rows)

    assert found.nll == pytest.approx(nll(found.beta))
    assert nll(found.beta) <= min(nll(found.beta + e) for e in (-0.01, 0.01)) + 1e-12


def test_calibration_slope_is_the_best(buyers):
    rows, df = buyers
    found = pr.calibration_slope(df, "L", F.col("l")).first()
    pair = [(r[2] == "L", r[4]) for r in rows if r[2] != "H"]

    def loss(a, b):
        off = math.log(0.1 / 0.8)
        return sum(math.log1p(math.exp(-(1 if y else -1) * (off + a + b * x))) for y, x in pair)

    best = loss(found.intercept, found.slope)
    assert all(loss(found.intercept + a, found.slope + b) >= best for a, b in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)))


def test_cluster_bootstrap_agrees_with_its_error(buyers):
    rows, df = buyers
    found = rs.cluster_bootstrap(df, "c", F.col("l"), 600).first()
    sums = {}
    for r in rows:
        s = sums.setdefault(r[1], [0.0, 0])
        s[0], s[1] = s[0] + r[4], s[1] + 1
    mean = sum(s for s, _ in sums.values()) / len(rows)
    error = math.sqrt(sum((s - mean * k) ** 2 for s, k in sums.values())) / len(rows)
    assert found.estimate == pytest.approx(mean) and found.n_clusters == 97
    assert (found.upper - found.lower) / (2 * 1.96 * error) == pytest.approx(1, abs=0.15)


def test_poisson_weights(spark):
    got = spark.range(40000).select(rs.poisson_weight(F.col("id")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert got[0] == pytest.approx(1, abs=0.02) and got[1] == pytest.approx(1, abs=0.04)


def test_sensitivity_intervals(spark):
    cm = spark.createDataFrame([(0, 0, 80), (0, 1, 20), (1, 1, 50)], "y int, pred int, n long")
    a, b = rs.sensitivity_intervals(cm).orderBy("class").collect()
    assert a.sensitivity == 0.8 and 0.7 < a.lower < 0.75 < 0.85 < a.upper < 0.9 and (b.lower, b.upper) == (1.0, 1.0)


def test_folds_hold_groups_together(spark, buyers):
    _, df = buyers
    folds = rs.stratified_group_folds(df, "c", "arm", 4).collect()
    assert len(folds) == 97 and {f.fold for f in folds} == {0, 1, 2, 3} and sum(f.n for f in folds) == 3000


def test_fingerprint_ignores_order_only(spark):
    df = spark.createDataFrame([(i, i * 0.5) for i in range(50)], "a long, b double")
    one = rs.fingerprint(df, ["a", "b"]).first()
    assert one == rs.fingerprint(df.orderBy(F.col("a").desc()).repartition(3), ["a", "b"]).first()
    assert one != rs.fingerprint(df.withColumn("b", F.when(F.col("a") == 7, 9.0).otherwise(F.col("b"))), ["a", "b"]).first()
    assert rs.fingerprint(df.filter("false"), ["a", "b"]).first().n_rows == 0


def test_headers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "` Stock Code ` long, b string")
    assert T.normalised_headers(df).dtypes == [("StockCode", "string"), ("b", "string")]
    T.write_report(spark.createDataFrame([(1, 2.5)], "a long, b double"), str(tmp_path / "report"))
    assert T.read_by_suffix(spark, str(tmp_path / "report"), "a long, b double", "csv").first() == (1, 2.5)
    T.write_history(df.select("b"), str(tmp_path / "history.parquet"))
    assert T.read_by_suffix(spark, str(tmp_path / "history.parquet")).count() == 1
    made = []

    def build():
        made.append(1)
        return spark.range(5)

    for _ in range(2):
        assert T.cached_table(spark, str(tmp_path / "cache"), {"min_weeks": 20}, build).count() == 5
    assert made == [1]
