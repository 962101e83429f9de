"""Values from the definitions, worked out by hand or by a plain loop, where SQL and code once agreed on a wrong one."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tercet.operators import demand as de
from tercet.operators import features as fe
from tercet.operators import grading as gr
from tercet.operators import models as mo
from tercet.operators import ordering as od
from tercet.operators import pricing as pr
from tercet.operators import relational as re_
from tercet.operators import resampling as rs


def panel_of(spark):
    rows = []
    for k, week in enumerate(["1997-01-06", "1997-01-13", "1997-01-20", "1997-01-27"]):
        rows.append(("AAAA", week, 10 + k, [1.0, 1.0, 0.97, 0.5][k], 2, 3))
        if k < 3:
            rows.append(("BBBB", week, 1, 2.0, 1, 1))
    return spark.createDataFrame(rows, "stock_code string, week string, qty long, price_modal double, n_customers long, n_lines long").withColumn("week", F.to_timestamp("week"))


def test_features_by_hand(spark):
    got = {(r.stock_code, r.week.strftime("%m-%d")): r for r in fe.add_features(panel_of(spark)).collect()}
    # 3 % below the mean of the weeks before is a discount, as the threshold is 2 %
    assert got["AAAA", "01-20"].rel_price == pytest.approx(math.log(0.97)) and got["AAAA", "01-20"].is_discounted == 1.0
    assert got["AAAA", "01-13"].is_discounted == 0.0
    # the market is what the others sold, one unit at least
    assert got["AAAA", "01-13"].market_log_qty == pytest.approx(math.log(1))
    assert got["AAAA", "01-27"].market_log_qty == pytest.approx(math.log(1))  # nobody else: max(0, 1)
    assert got["BBBB", "01-13"].market_log_qty == pytest.approx(math.log(11))
    moved = de.perturbed(spark.createDataFrame([(0.0, -0.01, 0.0, 0.0)], "log_price double, rel_price double, price_change double, is_discounted double"), -0.015).first()
    assert moved.is_discounted == 1.0 and fe.DISCOUNT == -0.02


def shrunk(rows, min_obs=12, min_sd=0.02):
    by_week = {}
    for _, w, y, t in rows:
        by_week.setdefault(w, []).append((y, t))
    mean = {w: (statistics.fmean(v[0] for v in x), statistics.fmean(v[1] for v in x)) for w, x in by_week.items()}
    own = {}
    for c, w, y, t in rows:
        own.setdefault(c, []).append((y - mean[w][0], t - mean[w][1]))
    raw, se2 = {}, {}
    for c, x in own.items():
        my, mt = statistics.fmean(v[0] for v in x), statistics.fmean(v[1] for v in x)
        sxx = sum((t - mt) ** 2 for _, t in x)
        if len(x) >= min_obs and statistics.pstdev(t for _, t in x) >= min_sd:
            b = sum((t - mt) * (y - my) for y, t in x) / sxx
            raw[c], se2[c] = b, max(sum((y - my - b * (t - mt)) ** 2 for y, t in x) / max(len(x) - 2, 1) / sxx, 1e-12)
    pooled = sum(raw[c] / se2[c] for c in raw) / sum(1 / se2[c] for c in raw) if raw else 0.0
    tau2 = max(statistics.variance(raw.values()) - statistics.fmean(se2.values()), 1e-6) if len(raw) > 1 else 1e-6
    return {c: -(tau2 / (tau2 + se2[c]) * raw[c] + (1 - tau2 / (tau2 + se2[c])) * pooled) if c in raw else -pooled for c in own}


def test_products_without_a_slope_get_the_mean(spark):
    dice = random.Random(4)
    rows = []
    for k in range(6):
        for w in range(11 if k == 0 else 20):
            t = 0.001 * dice.random() if k == 1 else dice.gauss(0, 0.3)
            rows.append((f"P{k}", w, 2 - (1 + 0.3 * k) * t + dice.gauss(0, 0.2), t))
    # a flat week mean keeps the price of P1 still
    frame = spark.createDataFrame(rows, "stock_code string, week int, log_qty double, log_price double")
    for options in ({}, {"min_obs": 5}, {"min_sd": 1.0}):
        wanted = shrunk(rows, options.get("min_obs", 12), options.get("min_sd", 0.02))
        got = {r.stock_code: r for r in mo.shrunk_per_product(frame, **options).collect()}
        assert set(got) == set(wanted)
        for c, v in wanted.items():
            assert got[c].elasticity == pytest.approx(v, abs=1e-9)
    assert got["P3"].raw is None and got["P3"].elasticity == 0.0


@pytest.mark.parametrize("fraction,wanted", [(0.5, 5), (0.2, 3), (1.0, 5), (0.0, 0)])
def test_top_fraction_with_nulls_and_text_keys(spark, fraction, wanted):
    rows = [(f"k{i:02d}", None if i >= 5 else float(i // 2)) for i in range(15)]
    got = re_.top_fraction(spark.createDataFrame(rows, "k string, s double"), "s", "k", fraction).collect()
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))
    assert sorted((r.k, r.s) for r in got) == sorted(order[:wanted])


def test_lerner_price_bounds(spark):
    rows = [(0.5, 0.5), (2.0, 0.5), (1.01, 0.5), (50.0, 0.1), (None, 0.5), (float("nan"), 0.5)]
    df = spark.createDataFrame(rows, "eps double, cost double")
    got = [r[0] for r in df.select(gr.lerner_price(F.col("cost"), F.col("eps"), F.lit(1.0))).collect()]
    assert got == pytest.approx([2.0, 1.0, 2.0, 0.5, 2.0, 2.0])
    assert df.select(gr.lerner_price(F.col("cost"), F.col("eps"))).first()[0] == pytest.approx(1.0)


def test_level_error(spark):
    df = spark.createDataFrame([(0.0, math.log(2.0)), (1.0, 1.0)], "y double, p double")
    assert gr.predictive_metrics(df, F.col("y"), F.col("p")).first().level_mape == pytest.approx(0.5)


def test_stratified_folds_are_balanced(spark):
    rows = [(g, "HCL"[g % 3 if g % 7 else 0]) for g in range(200) for _ in range(1 + g % 3)]
    got = rs.stratified_group_folds(spark.createDataFrame(rows, "g long, s string"), "g", "s", 4).collect()
    assert len(got) == 200
    for s in "HCL":
        sizes = [sum(r.fold == f for r in got if r.s == s) for f in range(4)]
        assert max(sizes) - min(sizes) <= 1


def test_normal_distribution(spark):
    xs = [-40.0, -9.0, -7.2, -3.0, -0.5, 0.0, 0.7, 2.0, 8.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(pr.normal_cdf(F.col("x"))).collect()]
    for x, p in zip(xs, got, strict=True):
        assert p == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-6, abs=1e-300)


def test_places_of_one_hot_value(spark):
    rows = [(i, 5.0 if i % 3 else (None if i % 2 else float(i))) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r.k: r.place for r in od.placed_in_order(df, "v", "k").collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert got == {r[0]: i for i, r in enumerate(order)}


def test_buckets_never_fall(spark):
    rows = [(random.Random(i).gauss(0, 1) if i % 4 else float(i % 8),) for i in range(5000)]
    held = od.bucketed(spark.createDataFrame(rows, "v double"), "v").orderBy("v", "__b").collect()
    bins = [r["__b"] for r in held]
    assert bins == sorted(bins) and len(set(bins)) > 300 and max(bins) < od.COARSE


def test_panel_hands_on_no_price_sets_by_customer(spark):
    """Modes and medians are read from counted prices (F14, F15, F20, F23 to F28); the values are those of the definitions."""
    import datetime as dt
    import statistics

    from tercet.operators.relational import build_panel

    start, rows = dt.datetime(2024, 1, 1), []
    for week in range(3):
        for k in range(11):
            rows.append(("abcd", start + dt.timedelta(weeks=week), 1 + k % 4, [2.5, 1.5, 4.0, 1.5, 2.5, 7.0, 3.25][(k + week) % 7], None if k == 5 else k % 3))
    lines = spark.createDataFrame(rows, "stock_code string, week timestamp, quantity long, price double, customer long")
    found = build_panel(lines, min_weeks=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "customer#" in x and ("mode(" in x or "percentile(" in x or "median(" in x)]
    got = {x["week"]: x for x in found.collect()}
    assert len(got) == 3
    for week, x in got.items():
        own = [r for r in rows if r[1] == week]
        prices = [r[3] for r in own]
        most = max(prices.count(p) for p in prices)
        assert x["price_modal"] == min(p for p in prices if prices.count(p) == most) and x["price_median"] == statistics.median(prices)
        assert (x["qty"], x["n_lines"], x["n_customers"]) == (sum(r[2] for r in own), 11, len({r[4] for r in own} - {None}))
        assert abs(x["revenue"] - sum(r[2] * r[3] for r in own)) < 1e-9 and abs(x["price_unitvalue"] * x["qty"] - x["revenue"]) < 1e-9
