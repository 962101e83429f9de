"""Search over settings: closed-form scores against direct fits, the pruning rule, nested folds that never see the outer block."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tercet.operators import features as fe
from tercet.operators import relational as re_
from tercet.operators import tuning as tu
from tercet.operators.features import CONTROLS, PRICE_FEATURES


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(4)
    rows = [(f"p{p:02d}", w) for p in range(18) for w in range(60) if rng.random() < 0.8 and (p != 17 or w >= 50)]
    d = pd.DataFrame(rows, columns=["stock_code", "week"])
    number = d.stock_code.str[1:].astype(int)
    for c in [*CONTROLS, *PRICE_FEATURES]:
        d[c] = rng.normal(size=len(d))
    d["truth"] = 1.0 + 0.08 * number
    d["log_price"] = np.where(number == 16, 0.5, 0.3 * d.lag_log_qty + rng.normal(0, 0.4, len(d)))
    d["log_qty"] = 2 + 0.1 * number - d.truth * d.log_price + 0.7 * d.lag_log_qty + 0.02 * d.week + rng.normal(0, 0.5, len(d))
    return d


@pytest.fixture(scope="module")
def scorer(spark, panel):
    df = spark.createDataFrame(panel)
    odd = df.limit(1).withColumn("log_price", F.lit(None).cast("double"))
    return tu.Scorer.of(df.unionByName(odd), tu.Folds.of(tu.calendar(df), tu.spans(60, splits=3)), truth="truth")


def side(panel, scorer, k):
    te, vs, ve = (scorer.folds.cuts[i] for i in scorer.folds.at[k])
    return panel[panel.week < te], panel[(panel.week >= vs) & (panel.week < ve)]


def direct(train, valid, eps, predicted):
    """All metrics by least squares on rows."""
    x = [np.column_stack([np.ones(len(d)), d[CONTROLS]]) for d in (train, valid)]
    ry, rt = (valid[c] - x[1] @ np.linalg.lstsq(x[0], train[c], rcond=None)[0] for c in ("log_qty", "log_price"))
    constant, loss = np.mean((ry - (ry @ rt) / (rt @ rt) * rt) ** 2), np.mean((ry + eps * rt) ** 2)
    return {"rmse": np.sqrt(np.mean((predicted - valid.log_qty) ** 2)), "rloss": loss, "rloss_skill": 1 - loss / np.mean(ry**2), "rloss_vs_constant": 1 - loss / constant,
            "avg_eps": np.mean(eps), "eps_sd": np.std(eps), "oracle": np.sqrt(np.mean((eps - valid.truth) ** 2)), "oracle_bias": np.mean(eps) - valid.truth.mean()}


def same(got, wanted):
    assert set(got) == set(wanted)
    for m in wanted:
        assert math.isclose(got[m], wanted[m], rel_tol=1e-6, abs_tol=1e-7), (m, got[m], wanted[m])


def test_spans_are_the_folds_of_the_table(spark):
    weeks = spark.range(60).select(F.col("id").alias("week"))
    for splits, gap in ((5, 0), (3, 4), (1, 0), (40, 0)):
        wanted = [(r.train_end, r.valid_start, r.valid_end) for r in fe.rolling_origin_folds(fe.week_numbers(weeks), splits, gap=gap).orderBy("fold").collect()]
        assert tu.spans(60, splits, gap=gap) == wanted


def test_pooled_scores(panel, scorer):
    settings = [{"use_controls": True, "ridge": 0.0}, {"use_controls": False, "ridge": 0.5}]
    found = tu.pooled_scores(scorer, settings)
    for j, s in enumerate(settings):
        for k in range(3):
            train, valid = side(panel, scorer, k)
            x = [np.column_stack([np.ones(len(d)), d[["log_price", *(CONTROLS if s["use_controls"] else [])]]]) for d in (train, valid)]
            beta = np.linalg.solve(x[0].T @ x[0] / len(train) + s["ridge"] * np.eye(x[0].shape[1]), x[0].T @ train.log_qty.to_numpy() / len(train))
            same(found[j][k], direct(train, valid, np.full(len(valid), -beta[1]), x[1] @ beta))


def shrunk(train, valid, min_obs, min_price_sd, tau2, demean_week):
    d = train[["stock_code", "week", "log_qty", "log_price"]].copy()
    if demean_week:
        for c in ("log_qty", "log_price"):
            d[c] -= d.groupby("week")[c].transform("mean")
    raw, var = {}, {}
    for code, g in d.groupby("stock_code"):
        x, y = g.log_price - g.log_price.mean(), g.log_qty - g.log_qty.mean()
        if len(g) >= min_obs and np.std(x) >= min_price_sd and x @ x > 1e-10:
            raw[code] = (x @ y) / (x @ x)
            var[code] = max(((y - raw[code] * x) ** 2).sum() / max(len(g) - 2, 1) / (x @ x), 1e-12)
    b, v = pd.Series(raw), pd.Series(var)
    mu = (b / v).sum() / (1 / v).sum()
    t2 = max(b.var() - v.mean(), 1e-6) if tau2 is None else tau2
    slope = valid.stock_code.map(t2 / (t2 + v) * b + v / (t2 + v) * mu).fillna(mu)
    base = valid.stock_code.map(train.groupby("stock_code").log_qty.mean()).fillna(train.log_qty.mean())
    return -slope, base + slope * (valid.log_price - valid.groupby("stock_code").log_price.transform("mean"))


def test_shrunk_scores(panel, scorer):
    settings = [dict(min_obs=12, min_price_sd=0.02, tau2=None, demean_week=True), dict(min_obs=20, min_price_sd=0.3, tau2=0.05, demean_week=False), dict(min_obs=6, min_price_sd=0.39, tau2=None, demean_week=True)]
    found = tu.shrunk_scores(scorer, settings)
    for j, s in enumerate(settings):
        for k in range(3):
            train, valid = side(panel, scorer, k)
            same(found[j][k], direct(train, valid, *shrunk(train, valid, **s)))


def test_closed_forms_equal_fits(scorer):
    for model, s in (("pooled_loglog", {"use_controls": True, "ridge": 0.3}), ("shrunk_per_product", {"min_obs": 10, "min_price_sd": 0.05, "tau2": None, "demean_week": True})):
        same(tu.fit_score(scorer, model, s, 2), tu.CLOSED[model](scorer, [s])[0][2])


@pytest.mark.parametrize("model", ["twoway_fe", "poisson_glm", "double_ml", "r_learner", "boosted_demand"])
def test_every_model_fits_by_name(scorer, model):
    options = {"trees": 3, "depth": 2} if model == "boosted_demand" else {}
    got = tu.fit_score(scorer, model, options, 1)
    assert set(got) == set(tu.METRICS)
    if model != "boosted_demand":
        assert 1.2 < got["avg_eps"] < 2.2 and got["rmse"] < 1.5 and got["rloss_skill"] > 0.3
    with pytest.raises(KeyError):
        tu.fitted("no such model", scorer.df)


def test_settings_are_seeded_and_in_range():
    for model, space in tu.SPACES.items():
        drawn = tu.sampled(model, 60, 3)
        assert drawn[:20] == tu.sampled(model, 20, 3) and drawn != tu.sampled(model, 60, 4)
        for name, of in space.items():
            values = [s[name] for s in drawn]
            if isinstance(of, tu.Span):
                assert (None in values) == of.maybe
                assert all(v is None or of.low - 1e-12 <= v <= of.high + 1e-12 for v in values)
            else:
                assert set(values) == set(of)
    assert tu.lowest("shrunk_per_product") == {"min_obs": 6, "min_price_sd": 1e-4, "tau2": 1e-4, "demean_week": True}


def test_median_rule():
    losses = [[1, 1, 1], [3, 3, 3], [2, 9, 2], [2, 2, 2.5], None, [0, 5, 5]]
    rows = [[{"rmse": 0.0, "rloss": float(v)} for v in x] if x else [None] * 3 for x in losses]
    found = tu.searched([{"n": j} for j in range(6)], 3, lambda j, k: rows[j][k], rule=tu.MedianRule(startup=2))
    # running means: the third trial's best is 2 at the second fold, its median 2: it stays; the sixth's is 0
    assert [f["state"] for f in found] == ["complete", "complete", "complete", "complete", "failed", "complete"]
    bad = [[{"rloss": 5.0}] * 3]
    more = tu.searched([{}] * 3, 3, lambda j, k: (rows[0][k], rows[1][k], bad[0][k])[j], rule=tu.MedianRule(startup=2))
    assert [(f["state"], f["n_folds"]) for f in more] == [("complete", 3), ("complete", 3), ("pruned", 2)]
    assert tu.best(found)["trial"] == 0
    with pytest.raises(ValueError):
        tu.best([f for f in found if f["state"] == "failed"])


def test_history_is_read_by_running_best(spark, scorer):
    found = tu.tune(scorer, "pooled_loglog", 12, "rloss_vs_constant", seed=1)
    table = tu.history(spark, "pooled_loglog", found).filter("state = 'complete'")
    trail = re_.running_best(table, "model", "trial", "value").orderBy("trial").collect()
    assert [r.best_so_far for r in trail] == np.minimum.accumulate([r.value for r in trail]).tolist()
    top = re_.arg_best(table, "model", "trial", "value").first()
    assert top.trial == tu.best(found)["trial"] and math.isclose(-top.value, max(r.rloss_vs_constant for r in trail))


def test_objectives_and_their_bound(scorer):
    rows = tu.objective_comparison(scorer, "shrunk_per_product", trials=10).collect()
    assert [r.tuned_on for r in rows] == ["rmse", "rloss", "oracle"]
    assert rows[2].oracle <= min(rows[0].oracle, rows[1].oracle) and rows[1].rloss <= rows[0].rloss + 1e-12


@pytest.mark.parametrize("model", ["pooled_loglog", "shrunk_per_product"])
def test_nested_never_sees_the_outer_block(spark, panel, model):
    """The last outer block's quantities are scrambled: its search finds the same, its grade differs."""
    got = tu.nested(spark.createDataFrame(panel), model, trials=6).collect()
    assert [r.outer_fold for r in got] == [0, 1, 2]
    moved = panel.copy()
    last = moved.week >= tu.spans(60, 4)[-1][1]
    moved.loc[last, "log_qty"] = -moved.loc[last, "log_qty"]
    other = tu.nested(spark.createDataFrame(moved), model, trials=6).collect()
    for a, b in zip(got, other, strict=True):
        assert a.settings == b.settings and math.isclose(a.inner_best, b.inner_best, rel_tol=1e-9)
    assert got[2].outer_rloss != other[2].outer_rloss and math.isclose(got[0].outer_rloss, other[0].outer_rloss, rel_tol=1e-9)


def test_short_and_empty_tables(spark, panel):
    df = spark.createDataFrame(panel)
    with pytest.raises(ValueError):
        tu.nested(df.filter("week < 10"), "pooled_loglog")
    with pytest.raises(ValueError):
        tu.Folds.of(tu.calendar(df.filter("week < 0")), tu.spans(0))
    bare = tu.Scorer.of(df.withColumn("log_qty", F.lit(None).cast("double")), tu.Folds.of(tu.calendar(df), tu.spans(60, splits=2)))
    assert tu.pooled_scores(bare, [{}]) == [[None, None]] and tu.fit_score(bare, "pooled_loglog", {}, 0) is None
