"""Queries of price-test posteriors, conversion, the buyer side, folds, intervals and demand models with controls."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tercet.operators import ceilings as ce
from tercet.operators import demand as de
from tercet.operators import effects as ef
from tercet.operators import experiment as ex
from tercet.operators import features as fe
from tercet.operators import grading as gr
from tercet.operators import learners as le
from tercet.operators import logits as lo
from tercet.operators import manifold as ma
from tercet.operators import ordering as od
from tercet.operators import pricing as pr
from tercet.operators import ranking as ra
from tercet.operators import relational as re_
from tercet.operators import resampling as rs
from tercet.operators import stacking as st
from tercet.operators import surface as su
from tercet.operators import tuning as tu
from tercet.plans import views as V
from tercet.plans.registry import _H, _L, _SURFACE, CLEAN, EX, PANEL, PT, SC, clean, high, low, mesh, n, panel, query, r
from tercet.session import dropped_step, written_step
from tercet.sources import tables as T

M = (0.9, 1.0, 1.1)
_LN = [f"ln({m}::DOUBLE)" for m in M]
_PI = [0.2, 0.6, 0.2]
_Z = [math.log(1.1), 0.0, math.log(0.9)]
_ZS = ["ln(1.1::DOUBLE)", "0.0::DOUBLE", "ln(0.9::DOUBLE)"]


def pt(spark, d):
    return T.price_test(spark, d)


# ---- price test --------------------------------------------------------------------------------


@query("buyer_prevalences", f"WITH {PT}, a AS (SELECT arm, count(*) AS n, sum(bought) AS b FROM pt GROUP BY 1) SELECT {n('arm', 'arm')}, {r('b/n', 'rate')}, {r('b/(SELECT sum(b) FROM a)', 'prevalence')} FROM a")
def _(spark, d):
    return pr.buyer_prevalences(pt(spark, d))


@query("purchase_rates", f"WITH {PT} SELECT row_id, " + ", ".join(r(f"0.5::DOUBLE*power({m}::DOUBLE, -score/25)", f"d{k}") for k, m in enumerate(M)) + " FROM pt")
def _(spark, d):
    rates = pr.purchase_rates(F.lit(0.5), F.col("score") / 25, M)
    return pt(spark, d).select("row_id", *[c.alias(f"d{k}") for k, c in enumerate(rates)])


_LOG3 = "l AS (SELECT row_id, y, ln(greatest(p0/(p0+p1+p2), 1e-300)) AS l0, ln(greatest(p1/(p0+p1+p2), 1e-300)) AS l1, ln(greatest(p2/(p0+p1+p2), 1e-300)) AS l2 FROM sc)"


@query("monotone_demand", f"WITH {SC}, {_LOG3} SELECT {r('avg(CAST(l0 >= l1 AND l1 >= l2 AS DOUBLE))', 'fraction_satisfied')}, {n('count(*) FILTER (WHERE NOT (l0 >= l1 AND l1 >= l2))', 'n_violations')}, {r('min(least(l0 - l1, l1 - l2))', 'worst_violation_log')} FROM l")
def _(spark, d):
    return pr.monotone_demand(T.scored_sample(spark, d))


def _priors(spark, d) -> tuple[float, float, float]:
    return tuple(x.prevalence for x in pr.buyer_prevalences(pt(spark, d)).orderBy("arm").collect())  # three rows


@query("price_test_ceilings", None)
def _(spark, d):
    return ce.ceiling_report(spark, _priors(spark, d))


@query("ceiling_surface", None)
def _(spark, d):
    return ce.ceiling_surface(spark, _priors(spark, d))


@query("vus_audit", None)
def _(spark, d):
    top = F.lit(ce.vus_ceiling(_priors(spark, d)))
    found = ra.vus_ordinal(T.scored_sample(spark, d), "marker", 2, 1, 0, "decreasing")  # the marker falls from small quantities (class 2) to large ones (class 0)
    return found.select("vus", top.alias("ceiling"), ce.verdict(F.col("vus"), top).alias("verdict"), ce.normalised(F.col("vus"), top).alias("fraction_of_attainable"), (F.col("vus") - top).alias("excess_over_ceiling"))


_AUC_CEIL = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {r(f'1 - q[{i + 1}]/(2*q[{j + 1}])', 'ceiling')} FROM q" for i, j in ((0, 1), (0, 2), (1, 2)))


@query("pairwise_ceilings", f"WITH {PT}, q AS (SELECT list_sort([avg(CAST(arm = 0 AS DOUBLE)), avg(CAST(arm = 1 AS DOUBLE)), avg(CAST(arm = 2 AS DOUBLE))]) AS q FROM pt WHERE bought = 1) SELECT {n('i', 'i')}, {n('j', 'j')}, ceiling FROM ({_AUC_CEIL})")
def _(spark, d):
    q = pr.buyer_prevalences(pt(spark, d)).agg(F.sort_array(F.collect_list("prevalence")).alias("q"))
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ce.pairwise_ceiling(F.col("q")[i], F.col("q")[j]).alias("ceiling")) for i, j in ((0, 1), (0, 2), (1, 2))]
    return q.select(F.explode(F.array(*pairs)).alias("e")).select("e.*")


# ---- gauges ------------------------------------------------------------------------------------


@query("gauge_prior", f"WITH {SC}, g AS (SELECT avg(CAST(y = 0 AS DOUBLE)) AS g0, avg(CAST(y = 1 AS DOUBLE)) AS g1, avg(CAST(y = 2 AS DOUBLE)) AS g2 FROM sc) SELECT row_id, {n('y', 'y')}, " + ", ".join(r(f"p{k}/g{k}/(p0/g0+p1/g1+p2/g2)", f"q{k}") for k in range(3)) + " FROM sc, g")
def _(spark, d):
    return pr.prior_normalised(T.scored_sample(spark, d))


@query("ordered_gauge", f"WITH {SC}, {_LOG3}, s AS (SELECT max(l0 - l1) + 1 AS a, max(l1 - l2) + 1 AS c FROM l) SELECT row_id, {r('(l0 - l1 - a) + (l1 - l2 - c)', 'g0')}, {r('l1 - l2 - c', 'g1')}, 0.0::DOUBLE AS g2 FROM l, s")
def _(spark, d):
    return pr.ordered_gauge(T.scored_sample(spark, d))


@query("balanced_gauge", f"WITH {PT} SELECT row_id, " + ", ".join(r(f"p{k}/{q}/(p0/0.1::DOUBLE + p1/0.8::DOUBLE + p2/0.1::DOUBLE)", f"v{k}") for k, q in enumerate(("0.1::DOUBLE", "0.8::DOUBLE", "0.1::DOUBLE"))) + " FROM pt")
def _(spark, d):
    v = pr.balanced([F.col(p) for p in ra.P], [0.1, 0.8, 0.1])
    return pt(spark, d).select("row_id", *[c.alias(f"v{k}") for k, c in enumerate(v)])


@query("posterior_constraint", f"WITH {PT} SELECT {r('avg(CAST(p1/0.8::DOUBLE - p0/0.1::DOUBLE <= 1e-12 AND p2/0.1::DOUBLE - p1/0.8::DOUBLE <= 1e-12 AS DOUBLE))', 'share_demand_monotone')}, {r('avg(CAST(p1 - p0 <= 1e-12 AND p2 - p1 <= 1e-12 AS DOUBLE))', 'share_posterior_monotone')} FROM pt")
def _(spark, d):
    return pr.posterior_constraint(pt(spark, d), [F.col(p) for p in ra.P], [0.1, 0.8, 0.1])


_TRI = "SELECT region, CAST(vertex AS BIGINT) AS vertex, round(v0 + 2e-9, 6) AS v0, round(v1 + 2e-9, 6) AS v1, round(v2 + 2e-9, 6) AS v2 FROM (VALUES ('standard', 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('standard', 1, 0.5, 0.5, 0.0), ('standard', 2, 1/3.0::DOUBLE, 1/3.0::DOUBLE, 1/3.0::DOUBLE), ('admissible', 0, 1.0, 0.0, 0.0), ('admissible', 1, 1/9.0::DOUBLE, 8/9.0::DOUBLE, 0.0), ('admissible', 2, 0.1, 0.8, 0.1)) t(region, vertex, v0, v1, v2)"


@query("triangle_vertices", _TRI)
def _(spark, d):
    rows = [(a, b, *map(float, v)) for a, b, v in pr.triangle_vertices([0.1, 0.8, 0.1])]
    return spark.createDataFrame(rows, "region string, vertex long, v0 double, v1 double, v2 double")


_W = ("1", "2", "1")


def _mean(i: int, j: int) -> str:
    return "(" + " + ".join(f"{_W[k]}*p{k}" for k in range(i, j + 1)) + f")/({' + '.join(_W[i : j + 1])})"


def _iso(k: int) -> str:
    over = []
    for i in range(k + 1):
        means = [_mean(i, j) for j in range(k, 3)]
        over.append(f"greatest({', '.join(means)})" if len(means) > 1 else means[0])
    return f"least({', '.join(over)})" if len(over) > 1 else over[0]


@query("isotonic_weighted", f"WITH {SC} SELECT row_id, " + ", ".join(r(_iso(k), f"v{k}") for k in range(3)) + " FROM sc")
def _(spark, d):
    v = pr.isotonic_decreasing([F.col(p) for p in ra.P], [F.lit(float(w)) for w in _W])
    return T.scored_sample(spark, d).select("row_id", *[c.alias(f"v{k}") for k, c in enumerate(v)])


_RBAR = f"(({_LN[0]} + 2*{_LN[1]} + {_LN[2]})/4)"
_SBAR = "((ln(p0) + 2*ln(p1) + ln(p2))/4)"
_TOP = " + ".join(f"{w}*({x} - {_RBAR})*(ln(p{k}) - {_SBAR})" for k, (w, x) in enumerate(zip(_W, _LN, strict=True)))
_BELOW = " + ".join(f"{w}*({x} - {_RBAR})*({x} - {_RBAR})" for w, x in zip(_W, _LN, strict=True))


@query("level_elasticity", f"WITH {PT} SELECT row_id, {r(f'-(ln(p1) - ln(p0))/({_LN[1]} - {_LN[0]})', 'arc0')}, {r(f'-(ln(p2) - ln(p1))/({_LN[2]} - {_LN[1]})', 'arc1')}, {r(f'-({_TOP})/({_BELOW})', 'elasticity')} FROM pt")
def _(spark, d):
    logs, prices = [F.ln(p) for p in ra.P], [math.log(m) for m in M]
    arcs = pr.arc_elasticities(logs, prices)
    return pt(spark, d).select("row_id", arcs[0].alias("arc0"), arcs[1].alias("arc1"), pr.level_elasticity(logs, prices, [F.lit(float(w)) for w in _W]).alias("elasticity"))


# ---- conversion --------------------------------------------------------------------------------

_ETA = "(score/10 - 3*ln(m))"
_SIG = "1/(1 + exp(-{}))"


@query("links", f"WITH {PT}, z AS (SELECT avg(gain) AS zm, greatest(stddev_pop(gain), 1e-9) AS zs FROM pt) SELECT row_id, {r(_SIG.format(_ETA), 'logit')}, {r(_SIG.format(f'(CASE WHEN {_ETA} > 0 THEN {_ETA} ELSE 0.45::DOUBLE*{_ETA} END)'), 'kinked')}, {r(_SIG.format(f'({_ETA}*(0.6::DOUBLE + 0.8::DOUBLE/(1 + exp(-(gain - zm)/zs))))'), 'mixed')} FROM pt, z")
def _(spark, d):
    eta = F.col("score") / 10 - 3 * F.ln("m")
    return pr.mixed(pt(spark, d), eta, "gain").select("row_id", pr.sigmoid(eta).alias("logit"), pr.kinked(eta).alias("kinked"), F.col("s").alias("mixed"))


def _at(step: str) -> str:
    return f"ln(greatest(1/(1 + exp(-(score/10 - 3*(ln(m) {step} 1e-4::DOUBLE)))), 1e-300))"


@query("numeric_elasticity", f"WITH {PT} SELECT row_id, {r(f'-({_at(chr(43))} - {_at(chr(45))})/(2*1e-4::DOUBLE)', 'elasticity', 5)} FROM pt")
def _(spark, d):
    e = pr.numeric_elasticity(pr.sigmoid, F.col("score") / 10, F.lit(3.0), F.ln("m"))
    return pt(spark, d).select("row_id", F.round(e + 2e-9, 5).alias("elasticity"))


def _fixed_point(steps: int) -> str:
    out = ["s0 AS (SELECT row_id, score, m, m AS p FROM pt)"]
    for k in range(steps):
        out.append(f"e{k} AS (SELECT *, 3*(1 - 1/(1 + exp(-(score/10 - 3*ln(p))))) AS e FROM s{k})")
        out.append(f"s{k + 1} AS (SELECT row_id, score, m, 0.5::DOUBLE*p + 0.5::DOUBLE*least(greatest(CASE WHEN e > 1.000001::DOUBLE THEN 0.6::DOUBLE/(1 - 1/e) ELSE 2.0::DOUBLE*m END, 0.5::DOUBLE*m), 2.0::DOUBLE*m) AS p FROM e{k})")
    return ", ".join(out)


@query("optimal_price", f"WITH {PT}, {_fixed_point(25)} SELECT row_id, {r('p', 'price')}, {r('(p - 0.6::DOUBLE)/(1 + exp(-(score/10 - 3*ln(p))))', 'profit')} FROM s25")
def _(spark, d):
    def conversion(p):
        return pr.sigmoid(F.col("score") / 10 - 3 * F.ln(p))

    best = pr.optimal_price(lambda p: 3 * (1 - conversion(p)), F.col("m"), F.lit(0.6))
    return pt(spark, d).withColumn("price", best).select("row_id", "price", pr.profit(conversion(F.col("price")), F.col("price"), F.lit(0.6)).alias("profit"))


_BIN5 = f"{PT}, e AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM pt), bn AS (SELECT pt.*, CAST(score >= q[1] AS INTEGER) + CAST(score >= q[2] AS INTEGER) + CAST(score >= q[3] AS INTEGER) + CAST(score >= q[4] AS INTEGER) AS bin FROM pt, e)"
_ARMS = ", ".join(f"avg(bought) FILTER (WHERE arm = {k}) AS c{k}, count(*) FILTER (WHERE arm = {k}) AS k{k}" for k in range(3))


@query("rates_by_bin", f"WITH {_BIN5}, a AS (SELECT bin, count(*) AS n, avg(score) AS s, {_ARMS} FROM bn GROUP BY 1) SELECT {n('bin', 'bin')}, {n('n', 'n')}, {r('s', 'eps_predicted')}, {r(f'-(ln(c2) - ln(c0))/({_LN[2]} - {_LN[0]})', 'eps_realised')}, {r(f'sqrt((1 - c0)/greatest(c0*k0, 1e-9) + (1 - c2)/greatest(c2*k2, 1e-9))/({_LN[2]} - {_LN[0]})', 'se')}, " + ", ".join(f"{r(f'c{k}', f'conv_arm{k}')}, {n(f'k{k}', f'n_arm{k}')}" for k in range(3)) + " FROM a")
def _(spark, d):
    return pr.rates_by_bin(gr.binned(pt(spark, d), "score", 5), "score", M)


# ---- buyer side --------------------------------------------------------------------------------

_SP = "(ln(1 + exp(-abs({0}))) + greatest({0}, 0.0::DOUBLE))"


@query("stable_transforms", f"WITH {EX}, v AS (SELECT quote_id, risk*10 - 6 AS x, 0.1::DOUBLE + risk AS p FROM ex) SELECT quote_id, {r(_SP.format('x'), 'softplus')}, {r('p + ln(1 - exp(-p))', 'inverse_softplus')}, {r('ln(least(p/2, 0.999::DOUBLE)) - ln(1 - least(p/2, 0.999::DOUBLE))', 'logit')} FROM v")
def _(spark, d):
    v = T.experiment(spark, d).select("quote_id", (F.col("risk") * 10 - 6).alias("x"), (0.1 + F.col("risk")).alias("p"))
    return v.select("quote_id", pr.softplus(F.col("x")).alias("softplus"), pr.inverse_softplus(F.col("p")).alias("inverse_softplus"), pr.stable_logit(F.least(F.col("p") / 2, F.lit(0.999))).alias("logit"))


_SCALAR = [f"pi_{a}*exp(-(risk + 1)*{z})" for a, z in zip(ex.ARMS, _ZS, strict=True)]
_RAW = f"({' + '.join(_SCALAR)})"
_LL = f"least({_L}, 5.0::DOUBLE)"


@query("scalar_forms", f"WITH {EX} SELECT quote_id, " + ", ".join(r(f"{s}/{_RAW}", f"r{k}") for k, s in enumerate(_SCALAR)) + f", {r(f'-(risk + 1)*{_ZS[0]}', 'rr_h')}, {r(f'-(risk + 1)*{_ZS[2]}', 'rr_l')}, {r(f'1/(1 + exp(-(ln(pi_H) - ln(pi_C) + {_H})))', 'pair')}, {r(f'greatest(-({_ZS[0]}*{_H} + {_ZS[2]}*{_LL})/({_ZS[0]}*{_ZS[0]} + {_ZS[2]}*{_ZS[2]}), 0.0::DOUBLE)', 'projected')} FROM ex")
def _(spark, d):
    beta = F.col("risk") + 1
    posterior = pr.scalar_posterior(beta, [F.col(f"pi_{a}") for a in ex.ARMS], _Z)
    rr = pr.scalar_log_rr(beta, _Z)
    return T.experiment(spark, d).select("quote_id", *[c.alias(f"r{k}") for k, c in enumerate(posterior)], rr[0].alias("rr_h"), rr[1].alias("rr_l"), pr.pair_probability(high(), F.col("pi_H"), F.col("pi_C")).alias("pair"), pr.scalar_from_gaps(high(), low(), _Z).alias("projected"))


_SMOOTH = [_SP.format(f"(-({_H})/0.05::DOUBLE)"), _SP.format(f"(({_L})/0.05::DOUBLE)")]


@query("smooth_projection", f"WITH {EX} SELECT quote_id, {r(f'-0.05::DOUBLE*{_SMOOTH[0]}', 'h')}, {r(f'0.05::DOUBLE*{_SMOOTH[1]}', 'l')} FROM ex")
def _(spark, d):
    h, lo = pr.smooth_projection(high(), low())
    return T.experiment(spark, d).select("quote_id", h.alias("h"), lo.alias("l"))


_Q3 = f"q AS (SELECT arm, pi_H*exp({_H}) AS a, pi_C AS b, pi_L*exp({_L}) AS c FROM ex WHERE purchase = 1)"


@query("multiclass_nll", f"WITH {EX}, {_Q3} SELECT {n('count(*)', 'n_buyers')}, {r('avg(-ln(CASE arm WHEN {0}H{0} THEN a WHEN {0}C{0} THEN b ELSE c END/(a + b + c)))'.format(chr(39)), 'nll')} FROM q")
def _(spark, d):
    return pr.multiclass_nll(T.experiment(spark, d).filter("purchase = 1"), F.col("arm"), ex.flipped(high(), low()))


_S2 = [f"pi_{a}*exp(-2*{z})" for a, z in zip(ex.ARMS, _ZS, strict=True)]


@query("scalar_nll", f"WITH {EX} SELECT {n('count(*)', 'n_buyers')}, {r('avg(-ln(CASE arm WHEN {0}H{0} THEN {1} WHEN {0}C{0} THEN {2} ELSE {3} END/({1} + {2} + {3})))'.format(chr(39), *_S2), 'nll')} FROM ex WHERE purchase = 1")
def _(spark, d):
    loss = pr.scalar_nll(F.lit(2.0), F.col("arm"), [F.col(f"pi_{a}") for a in ex.ARMS], _Z)
    return T.experiment(spark, d).filter("purchase = 1").agg(F.count("*").alias("n_buyers"), F.avg(loss).alias("nll"))


@query("global_scalar_beta", None)
def _(spark, d):
    return pr.global_scalar_beta(T.experiment(spark, d).filter("purchase = 1"), [F.col(f"pi_{a}") for a in ex.ARMS], _Z)


@query("calibration_slope", None)
def _(spark, d):
    buyers = T.experiment(spark, d).filter("purchase = 1")
    return pr.calibration_slope(buyers, "H", high()).withColumn("pair", F.lit("H")).unionByName(pr.calibration_slope(buyers, "L", low()).withColumn("pair", F.lit("L")))


_GL = "gl AS (SELECT ln(count(*) FILTER (WHERE arm = 'H')/count(*) FILTER (WHERE arm = 'C')) - ln(0.2::DOUBLE/0.6::DOUBLE) AS h, ln(count(*) FILTER (WHERE arm = 'L')/count(*) FILTER (WHERE arm = 'C')) - ln(0.2::DOUBLE/0.6::DOUBLE) AS l FROM ex WHERE purchase = 1)"


@query("bounded_log_rr", f"WITH {EX}, {_GL} SELECT 'H' AS pair, {r('least(greatest(h, -20.0::DOUBLE), 0.0::DOUBLE)', 'log_rr')} FROM gl UNION ALL SELECT 'L', {r('least(greatest(l, 0.0::DOUBLE), 20.0::DOUBLE)', 'log_rr')} FROM gl")
def _(spark, d):
    return ex.bounded_log_rr(ex.global_log_rr(T.experiment(spark, d)))


@query("selective_policy", f"WITH {EX}, s AS (SELECT quote_id, CASE WHEN row_number() OVER (ORDER BY base_premium DESC, quote_id) <= floor(count(*) OVER () * 0.1::DOUBLE) THEN 'H' ELSE 'C' END AS policy FROM ex) SELECT policy, {n('count(*)', 'n')}, {n('sum(quote_id)', 'ids')} FROM s GROUP BY 1")
def _(spark, d):
    chosen = ex.selective_policy(T.experiment(spark, d), "base_premium", "quote_id", F.lit("H"), 0.1)
    return chosen.groupBy("policy").agg(F.count("*").alias("n"), F.sum("quote_id").alias("ids"))


@query("uniform_policy", f"WITH {EX}, w AS (SELECT CASE WHEN arm = 'C' THEN 1/pi_C ELSE 0 END AS w, purchase*CASE arm WHEN 'H' THEN contribution_H WHEN 'C' THEN contribution_C ELSE contribution_L END AS rw FROM ex) SELECT {r('sum(w*rw)/count(*)', 'ips')}, {r('sum(w*rw)/sum(w)', 'snips')}, {r('avg(CAST(w > 0 AS DOUBLE))', 'match_rate')}, {r('sum(w)*sum(w)/sum(w*w)', 'ess')} FROM w")
def _(spark, d):
    return ex.policy_ips(T.experiment(spark, d), F.lit("C"))


@query("cluster_bootstrap", None)
def _(spark, d):
    return rs.cluster_bootstrap(T.experiment(spark, d), "customer_id", F.col("purchase") * F.col("contribution_C"), 400)


@query("policy_difference", None)
def _(spark, d):
    own, flat = ex.choose_arm([F.exp(high()), F.lit(1.0), F.exp(low())]), F.lit("C")
    gain = F.col("purchase") * ex.pi_of(F.col("arm"), "contribution_") / ex.pi_of(F.col("arm")) * ((F.col("arm") == own).cast("int") - (F.col("arm") == flat).cast("int"))
    return rs.cluster_bootstrap(T.experiment(spark, d), "customer_id", gain, 400)


# ---- folds -------------------------------------------------------------------------------------


def _hash(key: str, k: int, seed: str = "") -> str:
    return f"CAST('0x' || substr(md5('{seed}' || {key}), 1, 8) AS BIGINT) % {k}"


@query("grouped_folds", f"WITH {CLEAN} SELECT stock_code, {n(_hash('stock_code', 5), 'fold')}, {n('count(*)', 'n_lines')} FROM clean GROUP BY 1")
def _(spark, d):
    return clean(spark, d).withColumn("fold", rs.fold_of(F.col("stock_code"), 5)).groupBy("stock_code", "fold").agg(F.count("*").alias("n_lines"))


@query("row_folds", f"WITH {PT}, f AS (SELECT {_hash('CAST(row_id AS VARCHAR)', 5, 'r')} AS fold, row_id FROM pt) SELECT {n('fold', 'fold')}, {n('count(*)', 'n')}, {n('sum(row_id)', 'ids')} FROM f GROUP BY 1")
def _(spark, d):
    return pt(spark, d).groupBy(rs.fold_of(F.col("row_id"), 5, "r").alias("fold")).agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query("stratified_folds", f"WITH {EX}, s AS (SELECT customer_id, arm, count(*) AS c, sum(count(*)) OVER (PARTITION BY customer_id) AS n FROM ex GROUP BY 1, 2) SELECT customer_id, arm, {n('n', 'n')}, {n('(row_number() OVER (PARTITION BY arm ORDER BY h, customer_id) - 1) % 5', 'fold')} FROM (SELECT *, CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR)), 1, 12) AS BIGINT) AS h FROM s QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY c DESC, arm) = 1)")
def _(spark, d):
    return rs.stratified_group_folds(T.experiment(spark, d), "customer_id", "arm", 5)


_ENDS = "SELECT k - 1 AS split, CAST(floor(f + (n - v - f)*(k - 1)/2.0::DOUBLE) AS BIGINT) AS ends, v FROM (SELECT count(*) AS n, greatest(1, CAST(floor(count(*)*0.5::DOUBLE) AS BIGINT)) AS f, greatest(1, CAST(floor(count(*)*0.15::DOUBLE) AS BIGINT)) AS v FROM g), range(1, 4) t(k)"


@query("rolling_group_splits", f"WITH {EX}, g AS (SELECT customer_id, max(quote_timestamp) AS last, count(*) AS c FROM ex GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY last, customer_id) - 1 AS place FROM g), e AS ({_ENDS}) SELECT {n('split', 'split')}, {n('ends', 'end')}, {n('count(*) FILTER (WHERE place < ends)', 'train_groups')}, {n('count(*) FILTER (WHERE place >= ends AND place < ends + v)', 'valid_groups')}, {n('sum(c) FILTER (WHERE place < ends)', 'train_rows')}, {n('sum(c) FILTER (WHERE place >= ends AND place < ends + v)', 'valid_rows')} FROM o, e GROUP BY split, ends")
def _(spark, d):
    return rs.rolling_group_splits(T.experiment(spark, d), "customer_id", "quote_timestamp")


@query("last_weeks", f"WITH {CLEAN}, w AS (SELECT min(week) AS f FROM (SELECT DISTINCT week FROM clean ORDER BY week DESC LIMIT 8)) SELECT {n('week >= f', 'holdout')}, {n('count(*)', 'n_lines')}, {n('count(DISTINCT week)', 'n_weeks')} FROM clean, w GROUP BY 1")
def _(spark, d):
    return rs.last_weeks(clean(spark, d), 8).groupBy("holdout").agg(F.count("*").alias("n_lines"), F.countDistinct("week").alias("n_weeks"))


# ---- ranks and reports -------------------------------------------------------------------------


def _ranks(x: str, y: str, table: str) -> str:
    return f"rk AS (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1)/2.0::DOUBLE AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1)/2.0::DOUBLE AS ry FROM {table})"


@query("spearman", f"WITH {PT}, {_ranks('score', 'gain', 'pt')} SELECT {n('count(*)', 'n')}, {r('corr(rx, ry)', 'spearman')} FROM rk")
def _(spark, d):
    return od.spearman(pt(spark, d), "score", "gain")


@query("average_ranks", f"WITH {PT}, k AS (SELECT score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1)/2.0::DOUBLE AS rk FROM pt) SELECT {r('score', 'score')}, {r('any_value(rk)', 'rank')}, {n('count(*)', 'n')} FROM k GROUP BY 1")
def _(spark, d):
    return od.average_ranks(pt(spark, d), "score")


@query("recovery_slope", f"WITH {PT}, e AS (SELECT score/25 AS t, gain/3 AS s FROM pt), {_ranks('t', 's', 'e')} SELECT (SELECT {r('regr_slope(s, t)', 'x')} FROM e) AS slope, (SELECT {r('corr(rx, ry)', 'x')} FROM rk) AS spearman")
def _(spark, d):
    e = pt(spark, d).select((F.col("score") / 25).alias("t"), (F.col("gain") / 3).alias("s"))
    return e.agg(F.regr_slope("s", "t").alias("slope")).crossJoin(od.spearman(e, "t", "s").select("spearman"))


_PAIRS = f"{PT}, f AS (SELECT p_brand, avg(bought*m) FILTER (WHERE arm = 0) AS mu0, avg(bought*m) FILTER (WHERE arm = 2) AS mu1 FROM pt GROUP BY 1), ps AS (SELECT score, mu0 - mu1 + CASE WHEN arm = 0 THEN (bought*m - mu0)*3 ELSE 0 END - CASE WHEN arm = 2 THEN (bought*m - mu1)*3 ELSE 0 END AS psi FROM pt JOIN f USING (p_brand))"


@query("pseudo_outcome_corr", f"WITH {_PAIRS} SELECT {n('count(*)', 'n')}, {r('corr(score, psi)', 'pearson')} FROM ps")
def _(spark, d):
    return gr.pseudo_outcomes(pt(spark, d), "p_brand", F.col("bought") * F.col("m")).agg(F.count("*").alias("n"), F.corr("score", "psi").alias("pearson"))


@query("prediction_stability", f"WITH {EX}, a AS (SELECT row_number() OVER (ORDER BY base_premium DESC, quote_id) <= floor(count(*) OVER () * 0.1::DOUBLE) AS x, row_number() OVER (ORDER BY customer_id DESC, quote_id) <= floor(count(*) OVER () * 0.1::DOUBLE) AS y FROM ex) SELECT {n('count(*) FILTER (WHERE x AND y)', 'both')}, {r('count(*) FILTER (WHERE x AND y)/count(*) FILTER (WHERE x OR y)', 'jaccard')} FROM a")
def _(spark, d):
    return ex.top_overlap(T.experiment(spark, d).select("quote_id", "base_premium", "customer_id"), "base_premium", "customer_id", "quote_id", 0.1)


_PRED = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
_CM = f"{SC}, cm AS (SELECT y, {_PRED} AS pred, count(*) AS n FROM sc GROUP BY 1, 2), a AS (SELECT y AS class, sum(n) AS support, coalesce(sum(n) FILTER (WHERE y = pred), 0) AS hit FROM cm GROUP BY 1), b AS (SELECT pred AS class, sum(n) AS predicted FROM cm GROUP BY 1), c AS (SELECT class, support, hit, hit/support AS sens, coalesce(hit/predicted, 0) AS prec FROM a LEFT JOIN b USING (class))"


@query("confusion_summary", f"WITH {_CM} SELECT {r('sum(hit)/sum(support)', 'accuracy')}, {r('avg(sens)', 'balanced_accuracy')}, {r('avg(CASE WHEN sens + prec > 0 THEN 2*sens*prec/(sens + prec) ELSE 0 END)', 'macro_f1')} FROM c")
def _(spark, d):
    return ra.confusion_summary(ra.confusion_report(ra.confusion(T.scored_sample(spark, d))))


@query("roc_curve", f"WITH {SC}, c AS (SELECT round(p2, 4) AS s, sum(CAST(y = 2 AS BIGINT)) AS pos, sum(CAST(y <> 2 AS BIGINT)) AS neg FROM sc GROUP BY 1) SELECT {r('sum(neg) OVER d / sum(neg) OVER ()', 'fpr')}, {r('sum(pos) OVER d / sum(pos) OVER ()', 'tpr')} FROM c WINDOW d AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE")
def _(spark, d):
    return ra.roc_curve(T.scored_sample(spark, d).withColumn("s", F.round("p2", 4)), "s", F.col("y") == 2)


@query("iso_slice", f"WITH {_SURFACE}, f AS (SELECT s0, max(s1) AS s1 FROM surface WHERE s2 >= 0.3::DOUBLE GROUP BY 1) SELECT {r('s0', 's0')}, {r('s1', 's1')} FROM f QUALIFY s1 > coalesce(max(s1) OVER (ORDER BY s0 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)")
def _(spark, d):
    return su.iso_slice(mesh(spark, d), "s0", "s1", "s2", 0.3)


@query("overlap_shares", f"WITH {SC} SELECT {r('avg(CAST(least(p0, p1, p2) < 0.02::DOUBLE AS DOUBLE))', 'share_below_2')}, {r('avg(CAST(least(p0, p1, p2) < 0.05::DOUBLE AS DOUBLE))', 'share_below_5')} FROM sc")
def _(spark, d):
    m = F.least(*ra.P)
    return T.scored_sample(spark, d).agg(F.avg((m < 0.02).cast("double")).alias("share_below_2"), F.avg((m < 0.05).cast("double")).alias("share_below_5"))


@query("vus_test", None)
def _(spark, d):
    return rs.tested_against_chance(ra.vus_with_error(ra.sampled_trios(T.scored_sample(spark, d))))


@query("slope_tests", None)
def _(spark, d):
    return rs.slope_tests(gr.blp_slope(gr.gates_loglinear(pt(spark, d), "score")))


@query("sensitivity_intervals", None)
def _(spark, d):
    return rs.sensitivity_intervals(ra.confusion(T.scored_sample(spark, d)))


@query("fingerprint", None)
def _(spark, d):
    return rs.fingerprint(clean(spark, d), ["stock_code", "week", "quantity", "price"])


# ---- demand models with controls ---------------------------------------------------------------


def frame_step(spark, d):
    """The features and where they lie. They and their panel are written once: features read the panel in five branches, and fits pass
    over the features many times, where each pass would join, group and shuffle the lines anew."""
    held, place = written_step(panel(spark, d), "panel")
    found = written_step(fe.add_features(held), "frame")
    dropped_step(spark, place)
    return found


def frame(spark, d):
    """The written features, which the result may still read."""
    return frame_step(spark, d)[0]


@query("pooled_controls", None)
def _(spark, d):
    f = frame(spark, d)
    fit = de.pooled(f)
    return gr.predictive_metrics(f, F.col("log_qty"), fit.index()).withColumn("elasticity", F.lit(fit.elasticity))


@query("poisson_demand", None)
def _(spark, d):
    f = frame(spark, d)
    fit = de.poisson(f)
    return gr.predictive_metrics(f, F.col("log_qty"), fit.index()).withColumn("elasticity", F.lit(fit.elasticity))


@query("boosted_demand", None)
def _(spark, d):
    return de.boosted_elasticity(frame(spark, d)).select("stock_code", "week", "predicted", "elasticity")


@query("double_ml", None)
def _(spark, d):
    return de.double_ml(frame(spark, d))


@query("r_learner", None)
def _(spark, d):
    return de.r_learner(de.crossfit_residuals(frame(spark, d))).select("stock_code", "week", "ry", "rt", "elasticity")


@query("orthogonal_gates", None)
def _(spark, d):
    return de.orthogonal_gates(de.r_learner(de.crossfit_residuals(frame(spark, d))))


@query("observational_value", None)
def _(spark, d):
    return de.observational_value(de.r_learner(de.crossfit_residuals(frame(spark, d))))


@query("r_loss", None)
def _(spark, d):
    return de.r_loss(de.r_learner(de.crossfit_residuals(frame(spark, d))))


# ---- boosted learners and price levels ---------------------------------------------------------

#: Fewer rounds than a tuned model would take; every round is a pass a level.
_GROW = {"rounds": 20, "depth": 3, "rate": 0.2, "subsample": 0.8}


def offers_of(spark, d):
    """What conversion models read of the price test, written once for their passes; the result still reads it."""
    return written_step(pt(spark, d).select("row_id", "arm", F.ln("m").alias("log_m"), "bought", "score", "gain"), "offers")[0]


@query("conversion_boosted", None)
def _(spark, d):
    offers = offers_of(spark, d)
    fit = le.conversion(offers, ["score", "gain"], ("log_m",), "bought", F.col("row_id"), **_GROW)
    return fit.applied(offers).select("row_id", "conversion", "elasticity")


@query("arm_effects", None)
def _(spark, d):
    psi = le.augmented_arms(offers_of(spark, d), ["score", "gain"], "bought", "arm", [1 / 3] * 3, F.col("row_id"), **_GROW)
    return le.arm_effects(psi, ["score", "gain"], list(M), F.col("row_id"), **_GROW).select("row_id", "psi0", "psi1", "psi2", "s0", "s1", "s2", "elasticity")


_RISKS = ["risk", "base_premium"]


@query("offset_pairs", None)
def _(spark, d):
    df = T.experiment(spark, d)
    h, low = (le.offset_pair(df, _RISKS, a, F.col("quote_id"), reg=10.0, **_GROW).predict()[0] for a in ("H", "L"))
    found = df.select("quote_id", h.alias("h"), low.alias("l"))
    return found.select("quote_id", F.least("h", F.lit(0.0)).alias("log_rr_h"), F.greatest("l", F.lit(0.0)).alias("log_rr_l"))


@query("weighted_arms", None)
def _(spark, d):
    df = T.experiment(spark, d)
    m = le.inverse_weighted_arms(df, _RISKS, F.col("quote_id"), reg=10.0, **_GROW).predict()
    found = df.select("quote_id", m.alias("m"))
    return found.select("quote_id", (F.col("m")[0] - F.col("m")[1]).alias("log_rr_h"), (F.col("m")[2] - F.col("m")[1]).alias("log_rr_l"))


@query("scalar_flip", None)
def _(spark, d):
    df = T.experiment(spark, d)
    raw = le.scalar_flip(df, _RISKS, _Z, F.col("quote_id"), reg=10.0, min_weight=0.02, **_GROW).predict()[0]
    return df.select("quote_id", raw.alias("raw")).select("quote_id", pr.softplus(F.col("raw")).alias("beta"))


@query("moment_forest", None)
def _(spark, d):
    df = T.experiment(spark, d)
    return df.select("quote_id", le.moment_forest(df, _RISKS, _Z, F.col("quote_id")).alias("beta"))


@query("price_level_curves", None)
def _(spark, d):
    f = frame(spark, d)
    fit = le.PriceLevels(options={"rounds": 10, "depth": 3, "rate": 0.3}).fit(f, F.concat_ws("|", "stock_code", "week"))
    return fit.applied(f).select("stock_code", "week", "level", *[f"{c}{i}" for c in ("pi", "b", "d") for i in range(3)], "arc0", "arc1", "elasticity")


@query("crossfit_pairs", None)
def _(spark, d):
    found, fit = st.crossfit_pair(T.experiment(spark, d), _RISKS, "H", "customer_id", F.col("quote_id"), reg=10.0, **_GROW)
    return found.select("quote_id", "fold", "raw", "calibrated", F.lit(fit.slope).alias("slope"))


@query("stacked_pairs", None)
def _(spark, d):
    """Two learners of one log ratio, each read out of its group's fold, and the convex mixture of them."""
    df = T.experiment(spark, d)
    deep, _fit = st.crossfit_pair(df, _RISKS, "L", "customer_id", F.col("quote_id"), reg=10.0, **_GROW)
    flat, _fit = st.crossfit_pair(df, _RISKS, "L", "customer_id", F.col("quote_id"), reg=10.0, rounds=20, depth=1, rate=0.2)
    both = deep.join(flat.select("quote_id", F.col("raw").alias("flat")), "quote_id")
    fit = st.stack(both, [F.col("raw"), F.col("flat")], F.col("arm") == "L", F.ln(F.col("pi_L") / F.col("pi_C")), "low")
    return both.select("quote_id", "raw", "flat", fit.log_rr([F.col("raw"), F.col("flat")]).alias("stacked"), F.lit(fit.weights[0]).alias("weight"))


@query("twoway_controls", None)
def _(spark, d):
    f = frame(spark, d)
    fit = ef.two_way(f)
    return fit.predict(f).select("stock_code", "week", "predicted", F.lit(fit.elasticity).alias("elasticity"))


@query("hum_priorities", None)
def _(spark, d):
    """Five classes, the orders' priorities, scored by their price."""
    o = T.table(spark, d, "orders")
    at = F.col("o_totalprice") / 100_000
    sample = o.select(F.col("o_orderkey").alias("row_id"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y"), *[F.exp(-F.pow(at - k, 2) / 4).alias(f"p{k}") for k in range(5)])
    return ma.hum(sample, [f"p{k}" for k in range(5)], "row_id")


@query("conversion_linear", None)
def _(spark, d):
    offers = offers_of(spark, d)
    return lo.logit(offers, ["score", "gain"], "log_m", "bought").applied(offers).select("row_id", "conversion", "elasticity")


@query("conversion_curved", None)
def _(spark, d):
    offers = offers_of(spark, d)
    fit = lo.logit(offers, ["score", "gain"], "log_m", "bought", curved=("score",), varying=("score", "gain"))
    return fit.applied(offers).select("row_id", "conversion", "elasticity")


@query("double_ml_boosted", None)
def _(spark, d):
    return de.theta(de.boosted_residuals(frame(spark, d), **_GROW)).select("n", (-F.col("theta")).alias("elasticity"), "se")


@query("level_sums", f"WITH {PT} SELECT row_id, {r('p0', 'up0')}, {r('p0 + p1', 'up1')}, {r('p0 + p1 + p2', 'up2')}, {r('p2 + p1 + p0', 'down0')}, {r('p2 + p1', 'down1')}, {r('p2', 'down2')} FROM pt")
def _(spark, d):
    p = [F.col(c) for c in ra.P]
    up, down = pr.running_levels(p), pr.running_levels(p, downward=True)
    return pt(spark, d).select("row_id", *[c.alias(f"up{k}") for k, c in enumerate(up)], *[c.alias(f"down{k}") for k, c in enumerate(down)])


@query("model_comparison", None)
def _(spark, d):
    """Orthogonal losses of three models of elasticity on the same cross-fitted residuals."""
    f = frame(spark, d)
    scored = de.r_learner(de.crossfit_residuals(f)).withColumnRenamed("elasticity", "r_learner")
    fixed = scored.withColumns({"pooled": F.lit(de.pooled(f).elasticity), "two_way": F.lit(ef.two_way(f).elasticity)})
    return de.compared(fixed, ["pooled", "two_way", "r_learner"])


# ---- search over settings ----------------------------------------------------------------------


def on_written(spark, d, work):
    """What ``work`` finds on the frame; what it finds must no longer read it."""
    held, place = frame_step(spark, d)
    found = work(held)
    dropped_step(spark, place)
    return found


def scorer(f, splits=5):
    weeks = tu.calendar(f)
    return tu.Scorer.of(f, tu.Folds.of(weeks, tu.spans(len(weeks), splits)))


def histories(spark, d, trials=40):
    """Seeded searches of the two models in closed form, by the orthogonal loss."""

    def work(f):
        held = scorer(f)
        return [tu.history(spark, m, tu.tune(held, m, trials)) for m in tu.CLOSED]

    found = on_written(spark, d, work)
    return found[0].unionByName(found[1])


@query("tuning_history", None)
def _(spark, d):
    done = histories(spark, d).filter("state = 'complete'")
    return re_.running_best(done, "model", "trial", "value")


@query("tuned_models", None)
def _(spark, d):
    h = histories(spark, d)
    top = re_.arg_best(h.filter("state = 'complete'"), "model", "trial", "value").select("model", "trial")
    states = h.groupBy("model").agg(*[F.count(F.when(F.col("state") == s, 1)).alias(f"n_{s}") for s in ("complete", "pruned", "failed")])
    return h.join(top, ["model", "trial"]).join(states, "model")


@query("tuning_by_fits", None)
def _(spark, d):
    """A model without closed form: a fit a fold, the rule saving those of the trials it ends."""
    return on_written(spark, d, lambda f: tu.history(spark, "poisson_glm", tu.tune(scorer(f, 3), "poisson_glm", 6, "rmse", rule=tu.MedianRule(startup=2))))


@query("objective_comparison", None)
def _(spark, d):
    return on_written(spark, d, lambda f: tu.objective_comparison(scorer(f), "shrunk_per_product", ("rmse", "rloss", "rloss_vs_constant")))


@query("nested_validation", None)
def _(spark, d):
    return on_written(spark, d, lambda f: tu.nested(f, "pooled_loglog").unionByName(tu.nested(f, "shrunk_per_product")))
