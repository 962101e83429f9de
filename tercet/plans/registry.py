"""All queries of the library by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tercet.operators import experiment as ex
from tercet.operators import features as fe
from tercet.operators import grading as gr
from tercet.operators import models as mo
from tercet.operators import ranking as ra
from tercet.operators import relational as re_
from tercet.operators import replicates as rp
from tercet.operators import resampling as rs
from tercet.operators import surface as su
from tercet.operators import trios
from tercet.plans import views as V
from tercet.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Added before rounding, so that exact halves round alike whatever the order of a sum.
TIE = 2e-9


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Fixed types: whole numbers as long, measures as rounded double."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "bigint", "smallint", "tinyint"):
            out.append(c.cast("long").alias(name))
        elif kind in ("double", "float") or kind.startswith("decimal"):
            value = F.round(c.cast("double") + TIE, places)
            out.append(F.when(value == 0, F.lit(0.0)).otherwise(value).alias(name))
        else:
            out.append(c)
    return df.select(*out)


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is its SQL, with views given as CTEs."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def r(expression: str, name: str, places: int = 6) -> str:
    """A rounded double in SQL; negative zero is zero."""
    return f"round(CAST({expression} AS DOUBLE) + {TIE}, {places}) + 0.0 AS {name}"


def n(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


CLEAN = f"""{V.TXN}, clean AS (SELECT invoice, upper(trim(stock_code)) AS stock_code, description, quantity, ts, price, customer, l_linenumber, date_trunc('week', ts) AS week FROM txn
  WHERE quantity > 0 AND price > 0 AND NOT starts_with(invoice, 'C') AND upper(trim(stock_code)) NOT IN ({", ".join(f"'{c}'" for c in re_.NON_PRODUCT_CODES)}) AND length(upper(trim(stock_code))) BETWEEN 4 AND 12)"""
PANEL = f"""{CLEAN}, modal AS (SELECT stock_code, week, price FROM (SELECT stock_code, week, price, row_number() OVER (PARTITION BY stock_code, week ORDER BY count(*) DESC, price) AS k FROM clean GROUP BY 1, 2, 3) WHERE k = 1),
weekly AS (SELECT stock_code, week, sum(quantity) AS qty, sum(quantity*price) AS revenue, count(*) AS n_lines, count(DISTINCT customer) AS n_customers, quantile_cont(price, 0.5) AS price_median FROM clean GROUP BY 1, 2),
panel AS (SELECT w.*, m.price AS price_modal, revenue/qty AS price_unitvalue FROM weekly w JOIN modal m USING (stock_code, week) WHERE qty >= 1 QUALIFY count(*) OVER (PARTITION BY stock_code) >= 20)"""
LOGS = f"{PANEL}, logs AS (SELECT *, ln(greatest(qty, 1)) AS log_qty, ln(price_modal) AS log_price FROM panel)"


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.clean_transactions(T.transactions(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.build_panel(clean(spark, sf_dir))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).withColumns({"log_qty": F.ln(F.greatest("qty", F.lit(1)).cast("double")), "log_price": F.ln("price_modal")})


# ---- relational ------------------------------------------------------------------------------


@query("clean_transactions", f"WITH {CLEAN} SELECT stock_code, week, {n('count(*)', 'n_lines')}, {n('sum(quantity)', 'units')}, {r('avg(price)', 'mean_price', 3)} FROM clean GROUP BY 1, 2")
def _(spark, d):
    return clean(spark, d).groupBy("stock_code", "week").agg(F.count("*").alias("n_lines"), F.sum("quantity").alias("units"), F.round(F.avg("price") + TIE, 3).alias("mean_price"))


@query("build_panel", f"WITH {PANEL} SELECT stock_code, week, {n('qty', 'qty')}, {r('revenue', 'revenue', 4)}, {n('n_lines', 'n_lines')}, {n('n_customers', 'n_customers')}, {r('price_modal', 'price_modal', 3)}, {r('price_median', 'price_median', 3)}, {r('price_unitvalue', 'price_unitvalue', 3)} FROM panel")
def _(spark, d):
    return panel(spark, d).withColumns({"revenue": F.round(F.col("revenue") + TIE, 4), **{c: F.round(F.col(c) + TIE, 3) for c in ("price_modal", "price_median", "price_unitvalue")}})


@query("panel_semi_join", f"WITH {CLEAN}, big AS (SELECT stock_code FROM clean GROUP BY 1 HAVING count(DISTINCT week) >= 300) SELECT stock_code, {n('count(*)', 'n_lines')} FROM clean WHERE stock_code IN (SELECT stock_code FROM big) GROUP BY 1")
def _(spark, d):
    lines = clean(spark, d)
    big = lines.groupBy("stock_code").agg(F.countDistinct("week").alias("w")).filter("w >= 300").select("stock_code")
    return lines.join(big, "stock_code", "left_semi").groupBy("stock_code").agg(F.count("*").alias("n_lines"))


@query("dedup_check", f"WITH {V.TXN} SELECT {n('sum(c)', 'n_rows')}, {n('count(*)', 'n_keys')}, {n('sum(c) - count(*)', 'n_duplicates')} FROM (SELECT count(*) AS c FROM txn GROUP BY invoice, stock_code)")
def _(spark, d):
    return re_.duplicate_count(T.transactions(spark, d), "invoice", "stock_code")


@query("one_to_one_join", f"SELECT {n('count(*)', 'n_rows')}, {n('count(r.o_orderkey)', 'n_matched')}, {n('count(*) - count(r.o_orderkey)', 'n_unmatched')}, (SELECT {n('count(*)', 'k')} FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys FROM orders l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 > 0) r USING (o_orderkey)")
def _(spark, d):
    orders = T.table(spark, d, "orders")
    return re_.validated_one_to_one(orders.select("o_orderkey"), orders.filter("o_orderkey % 3 > 0").select("o_orderkey"), "o_orderkey")


@query("group_overlap", f"WITH {V.TXN}, a AS (SELECT DISTINCT customer FROM txn WHERE ts < '1998-01-01'), b AS (SELECT DISTINCT customer FROM txn WHERE ts >= '1998-01-01') SELECT {n('count(*) FILTER (WHERE a.customer IS NOT NULL AND b.customer IS NOT NULL)', 'n_both')}, {n('count(*) FILTER (WHERE b.customer IS NULL)', 'n_only_a')}, {n('count(*) FILTER (WHERE a.customer IS NULL)', 'n_only_b')} FROM a FULL JOIN b USING (customer)")
def _(spark, d):
    t = T.transactions(spark, d)
    return re_.group_overlap(t.filter("ts < timestamp'1998-01-01'"), t.filter("ts >= timestamp'1998-01-01'"), "customer")


_HISTORY = """history AS (SELECT o_orderpriority AS model, o_custkey AS trial, min(o_totalprice) AS loss FROM orders GROUP BY 1, 2)"""


def history(spark: SparkSession, d: str) -> DataFrame:
    """A trial history in shape: one loss per model and trial."""
    return T.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("trial")).agg(F.min("o_totalprice").alias("loss"))


@query("union_histories", f"WITH {_HISTORY} SELECT model, {n('count(*)', 'n')}, {n('count(pruned)', 'n_pruned')} FROM (SELECT model, trial, loss, NULL AS pruned FROM history WHERE trial % 2 = 0 UNION ALL SELECT model, trial, loss, 1 FROM history WHERE trial % 2 = 1) GROUP BY 1")
def _(spark, d):
    h = history(spark, d)
    return h.filter("trial % 2 = 0").unionByName(h.filter("trial % 2 = 1").withColumn("pruned", F.lit(1)), allowMissingColumns=True).groupBy("model").agg(F.count("*").alias("n"), F.count("pruned").alias("n_pruned"))


@query("running_best", f"WITH {_HISTORY} SELECT model, trial, {r('loss', 'loss')}, {r('min(loss) OVER w', 'best_so_far')}, loss = min(loss) OVER w AS is_best FROM history WINDOW w AS (PARTITION BY model ORDER BY trial ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    return re_.running_best(history(spark, d), "model", "trial", "loss")


@query("arg_best", f"WITH {_HISTORY} SELECT model, trial, {r('loss', 'loss')} FROM history QUALIFY row_number() OVER (PARTITION BY model ORDER BY loss, trial) = 1")
def _(spark, d):
    return re_.arg_best(history(spark, d), "model", "trial", "loss")


@query("top_fraction", f"WITH {V.PRICE_TEST} SELECT row_id, {r('score', 'score')} FROM pt QUALIFY row_number() OVER (ORDER BY score DESC, row_id) <= floor(count(*) OVER () * 0.1::DOUBLE)")
def _(spark, d):
    return re_.top_fraction(T.price_test(spark, d).select("row_id", "score"), "score", "row_id", 0.1)


@query("seeded_subset", f"WITH {CLEAN}, chosen AS (SELECT stock_code FROM (SELECT DISTINCT stock_code FROM clean) ORDER BY md5('s1' || stock_code) LIMIT 5) SELECT stock_code, {n('count(*)', 'n_lines')} FROM clean WHERE stock_code IN (SELECT stock_code FROM chosen) GROUP BY 1")
def _(spark, d):
    return re_.seeded_subset(clean(spark, d), "stock_code", 5, "s1").groupBy("stock_code").agg(F.count("*").alias("n_lines"))


@query("pivot_report", f"WITH {V.EXPERIMENT} SELECT customer_id % 10 AS bucket, {n('count(*) FILTER (WHERE arm = ' + chr(39) + 'H' + chr(39) + ')', 'H')}, {n('count(*) FILTER (WHERE arm = ' + chr(39) + 'C' + chr(39) + ')', 'C')}, {n('count(*) FILTER (WHERE arm = ' + chr(39) + 'L' + chr(39) + ')', 'L')} FROM ex GROUP BY 1")
def _(spark, d):
    e = T.experiment(spark, d).withColumn("bucket", F.col("customer_id") % 10)
    return re_.pivoted(e, "bucket", "arm", list(ex.ARMS), F.count(F.lit(1))).na.fill(0)


@query("forward_time_holdout", f"WITH {V.EXPERIMENT}, g AS (SELECT customer_id, max(quote_timestamp) AS last_ts, count(*) AS n_rows FROM ex GROUP BY 1) SELECT customer_id, last_ts, {n('n_rows', 'n_rows')}, {r('percent_rank() OVER (ORDER BY last_ts, customer_id)', 'place')}, {n('percent_rank() OVER (ORDER BY last_ts, customer_id) >= 0.8::DOUBLE', 'holdout')} FROM g")
def _(spark, d):
    return re_.forward_time_holdout(T.experiment(spark, d), "customer_id", "quote_timestamp")


@query("frame_summary", f"WITH {PANEL} SELECT {n('count(*)', 'n_rows')}, {n('count(DISTINCT stock_code)', 'n_products')}, {n('count(DISTINCT week)', 'n_weeks')}, {r('avg(price_modal)', 'mean_price')}, {r('quantile_cont(qty, 0.5)', 'median_qty')} FROM panel")
def _(spark, d):
    return panel(spark, d).agg(F.count("*").alias("n_rows"), F.countDistinct("stock_code").alias("n_products"), F.countDistinct("week").alias("n_weeks"), F.avg("price_modal").alias("mean_price"), F.median("qty").alias("median_qty"))


# ---- features --------------------------------------------------------------------------------

_FEATURES = f"""{LOGS}, s AS (SELECT stock_code, avg(log_price) AS pm, stddev_samp(log_price) AS ps, avg(log_qty) AS qm, count(*) AS nw FROM logs GROUP BY 1),
mk AS (SELECT week, sum(qty) AS q, sum(log_price) AS lp, count(*) AS k FROM logs GROUP BY 1), f0 AS (SELECT min(week) AS w0 FROM logs),
f1 AS (SELECT *, lag(log_qty) OVER b AS lag_log_qty, coalesce(lag(log_qty, 2) OVER b, lag(log_qty) OVER b) AS lag2_log_qty,
  avg(log_qty) OVER (b ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS roll4_log_qty, avg(log_qty) OVER (b ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS roll12_log_qty,
  lag(log_price) OVER b AS lag_log_price, avg(log_price) OVER (b ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS roll4_log_price,
  avg(log_price) OVER (b ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rel, lag(n_customers) OVER b AS lag_n_customers, lag(n_lines) OVER b AS lag_n_lines,
  min(week) OVER (PARTITION BY stock_code) AS launch FROM logs WINDOW b AS (PARTITION BY stock_code ORDER BY week))"""


@query("add_features", f"""WITH {_FEATURES} SELECT stock_code, week, {r('log_qty', 'log_qty')}, {r('log_price', 'log_price')}, {r("floor(date_diff('day', w0, week)/7)", 'week_idx')},
  {r('sin(2*pi()*weekofyear(week)/52.0::DOUBLE)', 'woy_sin')}, {r('cos(2*pi()*weekofyear(week)/52.0::DOUBLE)', 'woy_cos')}, {r('month(week) IN (10, 11, 12)', 'is_q4')}, {r("floor(date_diff('day', launch, week)/7)", 'weeks_since_launch')},
  {r('pm', 'prod_log_price_mean')}, {r('coalesce(ps, 0)', 'prod_log_price_sd')}, {r('qm', 'prod_log_qty_mean')}, {r('nw', 'prod_n_weeks')}, {r('lag_log_qty', 'lag_log_qty')}, {r('lag2_log_qty', 'lag2_log_qty')}, {r('roll4_log_qty', 'roll4_log_qty')}, {r('roll12_log_qty', 'roll12_log_qty')},
  {r('lag_log_price', 'lag_log_price')}, {r('roll4_log_price', 'roll4_log_price')}, {r('lag_n_customers', 'lag_n_customers')}, {r('lag_n_lines', 'lag_n_lines')}, {r('ln(greatest(q - qty, 1))', 'market_log_qty')}, {r('(lp - log_price)/greatest(k - 1, 1)', 'market_log_price')},
  {r('log_price - rel', 'rel_price')}, {r('log_price - lag_log_price', 'price_change')}, {r('log_price - rel < -0.02::DOUBLE', 'is_discounted')}
  FROM f1 JOIN s USING (stock_code) JOIN mk USING (week), f0 WHERE lag_log_qty IS NOT NULL AND lag_log_price IS NOT NULL""")
def _(spark, d):
    return fe.add_features(panel(spark, d))


@query("loo_market_controls", f"WITH {LOGS} SELECT stock_code, week, {n('sum(qty) OVER w - qty', 'other_units')}, {r('(sum(log_price) OVER w - log_price)/greatest(count(*) OVER w - 1, 1)', 'other_log_price')} FROM logs WINDOW w AS (PARTITION BY week)")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("week")
    return logs(spark, d).select("stock_code", "week", (F.sum("qty").over(w) - F.col("qty")).alias("other_units"), ((F.sum("log_price").over(w) - F.col("log_price")) / F.greatest(F.count("*").over(w) - 1, F.lit(1))).alias("other_log_price"))


@query("calendar_features", f"WITH {PANEL} SELECT DISTINCT week, {n('weekofyear(week)', 'iso_week')}, {n('month(week) IN (10, 11, 12)', 'is_q4')}, {n('row_number() OVER (ORDER BY week) - 1', 'week_no')} FROM (SELECT DISTINCT week FROM panel)")
def _(spark, d):
    return fe.week_numbers(panel(spark, d)).select("week", F.weekofyear("week").alias("iso_week"), F.month("week").isin(10, 11, 12).cast("int").alias("is_q4"), "week_no")


def _folds_sql(gap: int) -> str:
    return f"""WITH {PANEL}, weeks AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS week_no FROM (SELECT DISTINCT week FROM panel)), c AS (SELECT count(*) AS n FROM weeks),
f AS (SELECT DISTINCT vs, least(vs + 8, n - 1) AS ve FROM (SELECT n, CAST(floor({26 + gap} + (n - 8 - {26 + gap}) * k / 4) AS BIGINT) AS vs FROM c, range(5) t(k))),
folds AS (SELECT row_number() OVER (ORDER BY vs) - 1 AS fold, vs - {gap} AS te, vs, ve FROM f WHERE ve > vs)
SELECT {n('fold', 'fold')}, side, {n('count(*)', 'n_rows')}, {n('count(DISTINCT stock_code)', 'n_products')}, {n('min(week_no)', 'first_week')}, {n('max(week_no)', 'last_week')} FROM (
SELECT fold, stock_code, week_no, CASE WHEN week_no < te THEN 'train' WHEN week_no >= vs AND week_no < ve THEN 'valid' END AS side FROM panel JOIN weeks USING (week), folds) WHERE side IS NOT NULL GROUP BY ALL"""


@query("rolling_origin_folds", _folds_sql(0))
def _(spark, d):
    p = panel(spark, d)
    w = fe.week_numbers(p)
    return fe.fold_sizes(p, w, fe.rolling_origin_folds(w))


@query("purged_folds", _folds_sql(12))
def _(spark, d):
    p = panel(spark, d)
    w = fe.week_numbers(p)
    return fe.fold_sizes(p, w, fe.rolling_origin_folds(w, gap=12))


@query("division_bias", f"""WITH {CLEAN}, l AS (SELECT ln(quantity) AS lq, ln(price) AS lp, stock_code, week FROM clean), w AS (SELECT lq - avg(lq) OVER k AS x, lp - avg(lp) OVER k AS y FROM l WINDOW k AS (PARTITION BY stock_code, week)),
s AS (SELECT count(*) AS n, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(y*y) AS syy FROM w) SELECT {n('n', 'n')}, {r('sxy/sxx', 'slope')}, {r('(sxy/sxx)/sqrt((syy - sxy/sxx*sxy)/(n - 2)/sxx)', 't_value', 4)} FROM s""")
def _(spark, d):
    return fe.division_bias(clean(spark, d)).withColumn("t_value", F.round("t_value", 4))


@query("naive_bias", f"""WITH {LOGS}, s AS (SELECT covar_samp(log_qty, log_price) AS yt, var_samp(log_price) AS tt, avg(1 + log_price/10) AS truth, covar_samp(n_lines, log_price) AS ut FROM logs)
SELECT {r('-yt/tt', 'ols_elasticity')}, {r('truth', 'truth')}, {r('-yt/tt - truth', 'bias')}, {r('-ut/tt', 'confounding')}, {r('-yt/tt - truth + ut/tt', 'remainder')} FROM s""")
def _(spark, d):
    return fe.naive_bias(logs(spark, d).withColumns({"truth": 1 + F.col("log_price") / 10, "u": F.col("n_lines").cast("double")}), "log_qty", "log_price", "truth", "u")


# ---- ranking ---------------------------------------------------------------------------------

SC = V.scored()
_AUC = "sum(pos*(coalesce(below, 0) + 0.5::DOUBLE*neg))/sum(pos)/sum(neg)"


@query("prepare_scores", f"WITH {SC} SELECT row_id, {n('y', 'y')}, {r('ln(greatest(p0/(p0+p1+p2), 1e-300)) - ln(greatest(p1/(p0+p1+p2), 1e-300))', 'd01')}, {r('ln(greatest(p0/(p0+p1+p2), 1e-300)) - ln(greatest(p2/(p0+p1+p2), 1e-300))', 'd02')} FROM sc")
def _(spark, d):
    return ra.prepared(T.scored_sample(spark, d)).select("row_id", "y", "d01", "d02")


@query("binary_auc", f"WITH {SC}, c AS (SELECT round(p0, 9) AS s, sum(CAST(y = 0 AS BIGINT)) AS pos, sum(CAST(y <> 0 AS BIGINT)) AS neg FROM sc GROUP BY 1), w AS (SELECT *, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM c) SELECT {n('sum(pos)', 'n_pos')}, {n('sum(neg)', 'n_neg')}, {r(_AUC, 'auc')} FROM w")
def _(spark, d):
    return ra.auc(T.scored_sample(spark, d).withColumn("s", F.round("p0", 9)), "s", F.col("y") == 0, [])


_OVR = f"WITH {SC}, l AS (SELECT y, 0 AS class, round(p0, 9) AS s FROM sc UNION ALL SELECT y, 1, round(p1, 9) FROM sc UNION ALL SELECT y, 2, round(p2, 9) FROM sc), c AS (SELECT class, s, sum(CAST(y = class AS BIGINT)) AS pos, sum(CAST(y <> class AS BIGINT)) AS neg FROM l GROUP BY 1, 2), w AS (SELECT *, sum(neg) OVER (PARTITION BY class ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM c)"


def nine(spark: SparkSession, d: str) -> DataFrame:
    return T.scored_sample(spark, d).withColumns({p: F.round(p, 9) for p in ra.P})


@query("ovr_auc", f"{_OVR} SELECT {n('class', 'class')}, {n('sum(pos)', 'n_pos')}, {n('sum(neg)', 'n_neg')}, {r(_AUC, 'auc')} FROM w GROUP BY class")
def _(spark, d):
    return ra.ovr_auc(nine(spark, d))


_OVO = f"""WITH {SC}, e(i, j) AS (VALUES (0,1),(0,2),(1,0),(1,2),(2,0),(2,1)), l AS (SELECT i, j, y, round(CASE i WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 9) AS s FROM sc, e WHERE y = i OR y = j),
c AS (SELECT i, j, s, sum(CAST(y = i AS BIGINT)) AS pos, sum(CAST(y = j AS BIGINT)) AS neg FROM l GROUP BY 1, 2, 3), w AS (SELECT *, sum(neg) OVER (PARTITION BY i, j ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM c), a AS (SELECT i, j, sum(pos) AS n_pos, sum(neg) AS n_neg, {_AUC} AS auc FROM w GROUP BY 1, 2)"""


@query("ovo_auc", f"{_OVO} SELECT {n('i', 'i')}, {n('j', 'j')}, {n('n_pos', 'n_pos')}, {n('n_neg', 'n_neg')}, {r('auc', 'auc')} FROM a")
def _(spark, d):
    return ra.ovo_auc(nine(spark, d))


@query("hand_till", f"{_OVO} SELECT {r('avg(auc)', 'm')} FROM a")
def _(spark, d):
    return ra.hand_till(nine(spark, d))


@query("roc_points", f"WITH {SC}, c AS (SELECT round(p2, 4) AS threshold, sum(CAST(y = 2 AS BIGINT)) AS pos, sum(CAST(y <> 2 AS BIGINT)) AS neg FROM sc GROUP BY 1) SELECT {r('threshold', 'threshold')}, {r('sum(neg) OVER d / sum(neg) OVER ()', 'fpr')}, {r('sum(pos) OVER d / sum(pos) OVER ()', 'tpr')} FROM c WINDOW d AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    return ra.roc_points(T.scored_sample(spark, d).withColumn("s", F.round("p2", 4)), "s", F.col("y") == 2)


_PRED = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"


@query("confusion_report", f"""WITH {SC}, cm AS (SELECT y, {_PRED} AS pred, count(*) AS n FROM sc GROUP BY 1, 2), a AS (SELECT y AS class, sum(n) AS support, sum(n) FILTER (WHERE y = pred) AS hit FROM cm GROUP BY 1), b AS (SELECT pred AS class, sum(n) AS predicted FROM cm GROUP BY 1),
c AS (SELECT class, support, coalesce(hit, 0)/support AS sens, CASE WHEN coalesce(predicted, 0) > 0 THEN coalesce(hit, 0)/predicted ELSE 0 END AS prec FROM a LEFT JOIN b USING (class)) SELECT {n('class', 'class')}, {n('support', 'support')}, {r('sens', 'sensitivity')}, {r('prec', 'precision')}, {r('CASE WHEN sens + prec > 0 THEN 2*sens*prec/(sens + prec) ELSE 0 END', 'f1')} FROM c""")
def _(spark, d):
    return ra.confusion_report(ra.confusion(T.scored_sample(spark, d)))


@query("vus_ordinal", f"""WITH {SC}, c AS (SELECT marker AS s, sum(CAST(y = 2 AS BIGINT)) AS a, sum(CAST(y = 1 AS BIGINT)) AS b, sum(CAST(y = 0 AS BIGINT)) AS c FROM sc GROUP BY 1), w AS (SELECT *, coalesce(sum(a) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(c) OVER (u ROWS UNBOUNDED PRECEDING) AS upto, sum(a) OVER () AS na, sum(b) OVER () AS nb, sum(c) OVER () AS nc FROM c WINDOW u AS (ORDER BY s))
SELECT {r('sum(b*(below + 0.5::DOUBLE*a)*((nc - upto) + 0.5::DOUBLE*c))/any_value(na)/any_value(nb)/any_value(nc)', 'vus')} FROM w""")
def _(spark, d):
    return ra.vus_ordinal(T.scored_sample(spark, d), "marker", 2, 1, 0)


@query("trio_profile", None)
def _(spark, d):
    return ra.trio_profile(ra.sampled_trios(T.scored_sample(spark, d)))


@query("vus_inference", None)
def _(spark, d):
    return rs.tested_against_chance(trios.exact_volume(T.scored_sample(spark, d)))


@query("vus_sampled", None)
def _(spark, d):
    return ra.vus_with_error(ra.sampled_trios(T.scored_sample(spark, d)))


def _two_markers(spark: SparkSession, d: str) -> DataFrame:
    """The sample with its marker and a coarser score, as two markers of the same rows."""
    s = T.scored_sample(spark, d)
    return s.select("row_id", "y", F.round("marker", 2).alias("marker"), F.round("p2", 1).alias("coarse"))


@query("volume_bootstrap", None)
def _(spark, d):
    return rp.bootstrap_volume(_two_markers(spark, d), ["marker", "coarse"], (0, 1, 2), 200)


@query("volume_permutation", None)
def _(spark, d):
    return rp.permutation_test(_two_markers(spark, d), "marker", (0, 1, 2), 500)


@query("order_constraint", f"WITH {SC}, m AS (SELECT row_id, least(p1 - p0, p2 - p1) AS g FROM sc) SELECT {r('avg(CAST(g > 0 AS DOUBLE))', 'share_ordered')}, {r('min(g)', 'worst_margin')} FROM m")
def _(spark, d):
    return ra.order_check(T.scored_sample(spark, d)).drop("worst_row")


@query("gauge_normalize", f"WITH {SC}, g AS (SELECT exp(avg(ln(greatest(p0, 1e-300)))) AS g0, exp(avg(ln(greatest(p1, 1e-300)))) AS g1, exp(avg(ln(greatest(p2, 1e-300)))) AS g2 FROM sc) SELECT row_id, {n('y', 'y')}, {r('p0/g0/(p0/g0+p1/g1+p2/g2)', 'q0')}, {r('p1/g1/(p0/g0+p1/g1+p2/g2)', 'q1')}, {r('p2/g2/(p0/g0+p1/g1+p2/g2)', 'q2')} FROM sc, g")
def _(spark, d):
    return ra.gauge_normalized(T.scored_sample(spark, d))


@query("isotonic3", f"WITH {SC} SELECT row_id, {r('greatest(p0, (p0+p1)/2, (p0+p1+p2)/3)', 'v0')}, {r('least(greatest((p0+p1)/2, (p0+p1+p2)/3), greatest(p1, (p1+p2)/2))', 'v1')}, {r('least(p2, (p1+p2)/2, (p0+p1+p2)/3)', 'v2')} FROM sc")
def _(spark, d):
    v = ra.isotonic_decreasing3([F.col(p) for p in ra.P])
    return T.scored_sample(spark, d).select("row_id", *[c.alias(f"v{i}") for i, c in enumerate(v)])


@query("overlap_diagnostic", f"WITH {SC} SELECT {r('quantile_cont(least(p0, p1, p2), 0.01)', 'p1')}, {r('quantile_cont(least(p0, p1, p2), 0.05)', 'p5')}, {r('quantile_cont(least(p0, p1, p2), 0.5)', 'median')}, {r('avg(CAST(least(p0, p1, p2) < 0.05::DOUBLE AS DOUBLE))', 'share_low')} FROM sc")
def _(spark, d):
    m = T.scored_sample(spark, d).select(F.least(*ra.P).alias("m"))
    q = m.agg(F.percentile("m", F.array(F.lit(0.01), F.lit(0.05), F.lit(0.5))).alias("q"), F.avg((F.col("m") < 0.05).cast("double")).alias("share_low"))
    return q.select(F.col("q")[0].alias("p1"), F.col("q")[1].alias("p5"), F.col("q")[2].alias("median"), "share_low")


# ---- surfaces --------------------------------------------------------------------------------

_DD = f"""{SC}, dd AS (SELECT y, round(l0 - l1, 6) AS d01, round(l0 - l2, 6) AS d02, round(l1 - l2, 6) AS d12, count(*) AS n FROM (SELECT y, ln(greatest(p0/(p0+p1+p2), 1e-300)) AS l0, ln(greatest(p1/(p0+p1+p2), 1e-300)) AS l1, ln(greatest(p2/(p0+p1+p2), 1e-300)) AS l2 FROM sc) GROUP BY ALL)"""
_CM = ", ".join(f"sum(n) FILTER (WHERE y = {y} AND pred = {k}) AS c{y}{k}" for y in range(3) for k in range(3))
_HITS = f"""hh AS (SELECT rule_id, y, n, CASE WHEN d01 >= a AND d02 >= b THEN 0 WHEN d01 < a AND d12 >= b - a THEN 1 ELSE 2 END AS pred FROM dd, rules),
surf0 AS (SELECT rule_id, {_CM} FROM hh GROUP BY 1), surf1 AS (SELECT rule_id, {', '.join(f'coalesce(c{y}{k}, 0) AS c{y}{k}' for y in range(3) for k in range(3))} FROM surf0),
surface AS (SELECT *, c00/(c00 + c01 + c02) AS s0, c11/(c10 + c11 + c12) AS s1, c22/(c20 + c21 + c22) AS s2, (c00 + c11 + c22)/(c00 + c01 + c02 + c10 + c11 + c12 + c20 + c21 + c22) AS accuracy FROM surf1)"""
_LATTICE = 96
_SURFACE = f"""{_DD}, sp AS (SELECT 2*greatest(max(d01) - min(d01), max(d02) - min(d02), max(d12) - min(d12), 1) AS pad FROM dd),
w3 AS (SELECT i*{_LATTICE + 1} + j AS rule_id, ln(greatest(i/{_LATTICE}.0::DOUBLE, 1e-300)) AS u, ln(greatest(j/{_LATTICE}.0::DOUBLE, 1e-300)) AS v, ln(greatest(({_LATTICE}-i-j)/{_LATTICE}.0::DOUBLE, 1e-300)) AS w FROM range({_LATTICE + 1}) t(i), range({_LATTICE + 1}) u(j) WHERE i + j <= {_LATTICE}),
rules AS (SELECT rule_id, round(greatest(least(v - u, pad), -pad), 9) AS a, round(greatest(least(w - u, pad), -pad), 9) AS b FROM w3, sp), {_HITS},
pts AS (SELECT round(s0, 9) AS s0, round(s1, 9) AS s1, max(round(s2, 9)) AS s2 FROM surface GROUP BY 1, 2),
front AS (SELECT * FROM pts p WHERE NOT EXISTS (SELECT 1 FROM pts q WHERE q.s0 >= p.s0 AND q.s1 >= p.s1 AND q.s2 >= p.s2 AND (q.s0 > p.s0 OR q.s1 > p.s1 OR q.s2 > p.s2)))"""


def mesh(spark: SparkSession, d: str) -> DataFrame:
    return su.lattice_surface(T.scored_sample(spark, d), _LATTICE)


_CELLS = ", ".join(n(c, c) for c in su._COUNTS)


@query("lattice_surface", f"WITH {_SURFACE} SELECT {n('rule_id', 'rule_id')}, {_CELLS}, {r('s0', 's0')}, {r('s1', 's1')}, {r('s2', 's2')}, {r('accuracy', 'accuracy')} FROM surface")
def _(spark, d):
    return mesh(spark, d).select("rule_id", *su._COUNTS, "s0", "s1", "s2", "accuracy")


def axis_sql(name: str, source: str, value: str, resolution: int, pad: str) -> str:
    """CTEs of the cuts of a sweep axis: ``name`` (t, k)."""
    shares = ", ".join(repr(x) for x in np.linspace(0, 1, resolution).tolist())
    return f"""{name}_u AS (SELECT DISTINCT {value} AS u FROM {source} WHERE {value} IS NOT NULL), {name}_q AS (SELECT DISTINCT u FROM (SELECT unnest(quantile_cont(u, [{shares}])) AS u FROM {name}_u WHERE (SELECT count(*) FROM {name}_u) > {resolution} UNION ALL SELECT u FROM {name}_u WHERE (SELECT count(*) FROM {name}_u) <= {resolution})),
{name} AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k FROM (SELECT (u + lead(u) OVER (ORDER BY u))/2 AS t FROM {name}_q UNION ALL SELECT min(u) - {pad} FROM {name}_q UNION ALL SELECT max(u) + {pad} FROM {name}_q) WHERE t IS NOT NULL)"""


_PAD = "(SELECT greatest(1, 2*greatest(max(d01) - min(d01), max(d02) - min(d02), max(d12) - min(d12))) FROM dd)"


def _sweep_sql(resolution: int) -> str:
    return f"""{_DD}, {axis_sql('ax', 'dd', 'd01', resolution, _PAD)}, {axis_sql('bx', 'dd', 'd02', resolution, _PAD)},
rules AS (SELECT ax.k*(SELECT count(*) FROM bx) + bx.k AS rule_id, ax.t AS a, bx.t AS b FROM ax, bx), {_HITS}"""


@query("roc_surface", None)
def _(spark, d):
    return su.roc_surface(T.scored_sample(spark, d)).select("rule_id", "w0", "w1", "w2", *su._COUNTS, "s0", "s1", "s2", "accuracy")


@query("roc_surface_coarse", f"WITH {_sweep_sql(16)} SELECT {n('rule_id', 'rule_id')}, {_CELLS}, {r('1/(1 + exp(a) + exp(b))', 'w0')}, {r('s0', 's0')}, {r('s1', 's1')}, {r('s2', 's2')}, {r('accuracy', 'accuracy')} FROM surface JOIN rules USING (rule_id)")
def _(spark, d):
    return su.roc_surface(T.scored_sample(spark, d), 16).select("rule_id", "w0", *su._COUNTS, "s0", "s1", "s2", "accuracy")


@query("surface_volumes", None)
def _(spark, d):
    front = su.pareto_front(su.roc_surface(T.scored_sample(spark, d)))
    v = su.hypervolume(front).select(F.col("volume").alias("vus"), su.adjusted(F.col("volume")).alias("vus_adjusted"))
    return v.crossJoin(su.hull_volume(front).withColumnRenamed("volume", "vus_convex_hull")).crossJoin(su.hypervolume_mc(front).select(F.col("volume").alias("vus_mc"), F.col("se").alias("vus_mc_se")))


@query("pareto_front", f"WITH {_SURFACE} SELECT {r('s0', 's0')}, {r('s1', 's1')}, {r('s2', 's2')} FROM front")
def _(spark, d):
    return su.pareto_front(mesh(spark, d))


def _volume_sql(f: tuple[float, float, float]) -> str:
    return f"""WITH {_SURFACE}, ins AS (SELECT * FROM front WHERE s0 > {f[0]} AND s1 > {f[1]} AND s2 > {f[2]}), u AS (SELECT hi AS u, hi - coalesce(lag(hi) OVER (ORDER BY hi), {f[0]}) AS du FROM (SELECT DISTINCT s0 AS hi FROM ins)), v AS (SELECT hi AS v, hi - coalesce(lag(hi) OVER (ORDER BY hi), {f[1]}) AS dv FROM (SELECT DISTINCT s1 AS hi FROM ins)),
g AS (SELECT u, du, v, dv, max(s2) OVER (PARTITION BY u ORDER BY v DESC) AS z FROM u CROSS JOIN v LEFT JOIN ins ON s0 = u AND s1 = v), z AS (SELECT du, dv, max(z) OVER (PARTITION BY v ORDER BY u DESC) AS z FROM g) SELECT {r(f'coalesce(sum(du*dv*(z - {f[2]}::DOUBLE)), 0)', 'volume')} FROM z"""


@query("hypervolume", _volume_sql((0.0, 0.0, 0.0)))
def _(spark, d):
    return su.hypervolume(su.pareto_front(mesh(spark, d)))


@query("partial_vus", _volume_sql((0.1, 0.1, 0.1)))
def _(spark, d):
    return su.hypervolume(su.pareto_front(mesh(spark, d)), (0.1, 0.1, 0.1))


@query("monotone_envelope", f"WITH {_SURFACE} SELECT {n('i', 'i')}, {n('j', 'j')}, {r('coalesce(max(s2), 0)', 'z')} FROM (SELECT i, j, (i + 0.5::DOUBLE)/201 AS u, (j + 0.5::DOUBLE)/201 AS v FROM range(201) t(i), range(201) w(j)) LEFT JOIN front ON s0 >= u AND s1 >= v GROUP BY 1, 2")
def _(spark, d):
    return su.envelope(su.pareto_front(mesh(spark, d)))


_COST = [[0.0, 1.0, 3.0], [1.0, 0.0, 1.0], [5.0, 2.0, 0.0]]
_EVERY = "(c00 + c01 + c02 + c10 + c11 + c12 + c20 + c21 + c22)"
_OBJ = {"youden": "s0 + s1 + s2 - 1", "balanced_accuracy": "(s0 + s1 + s2)/3", "closest_to_perfection": "-sqrt((1-s0)*(1-s0) + (1-s1)*(1-s1) + (1-s2)*(1-s2))", "maximin": "least(s0, s1, s2)", "accuracy": "accuracy", "max_volume": "s0*s1*s2",
        "expected_cost": "-(" + " + ".join(f"(c{y}0 + c{y}1 + c{y}2)/{_EVERY}*(c{y}{k}/(c{y}0 + c{y}1 + c{y}2))*{_COST[y][k]}" for y in range(3) for k in range(3)) + ")"}


def _select_sql(where: str, surface: str = "", costs: bool = True) -> str:
    each = " UNION ALL ".join(f"SELECT '{k}' AS criterion, rule_id, CAST({e} AS DOUBLE) AS value, s0, s1, s2 FROM surface {where}" for k, e in _OBJ.items() if costs or k != "expected_cost")
    return f"WITH {surface or _SURFACE}, o AS ({each}), t AS (SELECT * FROM o QUALIFY value >= max(value) OVER (PARTITION BY criterion) - 1e-12) SELECT criterion, {n('rule_id', 'rule_id')}, {r('value', 'value')}, {r('s0', 's0')}, {r('s1', 's1')}, {r('s2', 's2')} FROM t QUALIFY row_number() OVER (PARTITION BY criterion ORDER BY least(s0, s1, s2) DESC, rule_id) = 1"


@query("select_points", _select_sql(""))
def _(spark, d):
    return su.select_points(mesh(spark, d), costs=_COST)


@query("select_constrained", _select_sql("WHERE s2 >= 0.5"))
def _(spark, d):
    return su.select_points(mesh(spark, d), {"s2": 0.5}, _COST)


@query("guarantee_curve", f"WITH {_SURFACE} SELECT {r('f', 'floor')}, {r('max(s0 + s1 + s2 - 1)', 'best_youden')}, {n('count(*)', 'n_rules')} FROM surface, (VALUES {', '.join(f'({f!r}::DOUBLE)' for f in su.FLOORS)}) t(f) WHERE s2 >= f GROUP BY f")
def _(spark, d):
    return su.guarantee_curve(mesh(spark, d))


def _ordinal_sql(resolution: int) -> str:
    cells = ", ".join(f"l.b{p} AS c{p}0, h.b{p} - l.b{p} AS c{p}1, n{p} - h.b{p} AS c{p}2" for p in range(3))
    return f"""{SC}, {axis_sql('cx', 'sc', 'marker', resolution, '(SELECT 0.05::DOUBLE*greatest(max(marker) - min(marker), 1) FROM sc)')},
mc AS (SELECT y, marker, count(*) AS n FROM sc GROUP BY 1, 2), b AS (SELECT k, t, {', '.join(f'coalesce(sum(n) FILTER (WHERE y = {p} AND marker < t), 0) AS b{p}' for p in range(3))} FROM cx, mc GROUP BY 1, 2), m AS (SELECT {', '.join(f'count(*) FILTER (WHERE y = {p}) AS n{p}' for p in range(3))} FROM sc),
surface0 AS (SELECT l.k*(SELECT count(*) FROM cx) + h.k AS rule_id, l.t AS t1, h.t AS t2, {cells} FROM b l JOIN b h ON l.k <= h.k, m),
surface AS (SELECT *, c00/(c00 + c01 + c02) AS s0, c11/(c10 + c11 + c12) AS s1, c22/(c20 + c21 + c22) AS s2, (c00 + c11 + c22)/{_EVERY} AS accuracy FROM surface0)"""


@query("ordinal_surface", f"WITH {_ordinal_sql(200)} SELECT {n('rule_id', 'rule_id')}, {r('t1', 't1')}, {r('t2', 't2')}, {_CELLS}, {r('s0', 's0')}, {r('s1', 's1')}, {r('s2', 's2')} FROM surface")
def _(spark, d):
    return su.ordinal_surface(T.scored_sample(spark, d), "marker").select("rule_id", "t1", "t2", *su._COUNTS, "s0", "s1", "s2")


@query("ordinal_points", _select_sql("WHERE s1 >= 0.2", _ordinal_sql(200)))
def _(spark, d):
    return su.select_points(su.ordinal_surface(T.scored_sample(spark, d), "marker"), {"s1": 0.2}, _COST)


@query("ordinal_volume", None)
def _(spark, d):
    front = su.pareto_front(su.ordinal_surface(T.scored_sample(spark, d), "marker"))
    return su.hypervolume(front).select(F.col("volume").alias("vus"), su.adjusted(F.col("volume")).alias("vus_adjusted"))


# ---- grading ---------------------------------------------------------------------------------

PT = V.PRICE_TEST
_BINS = f"{PT}, e AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM pt), bn AS (SELECT pt.*, CAST(score >= q[1] AS INTEGER) + CAST(score >= q[2] AS INTEGER) + CAST(score >= q[3] AS INTEGER) + CAST(score >= q[4] AS INTEGER) AS bin FROM pt, e)"
_SPAN = "(ln(1.1::DOUBLE) - ln(0.9::DOUBLE))"
_GATES = f"""{_BINS}, g0 AS (SELECT bin, arm, m, count(*) AS n, avg(bought) AS d, avg(score) AS pr FROM bn GROUP BY 1, 2, 3), g1 AS (SELECT *, n*d/(1-d) AS w, ln(m) AS x, ln(d) AS y FROM g0 WHERE d > 0 AND d < 1),
g2 AS (SELECT bin, sum(n) AS n, sum(n*pr) AS sp, sum(w) AS sw, sum(w*x) AS swx, sum(w*y) AS swy, sum(w*x*x) AS swxx, sum(w*x*y) AS swxy FROM g1 GROUP BY 1),
gates AS (SELECT bin, n, sp/n AS mean_score, -(sw*swxy - swx*swy)/(sw*swxx - swx*swx) AS elasticity, sqrt(sw/(sw*swxx - swx*swx)) AS se FROM g2)"""


@query("gates_price_test", f"WITH {_GATES} SELECT {n('bin', 'bin')}, {n('n', 'n')}, {r('mean_score', 'mean_score')}, {r('elasticity', 'elasticity')}, {r('se', 'se')} FROM gates")
def _(spark, d):
    return gr.gates_loglinear(T.price_test(spark, d), "score")


@query("gates_arc", f"""WITH {_BINS}, a AS (SELECT bin, count(*) AS n, avg(bought) FILTER (WHERE arm = 0) AS dl, avg(bought) FILTER (WHERE arm = 2) AS dh, count(*) FILTER (WHERE arm = 0) AS nl, count(*) FILTER (WHERE arm = 2) AS nh FROM bn GROUP BY 1)
SELECT {n('bin', 'bin')}, {n('n', 'n')}, {r(f'-(ln(dh) - ln(dl))/{_SPAN}', 'elasticity')}, {r(f'sqrt((1-dl)/(dl*nl) + (1-dh)/(dh*nh))/{_SPAN}', 'se')} FROM a""")
def _(spark, d):
    return gr.gates_arc(T.price_test(spark, d), "score")


@query("blp_slope", f"""WITH {_GATES}, s AS (SELECT count(*) AS k, sum(1/(se*se)) AS sw, sum(mean_score/(se*se)) AS sx, sum(elasticity/(se*se)) AS sy, sum(mean_score*mean_score/(se*se)) AS sxx, sum(mean_score*elasticity/(se*se)) AS sxy FROM gates)
SELECT {n('k', 'n_bins')}, {r('(sw*sxy - sx*sy)/(sw*sxx - sx*sx)', 'slope')}, {r('sqrt(sw/(sw*sxx - sx*sx))', 'slope_se')}, {r('(sy*sxx - sx*sxy)/(sw*sxx - sx*sx)', 'intercept')} FROM s""")
def _(spark, d):
    return gr.blp_slope(gr.gates_loglinear(T.price_test(spark, d), "score"))


@query("elasticity_from_posterior", f"WITH {PT} SELECT row_id, {r(f'-(ln(greatest(p2, 1e-12)) - ln(greatest(p0, 1e-12)))/{_SPAN}', 'elasticity')} FROM pt")
def _(spark, d):
    return T.price_test(spark, d).select("row_id", gr.posterior_elasticity(F.col("p0"), F.col("p2")).alias("elasticity"))


@query("demand_curve", f"WITH {PT} SELECT row_id, " + ", ".join(r(f"greatest(0.0, least(1.0, p{k}*0.6::DOUBLE/(1/3.0::DOUBLE)))", f"d{k}") for k in range(3)) + " FROM pt")
def _(spark, d):
    return gr.demand_curve(T.price_test(spark, d), F.lit(0.6))


_ARM = "CASE WHEN p0*0.9::DOUBLE >= p1*1.0::DOUBLE AND p0*0.9::DOUBLE >= p2*1.1::DOUBLE THEN 0 WHEN p1*1.0::DOUBLE >= p2*1.1::DOUBLE THEN 1 ELSE 2 END"
_Q = "0.3333333333333333::DOUBLE"


@query("revenue_policy", f"WITH {PT} SELECT {n(_ARM, 'policy')}, {n('count(*)', 'n')}, {r('avg(score)', 'mean_score')} FROM pt GROUP BY 1")
def _(spark, d):
    return T.price_test(spark, d).withColumn("policy", gr.revenue_arm()).groupBy("policy").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


@query("policy_value_ipw", f"WITH {PT}, c AS (SELECT CASE WHEN arm = {_ARM} THEN bought*m/{_Q} ELSE 0 END AS c FROM pt) SELECT {r('avg(c)', 'value')}, {r('stddev_samp(c)/sqrt(count(*))', 'se')}, {n('count(*)', 'n')} FROM c")
def _(spark, d):
    return gr.ipw_value(T.price_test(spark, d), gr.revenue_arm(), F.col("bought") * F.col("m"))


@query("policy_value_aipw", f"WITH {PT}, t AS (SELECT *, bought*m AS rw, {_ARM} AS t FROM pt), f AS (SELECT p_brand, arm AS t, avg(rw) AS mu FROM t GROUP BY 1, 2), c AS (SELECT mu + CASE WHEN arm = t.t THEN (rw - mu)/{_Q} ELSE 0 END AS c FROM t JOIN f USING (p_brand, t)) SELECT {r('avg(c)', 'value')}, {r('stddev_samp(c)/sqrt(count(*))', 'se')}, {n('count(*)', 'n')} FROM c")
def _(spark, d):
    return gr.aipw_value(T.price_test(spark, d), gr.revenue_arm(), F.col("bought") * F.col("m"), "p_brand")


@query("dr_uplift", f"""WITH {PT}, f AS (SELECT p_brand, avg(bought*m) FILTER (WHERE arm = 0) AS mu0, avg(bought*m) FILTER (WHERE arm = 2) AS mu1 FROM pt GROUP BY 1)
SELECT p_brand, {n('count(*)', 'n')}, {r(f'avg(mu0 - mu1 + CASE WHEN arm = 0 THEN (bought*m - mu0)/{_Q} ELSE 0 END - CASE WHEN arm = 2 THEN (bought*m - mu1)/{_Q} ELSE 0 END)', 'uplift')} FROM pt JOIN f USING (p_brand) GROUP BY 1""")
def _(spark, d):
    return gr.dr_uplift(T.price_test(spark, d), "p_brand", F.col("bought") * F.col("m"))


@query("targeting_curve", f"""WITH {PT}, b AS (SELECT gain, sum(CASE WHEN arm = {_ARM} THEN bought*m/{_Q} ELSE 0 END) AS t, sum(CASE WHEN arm = 1 THEN bought*m/{_Q} ELSE 0 END) AS f, count(*) AS k FROM (SELECT * REPLACE (round(gain, 6) AS gain) FROM pt) GROUP BY 1),
c AS (SELECT t, f, k, sum(k) OVER d AS upto, sum(t) OVER d AS tt, sum(f) OVER d AS ff, sum(k) OVER () AS n, sum(f) OVER () AS fa FROM b WINDOW d AS (ORDER BY gain DESC ROWS UNBOUNDED PRECEDING))
SELECT {r('i/20.0::DOUBLE', 'share')}, {r('(tt - t - ff + f + fa + (kk - upto + k)/k*(t - f))/n', 'value')} FROM c JOIN (SELECT i, round_even(i*(SELECT sum(k) FROM b)/20.0::DOUBLE, 0) AS kk FROM range(21) z(i)) ON (kk > upto - k AND kk <= upto) OR (kk = 0 AND upto = k)""")
def _(spark, d):
    return gr.targeting_curve(T.price_test(spark, d).withColumn("gain", F.round("gain", 6)), "gain", gr.revenue_arm(), F.col("bought") * F.col("m"), 21)


@query("predictive_metrics", f"WITH {PT}, e AS (SELECT CAST(bought AS DOUBLE) AS y, p0 AS p, p0 - bought AS e FROM pt) SELECT {r('sqrt(avg(e*e))', 'rmse')}, {r('avg(abs(e))', 'mae')}, {r('avg(e)', 'bias')}, {r('1 - sum(e*e)/(sum(y*y) - count(*)*avg(y)*avg(y))', 'r2')}, {r('avg(abs(exp(p) - exp(y))/greatest(exp(y), 1e-9))', 'level_mape')} FROM e")
def _(spark, d):
    return gr.predictive_metrics(T.price_test(spark, d), F.col("bought").cast("double"), F.col("p0"))


@query("oracle_metrics", f"WITH {PT}, e AS (SELECT score/25 AS t, p0*3 AS s, p0*3 - score/25 AS e FROM pt) SELECT {r('sqrt(avg(e*e))', 'rmse')}, {r('avg(e)', 'bias')}, {r('avg(abs(e))', 'mae')}, {r('corr(t, s)', 'corr')}, {r('avg(e)*avg(e)/avg(e*e)', 'bias_share')} FROM e")
def _(spark, d):
    return gr.recovery_metrics(T.price_test(spark, d), F.col("score") / 25, F.col("p0") * 3)


@query("elasticity_summary", f"WITH {PT}, e AS (SELECT score/25 AS e FROM pt) SELECT {r('avg(e)', 'mean')}, {r('stddev_samp(e)', 'sd')}, {r('quantile_cont(e, 0.05)', 'p5')}, {r('quantile_cont(e, 0.5)', 'median')}, {r('quantile_cont(e, 0.95)', 'p95')}, {r('avg(CAST(e < 0 AS DOUBLE))', 'share_negative')}, {r('avg(CAST(e < 1 AS DOUBLE))', 'share_inelastic')} FROM e")
def _(spark, d):
    return gr.summary(T.price_test(spark, d), F.col("score") / 25)


_BLP = f"""{LOGS}, rs AS (SELECT log_qty - avg(log_qty) OVER w AS ry, log_price - avg(log_price) OVER w AS rt, n_lines/5.0::DOUBLE AS eps FROM logs WINDOW w AS (PARTITION BY stock_code)), d0 AS (SELECT ry AS y, -rt AS a, -rt*(eps - (SELECT avg(eps) FROM rs)) AS b FROM rs),
s AS (SELECT count(*) AS n, sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*y) AS ay, sum(b*y) AS by_ FROM d0), be AS (SELECT *, (bb*ay - ab*by_)/(aa*bb - ab*ab) AS b0, (aa*by_ - ab*ay)/(aa*bb - ab*ab) AS b1, aa*bb - ab*ab AS det FROM s),
mm AS (SELECT any_value(n) AS n, any_value(aa) AS aa, any_value(ab) AS ab, any_value(det) AS det, any_value(b0) AS b0, any_value(b1) AS b1, sum(power(y - b0*a - b1*b, 2)*a*a) AS maa, sum(power(y - b0*a - b1*b, 2)*a*b) AS mab, sum(power(y - b0*a - b1*b, 2)*b*b) AS mbb FROM d0, be)"""


@query("blp_calibration", f"WITH {_BLP} SELECT {n('n', 'n')}, {r('b0', 'average_effect')}, {r('b1', 'calibration')}, {r('sqrt((ab*ab*maa - 2*aa*ab*mab + aa*aa*mbb)/(det*det)*n/(n - 2))', 'calibration_se')} FROM mm")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("stock_code")
    res = logs(spark, d).select((F.col("log_qty") - F.avg("log_qty").over(w)).alias("ry"), (F.col("log_price") - F.avg("log_price").over(w)).alias("rt"), (F.col("n_lines") / 5.0).alias("eps"))
    return gr.blp_orthogonal(res)


@query("lerner_price", f"WITH {PT} SELECT row_id, {r('least(greatest(CASE WHEN score/20 > 1 + 1e-9 THEN 0.5::DOUBLE*(score/20)/(score/20 - 1) ELSE 2.0 END, 0.5::DOUBLE), 2.0::DOUBLE)', 'price')}, {r('1/power(greatest(abs(score/20 - 1), 1e-3), 4)', 'weight', 2)} FROM pt")
def _(spark, d):
    eps = F.col("score") / 20
    return T.price_test(spark, d).select("row_id", gr.lerner_price(F.lit(0.5), eps, F.lit(1.0)).alias("price"), F.round(gr.profit_weight(eps), 2).alias("weight"))


_PROFIT = "bought*(m - 0.6::DOUBLE)"


@query("policy_profit", f"""WITH {PT}, w AS (SELECT *, CASE WHEN arm = {_ARM} THEN 1/{_Q} ELSE 0 END AS w, {_PROFIT} AS p FROM pt), s AS (SELECT sum(w) AS sw, sum(w*w) AS sww, sum(w*p) AS swp, sum(w*w*p*p) AS swp2, sum(w*w*p) AS swwp, sum(w*bought) AS swb, count(*) FILTER (WHERE w > 0) AS matched FROM w)
SELECT {r('swp/sw', 'value')}, {r('sqrt(swp2 - 2*(swp/sw)*swwp + (swp/sw)*(swp/sw)*sww)/sw', 'se')}, {r('swb/sw', 'conversion')}, {n('matched', 'matched')}, {r('sw*sw/sww', 'ess')} FROM s""")
def _(spark, d):
    return gr.policy_profit(T.price_test(spark, d), gr.revenue_arm(), F.col("bought") * (F.col("m") - 0.6), F.lit(1 / 3))


@query("experiment_cost", f"WITH {PT}, s AS (SELECT arm, count(*) AS n, avg({_PROFIT}) AS p FROM pt GROUP BY 1) SELECT {n('arm', 'arm')}, {n('n', 'n')}, {r('p', 'profit')}, {r('max(p) FILTER (WHERE arm = 1) OVER () - p', 'cost_vs_control')}, {r('max(p) OVER () - p', 'cost_vs_best')} FROM s")
def _(spark, d):
    return gr.experiment_cost(T.price_test(spark, d), F.col("bought") * (F.col("m") - 0.6))


_NEAR = "CASE WHEN abs(ln(x) - ln(0.9::DOUBLE)) <= abs(ln(x)) AND abs(ln(x) - ln(0.9::DOUBLE)) <= abs(ln(x) - ln(1.1::DOUBLE)) THEN 0 WHEN abs(ln(x)) <= abs(ln(x) - ln(1.1::DOUBLE)) THEN 1 ELSE 2 END"


@query("lerner_arm_policy", f"WITH {PT}, x AS (SELECT least(greatest(CASE WHEN score/20 > 1 + 1e-9 THEN 0.5::DOUBLE*(score/20)/(score/20 - 1) ELSE 2.0 END, 0.5::DOUBLE), 2.0::DOUBLE) AS x FROM pt) SELECT {n(_NEAR, 'arm')}, {n('count(*)', 'n')} FROM x GROUP BY 1")
def _(spark, d):
    price = gr.lerner_price(F.lit(0.5), F.col("score") / 20, F.lit(1.0))
    return T.price_test(spark, d).withColumn("x", price).groupBy(gr.nearest_arm(F.col("x")).alias("arm")).agg(F.count("*").alias("n"))


@query("profit_regret", f"""WITH {PT}, v AS (SELECT p0*0.3::DOUBLE AS v0, p1*0.4::DOUBLE AS v1, p2*0.5::DOUBLE AS v2, {_ARM} AS t FROM pt), g AS (SELECT greatest(v0, v1, v2) AS b, CASE t WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END AS g FROM v)
SELECT {r('avg(b - g)', 'mean_regret')}, {r('quantile_cont(b - g, 0.5)', 'median_regret')}, {r('quantile_cont(b - g, 0.9)', 'p90_regret')}, {r('sum(g)/sum(b)', 'share_of_best')} FROM g""")
def _(spark, d):
    return gr.regret(T.price_test(spark, d), gr.revenue_arm(), [F.col("p0") * 0.3, F.col("p1") * 0.4, F.col("p2") * 0.5])


# ---- experiment ------------------------------------------------------------------------------

EX = V.EXPERIMENT
_H, _L = "(-0.1::DOUBLE - risk/10)", "(0.1::DOUBLE + risk/10)"


def high() -> Column:
    """Log risk ratio of the high arm; made on call, as a column needs a session."""
    return -0.1 - F.col("risk") / 10


def low() -> Column:
    return 0.1 + F.col("risk") / 10


_RULES = {
    "null_quote_id": "quote_id IS NULL", "null_customer_id": "customer_id IS NULL", "null_timestamp": "quote_timestamp IS NULL", "bad_eligible": "NOT coalesce(eligible IN (0, 1), false)", "bad_purchase": "NOT coalesce(purchase IN (0, 1), false)",
    "unknown_arm": "NOT coalesce(upper(trim(arm)) IN ('H', 'C', 'L'), false)", "propensity_not_positive": "least(pi_H, pi_C, pi_L) <= 0", "propensity_sum": "abs(pi_H + pi_C + pi_L - 1) > 1e-6", "missing_contribution": "contribution_H IS NULL OR contribution_C IS NULL OR contribution_L IS NULL", "bad_premium": "NOT coalesce(base_premium > 0, false)",
}


@query("validate_experiment", f"WITH {EX} " + " UNION ALL ".join(f"SELECT '{k}' AS code, {n(f'count(*) FILTER (WHERE {c})', 'n_rows')} FROM ex" for k, c in _RULES.items()) + f" UNION ALL SELECT 'duplicate_quote_id', {n('count(*) - count(DISTINCT quote_id)', 'n_rows')} FROM ex WHERE quote_id IS NOT NULL")
def _(spark, d):
    return ex.validate(T.experiment(spark, d))


@query("assignment_audit", f"WITH {EX}, e AS (SELECT arm, unnest([{{'a': 'H', 'p': pi_H}}, {{'a': 'C', 'p': pi_C}}, {{'a': 'L', 'p': pi_L}}]) AS e FROM ex) SELECT e.a AS arm_label, {n('count(*) FILTER (WHERE arm = e.a)', 'observed')}, {r('sum(e.p)', 'expected')}, {r('(count(*) FILTER (WHERE arm = e.a) - sum(e.p))/sqrt(sum(e.p*(1 - e.p)))', 'z')} FROM e GROUP BY 1")
def _(spark, d):
    return ex.assignment_audit(T.experiment(spark, d))


def _smd(c: str) -> str:
    return f"SELECT '{c}' AS name, {r(f'''(avg({c}) FILTER (WHERE arm = 'H') - avg({c}) FILTER (WHERE arm = 'C'))/stddev_samp({c})''', 'smd_h')}, {r(f'''(avg({c}) FILTER (WHERE arm = 'L') - avg({c}) FILTER (WHERE arm = 'C'))/stddev_samp({c})''', 'smd_l')}, {r(f'avg(CAST({c} IS NULL AS DOUBLE))', 'missing')} FROM ex"


@query("covariate_balance", f"WITH {EX} {_smd('base_premium')} UNION ALL {_smd('risk')}")
def _(spark, d):
    return ex.covariate_balance(T.experiment(spark, d), ["base_premium", "risk"])


@query("dose_compliance", f"WITH {EX}, e AS (SELECT arm, displayed_premium/base_premium AS rl, assigned_multiplier AS a FROM ex) SELECT arm, {n('count(*)', 'n')}, {r('avg(rl)', 'mean_realised')}, {r('avg(a)', 'mean_assigned')}, {r('avg(abs(rl - a))', 'mean_abs_error')}, {r('quantile_cont(abs(rl - a), 0.99)', 'p99_abs_error')} FROM e GROUP BY 1")
def _(spark, d):
    return ex.dose_compliance(T.experiment(spark, d))


_FLIP = f"fl AS (SELECT *, pi_H*exp({_H}) AS a, pi_C AS b, pi_L*exp({_L}) AS c FROM ex)"


@query("bayes_flip", f"WITH {EX}, {_FLIP} SELECT quote_id, {r('a/(a+b+c)', 'r_h')}, {r('b/(a+b+c)', 'r_c')}, {r('c/(a+b+c)', 'r_l')}, {r(f'exp({_H})', 'rr_h')}, {r(f'exp({_L})', 'rr_l')} FROM fl")
def _(spark, d):
    e = T.experiment(spark, d)
    flip = ex.flipped(high(), low())
    back = ex.risk_ratios(flip)
    return e.select("quote_id", flip[0].alias("r_h"), flip[1].alias("r_c"), flip[2].alias("r_l"), back[0].alias("rr_h"), back[2].alias("rr_l"))


@query("log_rr_elasticities", f"WITH {EX} SELECT quote_id, {r(f'-least({_H} + 0.15::DOUBLE, 0)/ln(1.1::DOUBLE)', 'eps_up')}, {r(f'-greatest({_L}, 0)/ln(0.9::DOUBLE)', 'eps_down')} FROM ex")
def _(spark, d):
    up, down = ex.elasticities(*ex.projected(high() + 0.15, low()))
    return T.experiment(spark, d).select("quote_id", up.alias("eps_up"), down.alias("eps_down"))


def _nll(arm: str, rr: str) -> str:
    p = f"(1/(1 + exp(-(ln(pi_{arm}/pi_C) + {rr}))))"
    return f"SELECT '{arm}' AS pair, count(*) AS n_buyers, avg(-CASE WHEN arm = '{arm}' THEN ln({p}) ELSE ln(1 - {p}) END) AS nll FROM ex WHERE purchase = 1 AND arm IN ('{arm}', 'C')"


@query("pairwise_nll", f"WITH {EX}, a AS ({_nll('H', _H)} UNION ALL {_nll('L', _L)}) SELECT pair, {n('n_buyers', 'n_buyers')}, {r('nll', 'nll')} FROM a")
def _(spark, d):
    e = T.experiment(spark, d)
    return ex.pairwise_nll(e, "H", high()).unionByName(ex.pairwise_nll(e, "L", low()))


@query("equal_contrast_nll", f"WITH {EX}, a AS ({_nll('H', _H)} UNION ALL {_nll('L', _L)}) SELECT {r('avg(nll)', 'equal_contrast_nll')}, {n('sum(n_buyers)', 'n_rows')} FROM a")
def _(spark, d):
    return ex.equal_contrast_nll(T.experiment(spark, d), high(), low())


_GLOBAL = "gl AS (SELECT ln(count(*) FILTER (WHERE arm = 'H')/count(*) FILTER (WHERE arm = 'C')) - ln(0.2::DOUBLE/0.6::DOUBLE) AS h, ln(count(*) FILTER (WHERE arm = 'L')/count(*) FILTER (WHERE arm = 'C')) - ln(0.2::DOUBLE/0.6::DOUBLE) AS l FROM ex WHERE purchase = 1)"


@query("global_log_rr", f"WITH {EX}, {_GLOBAL} SELECT 'H' AS pair, {r('h', 'log_rr')} FROM gl UNION ALL SELECT 'L', {r('l', 'log_rr')} FROM gl")
def _(spark, d):
    return ex.global_log_rr(T.experiment(spark, d))


@query("information_gain", f"WITH {EX}, {_GLOBAL}, a AS ({_nll('H', _H)} UNION ALL {_nll('L', _L)}), b AS ({_nll('H', '(SELECT h FROM gl)')} UNION ALL {_nll('L', '(SELECT l FROM gl)')}) SELECT pair, {r('(b.nll - a.nll)*1000', 'millinats', 4)} FROM a JOIN b USING (pair)")
def _(spark, d):
    return ex.information_gain(T.experiment(spark, d), high(), low()).withColumn("millinats", F.round("millinats", 4))


@query("grouped_calibration", f"""WITH {EX}, b AS (SELECT *, {_H} AS s, row_number() OVER (ORDER BY {_H}, quote_id) AS rn, count(*) OVER () AS nn FROM ex WHERE purchase = 1 AND arm IN ('H', 'C')), g AS (SELECT *, CAST(greatest(ceil((rn - 1)*10.0::DOUBLE/(nn - 1)) - 1, 0) AS BIGINT) AS cell FROM b)
SELECT cell, {n('count(*)', 'n')}, {r('avg(s)', 'predicted')}, {r("ln(count(*) FILTER (WHERE arm = 'H')/count(*) FILTER (WHERE arm = 'C')) - ln(0.2::DOUBLE/0.6::DOUBLE)", 'observed')} FROM g GROUP BY 1""")
def _(spark, d):
    return ex.grouped_calibration(T.experiment(spark, d), "H", high(), 10)


_CHOICE = f"CASE WHEN exp({_H})*contribution_H >= contribution_C AND exp({_H})*contribution_H >= exp({_L})*contribution_L THEN 'H' WHEN contribution_C >= exp({_L})*contribution_L THEN 'C' ELSE 'L' END"


@query("ips_snips", f"""WITH {EX}, w AS (SELECT CASE WHEN arm = {_CHOICE} THEN 1/CASE arm WHEN 'H' THEN pi_H WHEN 'C' THEN pi_C ELSE pi_L END ELSE 0 END AS w, purchase*CASE arm WHEN 'H' THEN contribution_H WHEN 'C' THEN contribution_C ELSE contribution_L END AS rw FROM ex)
SELECT {r('sum(w*rw)/count(*)', 'ips')}, {r('sum(w*rw)/sum(w)', 'snips')}, {r('avg(CAST(w > 0 AS DOUBLE))', 'match_rate')}, {r('sum(w)*sum(w)/sum(w*w)', 'ess')} FROM w""")
def _(spark, d):
    return ex.policy_ips(T.experiment(spark, d), ex.choose_arm([F.exp(high()), F.lit(1.0), F.exp(low())]))


@query("cluster_error", f"WITH {EX}, s AS (SELECT customer_id, sum(purchase*contribution_C) AS s, count(*) AS k FROM ex GROUP BY 1), m AS (SELECT sum(s)/sum(k) AS m FROM s) SELECT {n('count(*)', 'n_clusters')}, {r('any_value(m)', 'mean')}, {r('sqrt(sum((s - m*k)*(s - m*k)))/sum(k)', 'cluster_se')} FROM s, m")
def _(spark, d):
    return ex.cluster_sums(T.experiment(spark, d), "customer_id", F.col("purchase") * F.col("contribution_C"))


# ---- closed-form models ----------------------------------------------------------------------


@query("pooled_loglog", f"WITH {LOGS} SELECT {n('count(*)', 'n')}, {r('-regr_slope(log_qty, log_price)', 'elasticity')}, {r('regr_intercept(log_qty, log_price)', 'intercept')}, {r('regr_r2(log_qty, log_price)', 'r2')} FROM logs")
def _(spark, d):
    return mo.pooled_loglog(logs(spark, d))


@query("shrunk_per_product", f"""WITH {LOGS}, d0 AS (SELECT stock_code, log_qty - avg(log_qty) OVER w AS y, log_price - avg(log_price) OVER w AS t FROM logs WINDOW w AS (PARTITION BY week)), g AS (SELECT stock_code, count(*) AS n, stddev_samp(t) AS sd, covar_pop(t, y) AS ty, var_pop(t) AS tt, var_pop(y) AS yy FROM d0 GROUP BY 1),
v AS (SELECT *, CASE WHEN n >= 12 AND sqrt(tt) >= 0.02::DOUBLE AND n*tt > 1e-10 THEN -ty/tt END AS b, CASE WHEN n >= 12 AND sqrt(tt) >= 0.02::DOUBLE AND n*tt > 1e-10 THEN greatest((yy - ty*ty/tt)/greatest(n - 2, 1)/tt, 1e-12) END AS v FROM g), m AS (SELECT coalesce(sum(b/v)/sum(1/v), 0) AS mu, greatest(var_samp(b) - avg(v), 1e-6) AS tau FROM v)
SELECT stock_code, {n('n', 'n')}, {r('b', 'raw')}, {r('sqrt(v)', 'se')}, {r('coalesce(tau/(tau + v)*b + (1 - tau/(tau + v))*mu, mu)', 'elasticity')} FROM v, m""")
def _(spark, d):
    return mo.shrunk_per_product(logs(spark, d))


@query("twoway_demean", f"""WITH {LOGS}, a AS (SELECT stock_code, week, log_qty - avg(log_qty) OVER w AS y, log_price - avg(log_price) OVER w AS t FROM logs WINDOW w AS (PARTITION BY stock_code)), b AS (SELECT stock_code, week, y - avg(y) OVER w AS y, t - avg(t) OVER w AS t FROM a WINDOW w AS (PARTITION BY week)),
c AS (SELECT stock_code, week, y - avg(y) OVER w AS y, t - avg(t) OVER w AS t FROM b WINDOW w AS (PARTITION BY stock_code)), e AS (SELECT y - avg(y) OVER w AS y, t - avg(t) OVER w AS t FROM c WINDOW w AS (PARTITION BY week)) SELECT {n('count(*)', 'n')}, {r('-sum(t*y)/sum(t*t)', 'elasticity')} FROM e""")
def _(spark, d):
    return mo.twoway_elasticity(logs(spark, d))


@query("price_levels", f"WITH {LOGS}, e AS (SELECT quantile_cont(log_price, 1/3.0::DOUBLE) AS a, quantile_cont(log_price, 2/3.0::DOUBLE) AS b, avg(log_price) AS m FROM logs) SELECT {n('CAST(log_price >= a AS INTEGER) + CAST(log_price >= b AS INTEGER)', 'level')}, {n('count(*)', 'n')}, {r('avg(log_price)', 'mean_price')}, {r('exp(avg(log_price) - any_value(m))', 'multiplier')} FROM logs, e GROUP BY 1")
def _(spark, d):
    return mo.price_levels(logs(spark, d), "log_price", 3)


@query("unit_weights", f"WITH {LOGS}, w AS (SELECT stock_code, qty/avg(qty) OVER (PARTITION BY stock_code) AS w FROM logs), c AS (SELECT stock_code, least(w, (SELECT quantile_cont(w, 0.99) FROM w)) AS w FROM w) SELECT stock_code, {r('sum(w)/(SELECT avg(w) FROM c)', 'weight')}, {n('count(*)', 'n')} FROM c GROUP BY 1")
def _(spark, d):
    return mo.unit_weights(logs(spark, d), F.col("qty").cast("double"))


@query("effective_size", f"WITH {LOGS} SELECT {r('sum(qty)*sum(qty)/sum(qty*qty)', 'ess')}, {n('count(*)', 'n')} FROM logs")
def _(spark, d):
    return mo.effective_size(logs(spark, d), F.col("qty").cast("double"))


from tercet.plans import decisions  # noqa: E402, F401  (registers its queries above)
