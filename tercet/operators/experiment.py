"""The buyer-side H/C/L experiment: validation, audits, Bayes flips, likelihoods, policies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tercet.operators.ordering import placed_in_order
from tercet.operators.relational import top_fraction

ARMS = ("H", "C", "L")


def pi_of(arm: Column, prefix: str = "pi_") -> Column:
    return F.when(arm == "H", F.col(f"{prefix}H")).when(arm == "C", F.col(f"{prefix}C")).when(arm == "L", F.col(f"{prefix}L"))


def validate(df: DataFrame) -> DataFrame:
    """Rows of (code, n_rows) for every rule of the table's contract, counted in one pass."""
    total = F.col("pi_H") + F.col("pi_C") + F.col("pi_L")
    rules = {
        "null_quote_id": F.col("quote_id").isNull(),
        "null_customer_id": F.col("customer_id").isNull(),
        "null_timestamp": F.col("quote_timestamp").isNull(),
        "bad_eligible": ~F.coalesce(F.col("eligible").isin(0, 1), F.lit(False)),
        "bad_purchase": ~F.coalesce(F.col("purchase").isin(0, 1), F.lit(False)),
        "unknown_arm": ~F.coalesce(F.upper(F.trim("arm")).isin(*ARMS), F.lit(False)),
        "propensity_not_positive": F.least("pi_H", "pi_C", "pi_L") <= 0,
        "propensity_sum": F.abs(total - 1) > 1e-6,
        "missing_contribution": F.col("contribution_H").isNull() | F.col("contribution_C").isNull() | F.col("contribution_L").isNull(),
        "bad_premium": ~F.coalesce(F.col("base_premium") > 0, F.lit(False)),
    }
    counts = df.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(True)).cast("long")), F.lit(0)).alias(k) for k, c in rules.items()])
    repeats = df.filter("quote_id is not null").groupBy("quote_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("code"), F.col(k).alias("n_rows")) for k in rules])).alias("e")).select("e.*")
    return long.unionByName(repeats.select(F.lit("duplicate_quote_id").alias("code"), F.col("n").alias("n_rows")))


def assignment_audit(df: DataFrame) -> DataFrame:
    """Observed against expected arm counts, standardised residual."""
    each = df.select("arm", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.col(f"pi_{a}").alias("p")) for a in ARMS])).alias("e"))
    s = each.groupBy(F.col("e.a").alias("arm_label")).agg(F.sum((F.col("arm") == F.col("e.a")).cast("long")).alias("observed"), F.sum("e.p").alias("expected"), F.sum(F.col("e.p") * (1 - F.col("e.p"))).alias("v"))
    return s.select("arm_label", "observed", "expected", ((F.col("observed") - F.col("expected")) / F.sqrt("v")).alias("z"))


def covariate_balance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Standardised mean differences of H and L against C, and the share missing."""
    long = df.select("arm", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("arm", "e.name", "e.v")
    s = long.groupBy("name").agg(*[F.avg(F.when(F.col("arm") == a, F.col("v"))).alias(a) for a in ARMS], F.stddev_samp("v").alias("sd"), F.avg(F.col("v").isNull().cast("double")).alias("missing"))
    return s.select("name", ((F.col("H") - F.col("C")) / F.col("sd")).alias("smd_h"), ((F.col("L") - F.col("C")) / F.col("sd")).alias("smd_l"), "missing")


def dose_compliance(df: DataFrame) -> DataFrame:
    e = df.select("arm", (F.col("displayed_premium") / F.col("base_premium")).alias("realised"), F.col("assigned_multiplier").alias("assigned")).withColumn("err", F.abs(F.col("realised") - F.col("assigned")))
    return e.groupBy("arm").agg(F.count("*").alias("n"), F.avg("realised").alias("mean_realised"), F.avg("assigned").alias("mean_assigned"), F.avg("err").alias("mean_abs_error"), F.percentile("err", F.lit(0.99)).alias("p99_abs_error"))


def flipped(h: Column, low: Column) -> list[Column]:
    """Buyer posterior over (H, C, L) from log risk ratios: softmax of log propensity plus (h, 0, l)."""
    raw = [F.col("pi_H") * F.exp(h), F.col("pi_C"), F.col("pi_L") * F.exp(low)]
    total = raw[0] + raw[1] + raw[2]
    return [r / total for r in raw]


def risk_ratios(r: list[Column]) -> list[Column]:
    """Back from buyer posteriors to risk ratios against C."""
    c = r[1] / F.col("pi_C")
    return [r[0] / F.col("pi_H") / c, F.lit(1.0), r[2] / F.col("pi_L") / c]


def elasticities(h: Column, low: Column, up: float = 1.1, down: float = 0.9) -> list[Column]:
    return [-h / math.log(up), -low / math.log(down)]


def projected(h: Column, low: Column) -> list[Column]:
    return [F.least(h, F.lit(0.0)), F.greatest(low, F.lit(0.0))]


def pairwise_nll(df: DataFrame, arm: str, log_rr: Column) -> DataFrame:
    """Mean log loss of buyers of an arm against C, with the allocation as offset."""
    index = F.ln(F.col(f"pi_{arm}") / F.col("pi_C")) + log_rr
    p = 1 / (1 + F.exp(-index))
    buyers = df.filter((F.col("purchase") == 1) & F.col("arm").isin(arm, "C"))
    loss = -F.when(F.col("arm") == arm, F.ln(p)).otherwise(F.ln(1 - p))
    return buyers.agg(F.lit(arm).alias("pair"), F.count("*").alias("n_buyers"), F.avg(loss).alias("nll"))


def global_log_rr(df: DataFrame) -> DataFrame:
    """Closed-form log risk ratio of each side arm for constant propensities."""
    buyers = df.filter("purchase = 1").agg(*[F.sum((F.col("arm") == a).cast("double")).alias(f"n_{a}") for a in ARMS], *[F.first(f"pi_{a}").alias(f"pi_{a}") for a in ARMS])
    side = [F.struct(F.lit(a).alias("pair"), (F.ln(F.col(f"n_{a}") / F.col("n_C")) - F.ln(F.col(f"pi_{a}") / F.col("pi_C"))).alias("log_rr")) for a in ("H", "L")]
    return buyers.select(F.explode(F.array(*side)).alias("e")).select("e.*")


def bounded_log_rr(found: DataFrame, most: float = 20.0) -> DataFrame:
    """Log risk ratios held to the sign that a price rise (H) or cut (L) allows."""
    up = F.least(F.greatest("log_rr", F.lit(-most)), F.lit(0.0))
    down = F.least(F.greatest("log_rr", F.lit(0.0)), F.lit(most))
    return found.select("pair", F.when(F.col("pair") == "H", up).otherwise(down).alias("log_rr"))


def selective_policy(df: DataFrame, gain: str, key: str, candidate: Column, fraction: float, default: str = "C") -> DataFrame:
    """``df`` with ``policy``: the candidate for the ``fraction`` of rows of largest gain, the default arm elsewhere; the key tells rows apart."""
    chosen = top_fraction(df.select(key, gain), gain, key, fraction).select(key, F.lit(True).alias("__in"))
    return df.join(chosen, key, "left").withColumn("policy", F.when(F.col("__in"), candidate).otherwise(F.lit(default))).drop("__in")


def top_overlap(df: DataFrame, x: str, y: str, key: str, fraction: float) -> DataFrame:
    """Rows in the top fraction of both scores, and their Jaccard share; the key tells rows apart."""
    a, b = (top_fraction(df.select(key, c), c, key, fraction).select(key, F.lit(1).alias(n)) for c, n in ((x, "a"), (y, "b")))
    s = a.join(b, key, "full").agg(F.count("*").alias("any"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"))
    return s.select("both", (F.col("both") / F.col("any")).alias("jaccard"))


def equal_contrast_nll(df: DataFrame, h: Column, low: Column) -> DataFrame:
    return pairwise_nll(df, "H", h).unionByName(pairwise_nll(df, "L", low)).agg(F.avg("nll").alias("equal_contrast_nll"), F.sum("n_buyers").alias("n_rows"))


def information_gain(df: DataFrame, h: Column, low: Column) -> DataFrame:
    """Millinats per buyer over the best constant, by pair."""
    g = global_log_rr(df)
    best = g.groupBy().agg(F.max(F.when(F.col("pair") == "H", F.col("log_rr"))).alias("__h"), F.max(F.when(F.col("pair") == "L", F.col("log_rr"))).alias("__l"))
    with_best = df.crossJoin(F.broadcast(best))
    model = pairwise_nll(df, "H", h).unionByName(pairwise_nll(df, "L", low)).select("pair", F.col("nll").alias("model_nll"))
    flat = pairwise_nll(with_best, "H", F.col("__h")).unionByName(pairwise_nll(with_best, "L", F.col("__l"))).select("pair", F.col("nll").alias("flat_nll"))
    return model.join(flat, "pair").select("pair", ((F.col("flat_nll") - F.col("model_nll")) * 1000).alias("millinats"))


def grouped_calibration(df: DataFrame, arm: str, log_rr: Column, groups: int) -> DataFrame:
    """Observed log risk ratio by groups of predicted: groups cut the rank (ties by quote_id).

    Ranks come from places in buckets of scores, so no task ranks all rows.
    """
    buyers = df.filter((F.col("purchase") == 1) & F.col("arm").isin(arm, "C")).withColumn("__s", log_rr)
    n = buyers.agg(F.count("*").alias("__n"))
    ranked = placed_in_order(buyers, "__s", "quote_id").withColumn("__rn", F.col("place") + 1).crossJoin(F.broadcast(n))
    cut = F.greatest(F.ceil((F.col("__rn") - 1) * F.lit(float(groups)) / (F.col("__n") - 1)) - 1, F.lit(0)).cast("int")
    s = ranked.groupBy(cut.alias("cell")).agg(F.count("*").alias("n"), F.avg("__s").alias("predicted"), F.sum((F.col("arm") == arm).cast("double")).alias("t"), F.sum((F.col("arm") == "C").cast("double")).alias("c"), F.first(F.col(f"pi_{arm}") / F.col("pi_C")).alias("ratio"))
    return s.select("cell", "n", "predicted", F.when((F.col("t") > 0) & (F.col("c") > 0), F.ln(F.col("t") / F.col("c")) - F.ln("ratio")).alias("observed"))


def policy_ips(df: DataFrame, policy: Column) -> DataFrame:
    """IPS and self-normalised value of a policy, match rate and effective size."""
    w = F.when(F.col("arm") == policy, 1 / pi_of(F.col("arm"))).otherwise(0.0)
    r = F.col("purchase") * pi_of(F.col("arm"), "contribution_")
    s = df.select(w.alias("w"), r.alias("r")).agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"), F.sum(F.col("w") * F.col("r")).alias("swr"), F.avg((F.col("w") > 0).cast("double")).alias("match_rate"))
    return s.select((F.col("swr") / F.col("n")).alias("ips"), (F.col("swr") / F.col("sw")).alias("snips"), "match_rate", (F.col("sw") * F.col("sw") / F.col("sww")).alias("ess"))


def choose_arm(rr: list[Column]) -> Column:
    """The arm of largest risk ratio times contribution; ties to the dearest."""
    v = [r * F.col(f"contribution_{a}") for r, a in zip(rr, ARMS, strict=True)]
    return F.when((v[0] >= v[1]) & (v[0] >= v[2]), "H").when(v[1] >= v[2], "C").otherwise("L")


def cluster_sums(df: DataFrame, cluster: str, value: Column) -> DataFrame:
    """Cluster totals and the cluster-robust error of a mean: what a cluster bootstrap resamples."""
    s = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("k"))
    mean = s.agg((F.sum("s") / F.sum("k")).alias("__m"))
    e = s.crossJoin(F.broadcast(mean)).withColumn("u", F.col("s") - F.col("__m") * F.col("k"))
    return e.agg(F.count("*").alias("n_clusters"), F.first("__m").alias("mean"), (F.sqrt(F.sum(F.col("u") * F.col("u"))) / F.sum("k")).alias("cluster_se"))
